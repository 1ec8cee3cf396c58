import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeferry.llm.toxicity import NAMES, Boosted, Lexicon, Scorer, Toxicity, entries, features, fit, fold_of, isotonic, lexicons, report

DATA = "/root/testdata/sf0.01"


def test_isotonic():
    x, y = np.array([1.0, 2, 3, 4, 5, 6]), np.array([0.0, 1, 0, 1, 0, 1])
    places, values = isotonic(x, y)
    assert (np.diff(values) > 0).all() and (np.diff(places) > 0).all()
    assert np.allclose(values, [0, 0.5, 1]) and np.allclose(places, [1, 3.5, 6])


def test_trees_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    t = Boosted(rounds=40).fit(x[:2000], y[:2000])
    assert ((t(x[2000:]) > 0) == y[2000:]).mean() > 0.97
    one = Boosted(rounds=3).fit(np.ones((50, 2)), np.array([0.0, 1] * 25))
    assert np.allclose(one(np.ones((2, 2))), 0, atol=1e-6)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_features_of_any_text(text):
    own = features(text, Lexicon({}))
    assert len(own) == len(NAMES) and np.isfinite(own).all()


def test_features():
    get = lambda t: dict(zip(NAMES, features(t, Lexicon({"=blorg": 5.0, "xyzz": 4.0}))))
    f = get("You are an idiot, xyzzying blorg! i.d.i.o.t m0ron stuuuupid")
    assert f["fixed_hits"] == np.log1p(1) and f["learnt_hits"] == np.log1p(2) and f["learnt_max"] == 5 and f["near_second"] > 0 and f["undone"] >= np.log1p(2)
    assert get("a clean line of words")["undone"] == 0 and get("")["log_words"] == 0 and get("!!!")["punctuation"] == 1


def test_lexicon_finds_beginnings():
    texts, labels = [f"lorem ipsum zorba{k} dolor" for k in "abcdefgh"] + ["lorem ipsum dolor sit"] * 40, [1] * 8 + [0] * 40
    counts = {}
    for t, y in zip(texts, labels):
        for p in entries(t):
            counts.setdefault(p, np.zeros((1, 2), int))[0, y] += 1
    found = lexicons(counts, np.array([[40, 8]]))
    assert found[0] == {} and "zorba" in found[1] and "lorem" not in found[1]


def slow_tree(tree, edges, x):
    """One tree's value of one text, node by node."""
    feature, split, value = tree
    k = 0
    while k < len(feature) and feature[k] >= 0:
        below = sum(e <= x[feature[k]] for e in edges[feature[k]])
        k = 2 * k + 1 + (below > split[k])
    return value[k]


def test_scores_equal_brute_force(spark):
    """What executors count and compute is what one process does over all texts; scores are those of trees walked node by node."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    df = docs.join(labels, "doc_id").select("text", "toxic").dropDuplicates()
    rows = df.collect()
    own = Toxicity(df.repartition(5), max_rows=None).scorer
    texts, y = [r.text for r in rows], np.array([r.toxic for r in rows])
    n, counts = np.zeros((3, 2), int), {}
    for t, label in zip(texts, y):
        n[fold_of(t, 3), label] += 1
        for p in entries(t):
            counts.setdefault(p, np.zeros((3, 2), int))[fold_of(t, 3), label] += 1
    assert own.learnt == lexicons(counts, n)[-1]
    assert np.allclose(own(texts), fit(texts, y)(texts))
    for t in texts[:40]:
        x = features(t, Lexicon(own.learnt))
        raw = own.trees.base + sum(slow_tree(tree, own.trees.edges, x) for tree in own.trees.trees)
        k = np.searchsorted(own.places, raw)
        lo, hi = max(0, k - 1), min(k, len(own.places) - 1)
        part = 0 if own.places[hi] == own.places[lo] else (raw - own.places[lo]) / (own.places[hi] - own.places[lo])
        want = own.values[lo] + min(1, max(0, part)) * (own.values[hi] - own.values[lo])
        assert abs(own([t])[0] - (0.98 * want + 0.02 / (1 + np.exp(-raw)))) < 1e-9


def test_few_labels():
    assert fit([], np.zeros(0, int))(["x"]).tolist() == [0.5]
    assert fit(["a", "b"], np.array([0, 0]))(["x", ""]).tolist() == [0, 0]
    assert isinstance(fit(["a", "b"], np.array([0, 1])), Scorer)


def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = {r.doc_id: r for r in report(docs, labels).collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for k, r in got.items())
    truth = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    pos, neg = [s for s, y in truth if y], [s for s, y in truth if not y]
    assert np.mean([a > b for a in pos for b in neg]) > 0.85


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, None, 0.5), (2, "", 1.0), (None, "x", 1.0), (4, "you idiot " * 30_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    got = report(docs, labels).collect()
    assert len(got) == 5 and all(r.score is not None for r in got)
    assert report(docs.limit(0), labels.limit(0)).count() == 0
