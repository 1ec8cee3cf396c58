import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeferry.llm.quality import META_WIDTH, STEPS, TEXT_WIDTH, Fitter, Logistic, Quality, features, meta_view, platt, pseudo, report, sure_from, text_view

DATA = "/root/testdata/sf0.1"


@settings(max_examples=200, deadline=None)
@given(st.text(), st.none() | st.text(), st.none() | st.integers(-9, 10**9))
def test_views_of_any_row(text, source, n):
    assert np.isfinite(text_view(text)).all() and np.isfinite(meta_view(source, None, n)).all()
    assert text_view(text).shape == (TEXT_WIDTH,) and meta_view(source, "x", n).shape == (META_WIDTH,)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(-29.9, 29.9), min_size=1, max_size=50), st.floats(0, 1), st.sampled_from([1, -1]))
def test_thresholds(odds, share, sign):
    """The lowest bound, of steps, that no more than the share reaches, but 1 at least."""
    odds = np.array(odds)
    steps = ((odds + 30) * STEPS).astype(int)
    got = sure_from(np.bincount(steps, minlength=60 * STEPS + 1), share, sign)
    most = share * len(odds)
    edge = 0 if sign < 0 else 60 * STEPS + 1
    while 0 <= edge - sign <= 60 * STEPS + 1 and ((steps >= edge - sign).sum() if sign > 0 else (steps < edge - sign).sum()) <= most:
        edge -= sign
    assert got == max(1.0, sign * (edge / STEPS - 30))


def brute(a, b, label, rounds, share):
    """Co-training in one process, all rows at hand, with the parts that the operator fits by."""
    known = label >= 0
    order = sorted(np.flatnonzero(known), key=lambda i: (__import__("zlib").crc32(a[i].astype(np.float16).tobytes() + b[i].astype(np.float16).tobytes()), a[i].astype(np.float16).tobytes(), b[i].astype(np.float16).tobytes(), label[i]))
    f = Fitter((a[order], b[order]), label[order].astype(float))
    for n in range(1, rounds + 1):
        odds = np.stack([f.own[0](a), f.own[1](b)], axis=1)
        limits = []
        for k in (0, 1):
            c = np.bincount(((odds[:, k] + 30) * STEPS).astype(int), minlength=60 * STEPS + 1)
            limits.append((sure_from(c, share * n * f.good, 1), sure_from(c, share * n * (1 - f.good), -1)))
        y = [pseudo(odds, limits[k], k) for k in (0, 1)]
        free = ~known
        f.learn([((a, b)[k][free & (y[1 - k] >= 0)], y[1 - k][free & (y[1 - k] >= 0)].astype(float)) for k in (0, 1)])
    return f.done()(a, b)


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text", "source", "lang", "n_chars"])
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = features(docs.join(labels, "doc_id", "left"), "doc_id", "quality").collect()
    a, b = (np.stack([np.frombuffer(r[k], np.float16).astype(float) for r in rows]) for k in ("a", "b"))
    label = np.array([-1 if r.quality is None else r.quality for r in rows])
    want = brute(a, b, label, 2, 0.08)
    got = {r.doc_id: r for r in report(docs, labels, max_labelled=10**6, max_taught=10**6, rounds=2).collect()}
    for name, scores in zip(("text_score", "meta_score", "score"), want):
        assert np.allclose([got[r.doc_id][name] for r in rows], scores, atol=1e-3)


def test_cotraining_uses_the_pool(spark):
    r = np.random.default_rng(0)

    def make(n, first):
        y = (r.random(n) < 0.6).astype(int)
        a, b = np.zeros((n, TEXT_WIDTH)), np.zeros((n, META_WIDTH))
        a[:, :6] = r.normal(size=(n, 6)) + y[:, None] * 1.2
        b[:, :5] = r.normal(size=(n, 5)) + y[:, None]
        return a, b, y, [(first + k, bytearray(x.astype(np.float16).tobytes()), bytearray(z.astype(np.float16).tobytes()), int(v)) for k, (x, z, v) in enumerate(zip(a, b, y))]

    labelled, pool, test = make(60, 0)[3], make(3000, 1000)[3], make(3000, 10_000)
    frame = lambda rows: spark.createDataFrame(rows, "id long, a binary, b binary, label int").repartition(3)
    auc = lambda s: np.mean(s[test[2] == 1][:, None] > s[test[2] == 0][None, :])
    ids = frame(labelled).select("id")
    alone, both = (Quality(frame(labelled), frame(labelled + pool).drop("label"), ids, rounds=n).model(test[0], test[1]) for n in (0, 4))
    assert auc(both[2]) > 0.96 and auc(both[2]) >= auc(alone[2]) - 0.005
    assert auc(both[2]) >= max(auc(both[0]), auc(both[1])) - 0.01


def test_logistic_and_platt():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 3))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))
    y = (r.random(2000) < p).astype(float)
    w = platt(x, y)
    assert abs(w[0] - 2) < 0.4 and abs(w[3] + 1) < 0.3
    assert ((Logistic().fit(x, y)(x) > 0) == (p > 0.5)).mean() > 0.6


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = {r.doc_id: r for r in report(docs, labels.where("doc_id % 3 <> 0")).collect()}
    assert len(got) == docs.count()
    truth = [(got[r.doc_id], r.quality) for r in labels.where("doc_id % 3 = 0").collect()]
    good, bad = np.array([r.score for r, y in truth if y]), np.array([r.score for r, y in truth if not y])
    assert np.mean(good[:, None] > bad[None, :]) > 0.85
    assert np.mean([r.kept == bool(y) for r, y in truth]) > 0.9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, 1.0), (1, None, None, None, None, 1.0), (2, "", "s", "en", 0, 1.0), (3, "w " * 90_000, "s", "en", -5, 1.0), (None, "a", "b", "c", 1, 2.0)], "doc_id long, text string, source string, lang string, n_chars long, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, quality int")
    got = report(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert report(docs.limit(0), labels.limit(0)).count() == 0
