import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from lakeferry.llm.langid import ORDER, LanguageID, folded, grams, grams_between, kneser_ney, order_statistics, report

DATA = "/root/testdata/sf0.01"


def plain(counts, alphabet):
    """Interpolated Kneser-Ney by its definition, over dictionaries."""
    tables, c = [], dict(counts)
    for order in range(ORDER, 0, -1):
        ones, twos = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        d = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
        total, types = Counter(), Counter()
        for g, n in c.items():
            total[g[:-1]] += n
            types[g[:-1]] += 1
        tables.append((c, d, total, types))
        lower = defaultdict(int)
        for g in c:
            lower[g[1:]] += 1
        c = lower

    def p(g):
        if not g:
            return 1 / alphabet
        c, d, total, types = tables[ORDER - len(g)]
        if g[:-1] not in total:
            return p(g[1:])
        return max(0, c.get(g, 0) - d) / total[g[:-1]] + d * types[g[:-1]] / total[g[:-1]] * p(g[1:])

    return p


def as_text(key):
    return "".join(chr(int(key) >> 16 * k & 0xFFFF) for k in range(ORDER - 1, -1, -1))


def test_equals_the_definition():
    texts = {"a": "the cat sat on the mat; the rat ate that", "b": "der Hund und die Katze, und der Bär"}
    counts = {k: Counter(map(as_text, grams(folded(t), ORDER))) for k, t in texts.items()}
    own = []
    for k in texts:
        keys, n = np.unique(grams(folded(texts[k]), ORDER), return_counts=True)
        own.append((keys, n))
    model = kneser_ney(list(texts), own)
    alphabet = len({g[-1] for c in counts.values() for g in c})
    probe = grams(folded("the bat und zzz katze ätt that"), ORDER)
    got = model.logs(probe)
    for j, k in enumerate(texts):
        p = plain(counts[k], alphabet)
        for row, key in zip(got, probe):
            assert math.isclose(row[j], math.log(p(as_text(key))), abs_tol=1e-4)
    for c in set(as_text(g)[:-1] for g in own[0][0]):  # a context's probabilities sum to one over the alphabet
        letters = sorted({g[-1] for cs in counts.values() for g in cs})
        assert math.isclose(sum(plain(counts["a"], alphabet)(c + x) for x in letters), 1, abs_tol=1e-9)


def test_folding():
    assert "".join(map(chr, folded("Ab--C 12 É"))) == " ab c é "
    assert len(folded("12 !?")) == 0 and len(folded("")) == 0 and len(folded("𝒜")) == 3
    c = folded("the cat sat on the mat " * 9)
    whole = grams(c, ORDER)
    assert [*grams_between(c, 0, 50), *grams_between(c, 50, 60), *grams_between(c, 60, len(c) - 1)] == [*whole]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in report(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sorted(k for k, r in got.items() if r.held_out) == sorted(held)
    assert np.mean([got[k].lang_pred == truth[k] for k in held]) > 0.98
    assert np.mean([got[k].rejected for k in truth]) < 0.01


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(200)
    model = LanguageID(docs)
    rows = [(1, None), (1, None), (2, ""), (3, "123 !!"), (4, "the thing is that " * 9000), (5, "漢字かな交じり文の例" * 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.p for r in d.select(model.predict(d.text).alias("p")).collect()]
    assert [(p.lang, p.score, p.rejected) for p in got[:4]] == [("und", 0.0, True)] * 4
    assert got[4].lang == "en" and got[4].score > 0.9 and not got[4].rejected and got[5].rejected
    empty = report(docs.limit(0))
    assert empty.count() == 0
    untrained = LanguageID(docs.limit(0))
    assert d.select(untrained.predict(d.text)["lang"]).distinct().collect()[0][0] == "und"
    extra = docs.limit(2).selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars", "'x' AS score", "1 AS rejected")
    clash = docs.selectExpr("*", "'x' AS score", "1 AS rejected").union(extra)
    found = report(clash)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"] and found.count() == 202 and found.where("doc_id IS NULL AND NOT held_out AND lang_pred <> 'und'").count() == 2
    assert LanguageID(docs, max_ngrams=3000).model.hashes[-1].size <= 3000


def test_rows_of_what_is_there_equal_rows_of_all_languages():
    texts = {"a": "the cat sat on the mat; the rat ate that", "b": "der Hund und die Katze, und der Bär", "c": "le chat et le rat"}
    counts = [np.unique(grams(folded(t), ORDER), return_counts=True) for t in texts.values()]
    probe = grams(folded("the bat und zzz katze ätt that le chat 漢字"), ORDER)
    full = kneser_ney(list(texts), counts, 10**9).logs(probe)
    for most in (0, 60, 150):
        assert np.allclose(kneser_ney(list(texts), counts, most).logs(probe), full, atol=1e-4)


def test_many_languages(spark):
    r = np.random.default_rng(8)
    # 70 languages of one alphabet, each with words of its own.
    words = {f"x{k:02d}": ["".join(r.choice(list("abcdefghijklmnopqrst"), 6)) for _ in range(12)] for k in range(70)}
    text = lambda k: " ".join(r.choice(words[k], 30))
    model = LanguageID(spark.createDataFrame([(text(k), k) for k in words for _ in range(4)], "text string, lang string"))
    assert model.model.languages == sorted(words)
    probe = spark.createDataFrame([(text(k), k) for k in words], "text string, lang string")
    assert all(x.lang == x.p.lang and not x.p.rejected for x in probe.select("lang", model.predict(probe.text).alias("p")).collect())


def test_small_languages_keep_their_ngrams(spark):
    r = np.random.default_rng(9)
    large = "".join(map(chr, r.integers(0x4E00, 0x9000, 1_600_000)))  # over 1,500,000 n-grams, of count 1 like those of the small one
    small = "ab cdef ghij klmn opqr stuv wxyz zyxw vuts rqpo nmlk jihg fedc"
    model = LanguageID(spark.createDataFrame([(large, "xx"), (small, "zz")], "text string, lang string")).model
    assert model.languages == ["xx", "zz"] and model.predict(["opqr stuv wxyz ab cdef zyxw vuts"])[0][0] == "zz"
    assert model.hashes[-1].size == len(np.unique(np.concatenate([grams(folded(t), ORDER) for t in (large, small)])))


def test_all_training_texts_calibrate(spark):
    """Against bounds and a regression by numpy over all texts, of which there are more than a driver was to see; a language of a
    few texts has bounds too."""
    r = np.random.default_rng(10)
    words = {k: ["".join(r.choice(list("abcdefgh"), 5)) for _ in range(40)] for k in ("xx", "yy", "zz")}
    rows = [(" ".join(r.choice(words[k], r.integers(1, 12))), k) for k, n in (("xx", 3500), ("yy", 1500), ("zz", 3)) for _ in range(n)]
    model = LanguageID(spark.createDataFrame([*rows, ("12", "xx"), (None, "yy"), ("abc", None)], "text string, lang string").repartition(5)).model
    codes = [folded(t)[: n + 1] for t, _ in rows for n in (8, 24, 96, 10**6)]
    want = np.repeat([model.languages.index(k) for _, k in rows], 4)
    entropy, length = model.entropies(codes)
    own = entropy[np.arange(len(want)), want]
    for k in range(3):
        mean = np.average(own[want == k], weights=length[want == k])
        most = np.quantile((own[want == k] - mean) * np.sqrt(length[want == k]), 0.999)
        assert np.allclose(model.typical[k], (mean + 0.8, 1.5 * max(0.5, most)), atol=1e-6)
    low = np.sort(entropy, axis=1)
    x, hit = (low[:, 1] - low[:, 0]) * np.sqrt(length), entropy.argmin(axis=1) == want
    p = 1 / (1 + np.exp(-np.clip(model.margin[0] * x + model.margin[1], -30, 30)))
    assert np.allclose([((p - hit) * x).sum() + 0.01 * model.margin[0], (p - hit).sum() + 0.01 * model.margin[1]], 0, atol=1e-3)  # the least of its loss


def test_order_statistics(spark):
    r = np.random.default_rng(11)
    own = {0: r.integers(-(1 << 45), 1 << 45, 3000), 1: r.integers(-2, 3, 500), 2: np.array([-1]), 3: (r.normal(size=2000) * (1 << 24)).astype(np.int64)}
    asked = {(k, rank) for k, v in own.items() for rank in {0, len(v) // 2, (len(v) - 1) * 999 // 1000, len(v) - 1}}
    values = spark.createDataFrame([(k, int(x)) for k, v in own.items() for x in v], "place int, value long")
    assert order_statistics(values, asked) == {(k, rank): int(np.sort(own[k])[rank]) for k, rank in asked}
