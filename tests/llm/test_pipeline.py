import hashlib
import re

import public_tokenizers
import tiktoken
from test_bpe import RANKS
from test_decontam import brute
from test_similar import components_of

import corpus_pipeline
from lakeferry.llm.pii import find
from lakeferry.llm.queries import PII_KEY

DATA = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    some = docs.limit(3).collect()
    long_copy = docs.orderBy("doc_id").first().text
    extra = spark.createDataFrame(
        [(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "1234 !!", None, "s", 7), (9004, long_copy, "en", "s", 1), (9005, "Write to me at a.b@mail.example.com, the thing is that", "en", None, None)],
        docs.schema,
    )
    docs = docs.union(extra)
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["language_id"](spark, docs, DATA).cache()
    assert kept.columns == docs.columns
    before, now = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in kept.collect()}
    assert not {9001, 9002, 9003} & set(now) and len(now) >= len(before) - 3 - 0.01 * len(before) and all(before[k] == t for k, t in now.items())

    unique = steps["near_duplicates"](spark, kept, DATA).cache()
    rows = sorted(now.items())
    assert sorted(repr((r.doc_id, r.text)) for r in unique.collect()) == components_of(rows) and unique.columns == docs.columns

    clean = steps["decontamination"](spark, unique, DATA).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = brute([(r.doc_id, r.text) for r in unique.collect()], items)
    got = {r.doc_id: r.text for r in clean.collect()}
    assert set(got) == {k for k, w in want.items() if not w[4]} and clean.columns == docs.columns
    assert all((got[k] == now[k]) == (want[k][1] == 0) for k in got)
    assert all(w[1] == 0 for w in brute([(k, t) for k, t in got.items() if want[k][1]], items).values())

    private = steps["private_data"](spark, clean, DATA).cache()
    swapped = {r.doc_id: r.text for r in private.collect()}
    assert private.columns == docs.columns and set(swapped) == set(got)
    for k, t in got.items():
        found = find(PII_KEY, t)
        assert (swapped[k] == t) == (not found)
        assert not any(t[a:b] in re.split(r"[\s,]+", swapped[k]) for a, b, kind, _ in found if kind in ("email", "card"))

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    out = {r.doc_id: r for r in steps["tokens"](spark, private, DATA).collect()}
    assert set(out) == set(swapped)
    for k, t in swapped.items():
        ids = own.encode_ordinary(t)
        assert out[k].n_tokens == len(ids) and out[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert out[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert some


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() <= 200


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0


def test_stages_on_odd_rows(spark):
    """Repeated rows, null and repeated ids, a very long text, and columns with the names that stages use."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("lang = 'en'").limit(12)
    schema = "doc_id long, text string, lang string, source string, n_chars long, number int, found string, row int, fp string"
    base = [tuple(r) for r in docs.collect()]
    long_text = " ".join(base[0][1].split()[:50]) + " " + "the house and the garden of a friend " * 20_000
    rows = [(*r, 1, "f", 2, "x") for r in [*base, *base[:3], (None, base[4][1] + " and so on and on", "en", None, None), (None, base[5][1], "en", "s", 1), (base[6][0], base[7][1] * 2, "en", "s", 1), (77, long_text, "en", "s", 1), (78, long_text, "en", "s", 1)]]
    df = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, df, DATA).cache()
        assert out.columns == df.columns
        if name == "language_id":
            assert out.count() == len(rows)
        if name == "near_duplicates":
            want = components_of(list(enumerate(r.text for r in df.collect())))
            assert out.count() == len(want) and out.where("doc_id = 77").count() == 1 and out.where("doc_id = 78").count() == 0
        df = out
    assert corpus_pipeline.STAGES[4][1](spark, df, DATA).count() == df.count()
