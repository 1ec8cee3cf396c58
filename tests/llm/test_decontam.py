import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lakeferry.llm.decontam import Decontaminator, report

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, n=8):
    out = {}
    for k, text in docs:
        own, hit, ids = split(text), set(), set()
        for item, t in items:
            w = split(t)
            if item is None or not w:
                continue
            for g in {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}:
                for i in range(len(own) - len(g) + 1):
                    if tuple(own[i : i + len(g)]) == g:
                        hit.update(range(i, i + len(g)))
                        ids.add(str(item))
        out[k] = (len(own), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(ids) >= 2)
    return out


def data():
    r = random.Random(5)
    vocabulary = ["the", "of", "Ünd", "ñandú", "x1", "a", "q", "zeta", "Ipsum", "dolor"]
    items = [(k, " ".join(r.choices(vocabulary, k=r.choice([1, 3, 8, 9, 20])) + ["it%d" % k])) for k in range(30)] + [(3, "of the"), (7, None), (None, "the of"), (8, "?!")]
    docs = [(k, " ".join(r.choices(vocabulary, k=r.randrange(60)))) for k in range(60)]
    docs += [(100 + k, f"Pre, {t}! post; " + str(t).upper().replace(" ", " -- ")) for k, (_, t) in enumerate(items)] + [(200, None), (201, ""), (202, "the of " * 20_000 + items[4][1] + " " + items[5][1])]
    return docs, items


def test_equals_brute_force_by_both_ways(spark):
    docs, items = data()
    rows = [(k, t, "x") for k, t in docs]
    d = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute([x for x in docs if x[0] != 202], items)
    for limit in (64_000_000, 10):
        clean = Decontaminator(b, max_broadcast=limit)
        assert (clean.sent is None) == (limit == 10)
        got = report(d, clean).collect()
        assert len(got) == len(rows) + 3
        for r in got:
            if r.doc_id != 202:
                assert tuple(r)[1:] == want[r.doc_id], r
            else:
                assert r.n_words == 40_000 + len(split(items[4][1])) + len(split(items[5][1])) and r.contaminated


def test_the_filter_lets_members_pass_and_hardly_any_others(spark):
    b = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(12))) for k in range(400)], "item_id long, text string")
    f = Decontaminator(b, max_broadcast=10).filter.value
    assert f.has([" ".join(f"w{k}x{i}" for i in range(a, a + 8)).encode() for k in range(400) for a in range(5)]).all()
    assert f.has([b"other%d" % k for k in range(20_000)]).mean() < 0.03


def test_a_column_is_not_replaced(spark):
    d = spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, found int")
    with pytest.raises(ValueError, match="'found'"):
        Decontaminator(d.select(F.col("doc_id").alias("item_id"), "text")).annotate(d)


@pytest.mark.parametrize("limit", [64_000_000, 10])
def test_actions(spark, limit):
    text = "alpha beta gamma delta epsilon zeta eta theta iota"
    b = spark.createDataFrame([(1, text), (2, "one two three four five six seven eight"), (3, "the")], "item_id long, text string")
    docs = [(1, f"Start {text.upper()}, end of the doc.", "x"), (2, f"{text} one two three four five six seven eight", "x"), (3, "clean, the text", "x"), (4, None, "x"), (5, text, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, found string")
    clean = Decontaminator(b, max_broadcast=limit)
    both = {r.doc_id: r.text for r in clean.clean(d).collect()}
    assert both == {3: "clean, the text", 4: None, 5: ""}  # 1 has a window of items 1 and 3, 2 of items 1 and 2
    assert {r.doc_id: r.text for r in clean.clean(d, action="spans").collect()}[1] == "Start , end of the doc."
    assert clean.clean(d, action="spans").count() == 5 and clean.clean(d, action="spans").columns == d.columns
    assert {r.doc_id for r in clean.clean(d, action="documents").collect()} == set(both)
    assert report(d.limit(0), clean).count() == 0
    assert {r.n_items for r in report(d, Decontaminator(b.limit(0))).collect()} == {0}
