import random
import zlib
from collections import defaultdict
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeferry.llm.sharding import karmarkar_karp, shard_rows


def test_differencing_by_hand():
    assert karmarkar_karp([], 3) == []
    shard = karmarkar_karp([8, 7, 6, 5, 4], 2)  # differences 1, 1, 4 -> 4, 0... the textbook case: 16 and 14
    sums = [sum(n for n, s in zip([8, 7, 6, 5, 4], shard) if s == k) for k in range(2)]
    assert sorted(sums) == [14, 16]


def plain(sizes, shards):
    """Differencing with partial partitions written out: lists of (sum, items), the two of the largest spread combined until one is left."""
    own = [(n, k, [(0, []) for _ in range(shards - 1)] + [(n, [k])]) for k, n in enumerate(sizes)]
    new = len(sizes)
    while len(own) > 1:
        own.sort(key=lambda x: (-x[0], x[1]))
        (_, _, a), (_, _, b), *rest = own
        both = sorted([(x + y, i + j) for (x, i), (y, j) in zip(a, reversed(b))], key=lambda x: x[0])
        own = [*rest, (both[-1][0] - both[0][0], new, both)]
        new += 1
    return own[0][2] if own else []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=40), st.integers(2, 6))
def test_differencing_equals_brute_force(sizes, shards):
    shard = karmarkar_karp(sizes, shards)
    sums = sorted(sum(n for n, s in zip(sizes, shard) if s == k) for k in range(shards))
    assert len(shard) == len(sizes) and sums == (sorted(n for n, _ in plain(sizes, shards)) if sizes else [0] * shards)


def test_near_the_best_partition():
    r = random.Random(1)
    for _ in range(30):
        sizes = [r.randrange(1, 40) for _ in range(8)]
        most = lambda own: max(sum(n for n, s in zip(sizes, own) if s == k) for k in range(3))  # noqa: B023, E731
        assert most(karmarkar_karp(sizes, 3)) <= 4 / 3 * min(map(most, product(range(3), repeat=8)))


def test_differencing_is_tight():
    sizes = [(k * 7919) % 1000 + 1 for k in range(3000)]
    shard = karmarkar_karp(sizes, 16)
    sums = [0] * 16
    for n, s in zip(sizes, shard):
        sums[s] += n
    assert max(sums) - min(sums) <= 2 and set(shard) == set(range(16))


@pytest.mark.parametrize("parts", [4, 8192])
def test_rows(spark, parts):
    texts = [f"text {k % 90} " + "é" * (k % 37) * (k % 5) for k in range(600)] + ["hot"] * 300 + [None, None, "", "x" * 50_000]
    rows = [(k, t, "z") for k, t in enumerate(texts)] + [(5, texts[5], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = shard_rows(df, shards=16, parts=parts).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    by_text, slots, text_of = defaultdict(set), defaultdict(list), dict((k, t) for k, t, _ in rows)
    for r in got:
        t = text_of[r.doc_id]
        assert r["size"] == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode())
        by_text[t].add(r.shard)
        slots[r.shard].append((r.slot, r.doc_id))
    assert all(len(x) == 1 for x in by_text.values())
    for own in slots.values():
        own.sort()
        assert [s for s, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)


def test_null_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "a", "x", 1), (None, "a", "x", 1), (3, None, None, 2), (1, "b", "y", None)], "doc_id long, text string, slot string, size int")
    got = shard_rows(df, shards=2).collect()
    assert len(got) == 4 and len({r.shard for r in got if r.doc_id is None}) == 1
    for k in (0, 1):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_empty(spark):
    assert shard_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0
