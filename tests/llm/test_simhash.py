import random
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lakeferry.llm.components import Forest, components
from lakeferry.llm.simhash import Plan, classes, fingerprint, grouped, links, number_of_partitions, report, thresholds, within

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def union(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbÉß \t\n\x0b\x1c\x85 .", max_size=60))
def test_fingerprint(text):
    assert fingerprint(text.encode()) == plain(text)


def values(n=400, seed=1):
    r = random.Random(seed)
    out = set()
    for _ in range(n // 8):
        x = r.getrandbits(64)
        for _ in range(8):
            out.add(x)
            for _ in range(r.choice([1, 2, 3, 4])):
                x ^= 1 << r.randrange(64)
    hot = r.getrandbits(64)
    out |= {hot ^ (1 << i) ^ (1 << j) for i, j in combinations(range(20), 2)}
    return sorted(out)


@pytest.mark.parametrize("partitions,block", [(4, 4096), (4, 5), (3, 7), (2, 4096)])
def test_links_connect_what_brute_force_does(spark, partitions, block):
    v = values()
    signed = [int(np.uint64(x).astype(np.int64)) for x in v]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    got = [(r.a, r.b) for r in links(df, 3, block, partitions).collect()]
    near = [(signed[i], signed[j]) for i, j in combinations(range(len(v)), 2) if bin(v[i] ^ v[j]).count("1") <= 3]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") >= 1 for a, b in got)
    assert union(signed, got) == union(signed, near)


def test_thresholds_add_up_and_cost_least():
    r = np.random.default_rng(2)
    widths, d = [3, 3, 2], 3
    est = [r.random((50, d + 1)).cumsum(axis=1) * 50 for _ in widths]
    t = thresholds(est, widths, d)
    assert ((t + 1).sum(axis=1) == d + 1).all()
    from itertools import product
    from math import comb

    for k in range(50):
        cost = lambda own: sum(0 if x < 0 else est[i][k, x] + sum(comb(widths[i], e) for e in range(x + 1)) for i, x in enumerate(own))  # noqa: B023, E731
        best = min(cost(own) for own in product(range(-1, d + 1), repeat=3) if sum(x + 1 for x in own) == d + 1)
        assert abs(cost(t[k]) - best) < 1e-6 * max(1, best)


def test_estimates_are_exact_for_narrow_partitions():
    r = np.random.default_rng(3)
    h = r.integers(0, 9, 64)
    got = within(h, 6, 3)
    for v in range(64):
        for t in range(4):
            assert got[v, t] == sum(h[w] for w in range(64) if bin(v ^ w).count("1") <= t)


def test_correlated_bits_share_a_partition():
    r = np.random.default_rng(4)
    bits = r.integers(0, 2, (4000, 64))
    bits[:, 40] = bits[:, 3]
    bits[:, 60] = 1 - bits[:, 17]
    groups = grouped((bits.T @ bits).astype(float), bits.sum(axis=0).astype(float), 4000, 4)
    assert sorted(b for g in groups for b in g) == list(range(64)) and {len(g) for g in groups} == {16}
    assert any({3, 40} <= set(g) for g in groups) and any({17, 60} <= set(g) for g in groups)
    assert number_of_partitions(1000, 3) == 4 and number_of_partitions(10**12, 3) == 2
    assert Plan(groups, [np.ones(1 << 16)] * 4, 3, 9).blocks[0].max() == 1


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1))
def test_forest(pairs):
    f, nodes = Forest(31), range(31)
    for k in range(0, len(pairs), 3):
        a, b = map(np.array, zip(*pairs[k : k + 3]))
        f.join(a, b)
    u, v = f.edges()
    assert union(nodes, zip(u.tolist(), v.tolist())) == union(nodes, pairs) and dict(enumerate(f.root.tolist())) == union(nodes, pairs)


def test_components(spark):
    r = random.Random(6)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(r.randrange(100, 300), r.randrange(100, 300)) for _ in range(120)] + [(500, k) for k in range(501, 600)] + [(7, 7), (900, 900)]
    df = spark.createDataFrame([*pairs, *pairs[:5], (None, 3)], "a long, b long")
    got = {x.node: x.root for x in components(df).collect()}
    nodes = {n for p in pairs for n in p if p[0] != p[1]}
    assert got == union(nodes, [p for p in pairs if p[0] != p[1]])
    assert components(df.limit(0)).count() == 0


def test_rows(spark):
    base = "one two three four five six seven eight nine ten " * 30
    rows = [(5, base, 1), (3, base.upper(), 1), (9, base + "end", 1), (9, base + "end", 1), (1, None, 1), (2, "", None), (4, "ab", 1), (None, base, 1), (8, "x y " * 60_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(report(df).collect(), key=str)
    assert len(got) == len(rows)
    own = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    want = {k: plain(t) for k, t, _ in rows}
    for k, t, _ in rows:
        assert (k, f"{plain(t):016x}") in own
    assert own[1, "0" * 16] == own[2, "0" * 16] == 1
    assert own[5, f"{want[5]:016x}"] == own[3, f"{want[3]:016x}"] == own[None, f"{want[None]:016x}"] == 3
    assert classes(df.limit(0)).count() == 0


def test_a_star_of_many_edges(spark):
    """The least neighbours are joined as a table of their own: no aggregate stands below the join that a hot node's edges take."""
    n = 100_000
    edges = spark.range(1, n).select((F.lit(n) - F.col("id")).alias("a"), F.lit(n + 1).alias("b")).repartition(4)
    got = components(edges)
    assert got.where("root <> 1").count() == 0 and got.count() == n
