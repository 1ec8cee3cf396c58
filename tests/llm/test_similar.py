import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_simhash import union

from lakeferry.llm import similar
from lakeferry.llm.similar import BITS, CHOICES, Plan, allotted, bits_between, bounds, chances, fingerprint, forest, jaccard, keys, linked, near, near_deduplicated, number_of_partitions, shingles, sketch, sparse

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text, size=5):
    w = (text or "").translate(LOWER).split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def edited(r, words, n):
    own = list(words)
    for _ in range(n):
        own[r.randrange(len(own))] = f"new{r.randrange(10**9)}"
    return own


def corpus(seed=1):
    r = random.Random(seed)
    texts = []
    for _ in range(60):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([30, 80, 200, 500]))]
        texts.append(" ".join(base))
        for _ in range(r.randrange(4)):
            texts.append(" ".join(edited(r, base, r.choice([0, 1, 2, len(base) // 60, len(base) // 20]))))
    hot = [f"h{k}" for k in range(150)]
    texts += [" ".join(edited(r, hot, 1)).upper() for _ in range(60)] + [" ".join(hot)] * 30
    return texts


def components_of(rows):
    sets = [plain(t) for _, t in rows]
    root = union(range(len(rows)), [(i, j) for i, j in combinations(range(len(rows)), 2) if alike(sets[i], sets[j]) >= 0.8])
    best = {}
    for i, (k, _) in enumerate(rows):
        best.setdefault(root[i], []).append((k is None, k if k is not None else 0, i))
    return sorted(repr(rows[min(own)[2]]) for own in best.values())


@pytest.mark.parametrize("block,partitions", [(4096, None), (7, None), (4096, 4)])
def test_equals_brute_force(spark, block, partitions):
    """Pairs well below or above the threshold; that all of those just at it meet is a matter of chance, see test_recall."""
    texts = corpus()
    rows = list(enumerate(texts))
    random.Random(2).shuffle(rows)
    rows += [(None, None), (None, ""), (5000, "a b"), (5001, "A  B"), (5002, "a c"), (5003, "x y " * 30_000), (5004, "X y " * 30_000)]
    df = spark.createDataFrame([(*x, 1, "z") for x in rows], "doc_id long, text string, number int, fp string").repartition(5)
    got = near_deduplicated(df, block=block, partitions=partitions)
    assert got.columns == df.columns
    own, want = sorted(repr((r.doc_id, r.text or None)) for r in got.collect()), [x.replace("''", "None") for x in components_of(rows)]
    assert set(want) <= set(own) and len(own) - len(want) <= (0 if partitions is None else 3)


def test_ids_that_repeat_or_are_null_lose_no_component(spark):
    texts = [" ".join(f"{w}{k * k}" for k in range(40)) for w in ("red", "green", "blue", "black", "white", "brown")]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[3]), (None, texts[5]), (8, texts[5]), (3, texts[5]), (None, texts[0])]
    for few in (1_000_000, 0):
        got = near_deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), max_broadcast=few).collect()
        want = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (3, texts[5])]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    df = spark.createDataFrame(rows, "doc_id long, text string").limit(0)
    assert near_deduplicated(df).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aAbÉß \t\n", max_size=60), st.text(alphabet="aAbÉß \t\n", max_size=60))
def test_similarity(a, b):
    x, y = (shingles(t.encode(), 2, 42) for t in (a, b))
    assert len(x) == len(plain(a, 2)) and jaccard(sketch(x), sketch(y)) == alike(plain(a, 2), plain(b, 2))


def pairs(similarity, n=400, size=300):
    r = np.random.default_rng(3)
    both = round(size * 2 * similarity / (1 + similarity))
    out = []
    for _ in range(n):
        h = r.integers(0, 1 << 63, 2 * size - both).astype(np.uint64)
        out.append((np.sort(h[:size]), np.sort(h[size - both :])))
    return out


def packed(prints):
    return tuple(np.frombuffer(b"".join(p[k] for p in prints), np.uint8).reshape(len(prints), -1) for k in (0, 1))


@pytest.mark.parametrize("n", [10**4, 10**6, 10**9])
def test_recall(n):
    """Pairs just at the similarity, under the allotment for n fingerprints."""
    found = pairs(0.8)
    a, b = (packed([fingerprint(p[k]) for p in found]) for k in (0, 1))
    m = number_of_partitions(n)
    groups = [list(range(k * BITS // m, (k + 1) * BITS // m)) for k in range(m)]
    plan = Plan(groups, [np.full(1 << min(16, len(g)), n * 32 / (1 << min(16, len(g)))) for g in groups], n, 0.8, 0.97, 10**12)
    met = np.zeros(len(found), bool)
    for g, many in zip(groups, plan.many):
        if many:
            x, y = keys(*a, g)[:, :many], keys(*b, g)[:, :many]
            met |= (x[:, :, None] == y[:, None, :]).any(axis=(1, 2))
    far = np.bitwise_count(a[0] ^ b[0]).sum(axis=1)
    sure, most = bounds(0.8)
    assert abs(far.mean() / BITS - bits_between(0.8)) < 0.01 and (far <= most).mean() > 0.96 and (far <= sure).mean() < 0.05
    assert met.mean() >= 0.94


def test_allotment_costs_least():
    r = np.random.default_rng(4)
    for _ in range(20):
        gains = [np.concatenate([[0], np.sort(r.integers(0, 20, len(CHOICES) - 1))]) for _ in range(3)]
        costs = [[0.0, *np.cumsum(r.random(len(CHOICES) - 1)).tolist()] for _ in range(3)]
        got = [CHOICES.index(c) for c in allotted(gains, costs, 25)]
        need = min(25, sum(int(g[-1]) for g in gains))
        cost = lambda own: sum(c[k] for c, k in zip(costs, own))  # noqa: B023, E731
        best = min(cost(own) for own in np.ndindex(*(len(CHOICES),) * 3) if sum(int(g[k]) for g, k in zip(gains, own)) >= need)
        assert sum(int(g[k]) for g, k in zip(gains, got)) >= need and abs(cost(got) - best) < 1e-9
    assert (np.diff(chances(20, 0.8)) > 0).all() and chances(20, 0.9)[4] > chances(20, 0.8)[4]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20), st.integers(0, 5)), max_size=60))
def test_forest(edges):
    edges = [e for e in edges if e[0] != e[1]]
    u, v, h = (np.array([e[k] for e in edges], np.int64) for k in range(3))
    kept = forest(21, u, v, h)
    for most in range(6):
        some = lambda own: [(a, b) for a, b, c in own if c <= most]  # noqa: B023, E731
        assert union(range(21), some([edges[k] for k in kept])) == union(range(21), some(edges))
    assert len(kept) == 21 - len(set(union(range(21), [e[:2] for e in edges]).values()))


def test_a_large_group_leaves_as_a_few_forests():
    r = np.random.default_rng(6)
    n = 300
    u, v = np.stack(np.triu_indices(n, 1))[:, r.permutation(n * (n - 1) // 2)]
    h = r.integers(12, 29, len(u))
    h[(u < 200) & (v < 200)] = 5  # linked for sure
    kept = sparse(np.zeros(n, int), u, v, h, 11)
    close = kept[h[kept] <= 11]
    assert union(range(n), zip(u[close], v[close])) == union(range(n), zip(u[h <= 11], v[h <= 11]))
    assert not ((h[kept] > 11) & (u[kept] < 200) & (v[kept] < 200)).any() and n < len(kept) <= 3 * n
    few = np.flatnonzero((u < 40) & (v < 40))[: 2 * n]
    assert len(sparse(np.zeros(n, int), u[few], v[few], np.full(len(few), 20), 11)) == len(few)


def test_pairs_of_cells():
    r = np.random.default_rng(5)
    x = r.integers(0, 1 << 63, (40, 2)).astype(np.uint64)
    x[20:] = x[:20] ^ np.uint64(3 << 62)  # the highest bit too
    cell, node = np.repeat([1, 2], 40), np.concatenate([r.permutation(40)] * 2)
    u, v, h = near(cell, x[node], node, 0, 5)
    assert sorted((min(a, b), max(a, b)) for a, b in zip(node[u], node[v])) == sorted([(k, k + 20) for k in range(20)] * 2) and set(h) == {4}


def test_linked_equals_all_pairs():
    r = np.random.default_rng(7)
    for trial in range(40):
        base = r.integers(0, 1 << 32, 60).astype(np.uint32)
        sets = [np.unique(np.concatenate([r.choice(base, r.integers(45, 60), replace=False), r.integers(0, 1 << 32, r.integers(0, 8)).astype(np.uint32)])) for _ in range(30)]
        root, block = r.integers(0, 30, 30) if trial % 2 else np.minimum(3, r.integers(0, 30, 30)), np.zeros(30, np.int64) if trial % 4 < 2 else r.integers(0, 2, 30)
        two = block.min() != block.max()
        old = [(k, int(np.flatnonzero(root == root[k])[0])) for k in range(30)]
        u, v = linked(sets, root, block, 0.8)
        asked = lambda a, b: not two or block[a] != block[b]  # noqa: B023, E731
        want = [(a, b) for a, b in combinations(range(30), 2) if asked(a, b) and jaccard(sets[a].tobytes(), sets[b].tobytes()) >= 0.8]
        assert all(asked(a, b) and jaccard(sets[a].tobytes(), sets[b].tobytes()) >= 0.8 for a, b in zip(u, v))
        assert union(range(30), [*old, *zip(u, v)]) == union(range(30), [*old, *want]) and len(u) < 30


@pytest.mark.parametrize("hashes,block", [(1 << 19, 4096), (4000, 4096), (1 << 19, 60)])
def test_links_in_a_crowded_cell(spark, monkeypatch, hashes, block):
    """Variants of one text, most of them just below the threshold: the links among them are not those of the least distances."""
    monkeypatch.setattr(similar, "HASHES", hashes)
    r = random.Random(13)
    base = [f"b{k}" for k in range(400)]
    rows = [(k, " ".join(edited(r, base, r.choice([5, 6, 8, 9])))) for k in range(150)]
    sets = [plain(t) for _, t in rows]
    prints = packed([fingerprint(shingles(t.encode(), 5, 42)) for _, t in rows])[0]
    sure = lambda a, b: np.bitwise_count(prints[a] ^ prints[b]).sum() <= bounds(0.8)[0]
    root = union(range(150), [(a, b) for a, b in combinations(range(150), 2) if alike(sets[a], sets[b]) >= 0.8 or sure(a, b)])
    got = near_deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block=block)
    kept = sorted(x.doc_id for x in got.collect())
    assert kept == sorted(min(k for k in range(150) if root[k] == own) for own in set(root.values()))
