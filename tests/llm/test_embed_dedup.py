from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from lakeferry.llm import embed_dedup
from lakeferry.llm.embed_dedup import Lattice, decoded, neighbours, report


def test_decodes_to_the_nearest_point():
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 8)) * 2
    got = decoded(x) / 2
    far = ((x - got) ** 2).sum(axis=1)
    assert (far <= 1 + 1e-9).all()  # the covering radius
    for k in range(240):
        assert (((x - got - neighbours()[k] / 2) ** 2).sum(axis=1) >= far - 1e-9).all()
    assert len(np.unique(neighbours(), axis=0)) == 240 and {int(n) for n in (neighbours() ** 2).sum(axis=1)} == {8}


@pytest.mark.parametrize("own", [Lattice.suited(10**k) for k in (4, 6, 9)])
def test_recall_at_the_threshold(own):
    r = np.random.default_rng(2)
    a = r.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    met = np.zeros(len(a), bool)
    for t in range(own.tables):
        p, q = own.cells(a, t), own.cells(b, t)
        met |= (p == q[:, :1]).any(axis=1) | (q == p[:, :1]).any(axis=1)
    assert met.mean() >= 0.999


def data():
    r = np.random.default_rng(3)
    rows = []
    for _ in range(30):
        v = r.normal(size=16)
        for _ in range(r.integers(1, 12)):
            rows.append((v + r.normal(size=16) * r.choice([0, 0.05, 0.15, 0.25]), int(r.integers(0, 3))))
    hot = r.normal(size=16)
    rows += [(hot + r.normal(size=16) * 0.02, 1) for _ in range(60)] + [(hot, 1)] * 9
    rows = [(k, v.tolist(), label) for k, (v, label) in enumerate(rows)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, hot.tolist()]
    rows += [(1000 + k, v, 1 if k < 6 else None) for k, v in enumerate(odd)]
    rows += [(2000, (hot * 7).tolist(), 1), (2001, hot[:8].tolist(), 1), (2002, hot[:8].tolist(), 1)]
    return [rows[k] for k in r.permutation(len(rows))]


def brute(rows):
    good = [(k, np.array(v, float), label) for k, v, label in rows if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root, n = {k: k for k, _, _ in rows}, Counter()

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for (i, a, x), (j, b, y) in combinations(good, 2):
        if x == y and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
            n[i] += 1
            n[j] += 1
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return sorted((k, n[k], find(k), find(k) == k) for k in root)


@pytest.mark.parametrize("block", [2048, 6])
def test_equals_brute_force(spark, block):
    rows = data()
    df = spark.createDataFrame([(*x, "y") for x in rows], "vec_id long, embedding array<double>, label int, cls string")
    got = sorted(map(tuple, report(df, block=block).collect()))
    assert got == brute(rows)


def test_odd_tables(spark):
    df = spark.createDataFrame([(5, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (6, [2.0, 4.0], 1)], "vec_id long, embedding array<float>, label int")
    got = report(df).collect()
    assert {r.n_links for r in got} == {3} and {r.component_id for r in got} == {5} and len(got) == 4
    assert report(df.limit(0)).count() == 0


def test_very_large_and_small_numbers(spark):
    v = [1.0, 2.0, -3.0, 0.5]
    rows = [(k, [x * f for x in v], 1) for k, f in enumerate((1.0, 1e200, 1e-200, 1e300, 1e-310))] + [(9, [1e200, 0.0, 0.0, -1e200], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in report(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {**{k: (4, 0) for k in range(5)}, 9: (0, 9)}


def test_a_cell_that_many_probe_is_dealt_out(spark, monkeypatch):
    """Vectors around one centre: cells that few are filed in and very many probe. No cell of the join is larger than two blocks."""
    r = np.random.default_rng(4)
    centre = r.normal(size=16)
    x = centre + r.normal(size=(3000, 16)) * 0.12
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    block, sizes, joined = 100, [], embed_dedup._join

    def counted(lattice, threshold):
        run = joined(lattice, threshold)

        def both(rows):
            held = [b for b in rows]
            for b in held:
                cells.add(b.column("cell").to_pylist())
            yield from run(iter(held))

        return both

    cells = spark.sparkContext.accumulator([], type("Lists", (__import__("pyspark").AccumulatorParam,), {"zero": lambda self, v: [], "addInPlace": lambda self, a, b: a + b})())
    monkeypatch.setattr(embed_dedup, "_join", counted)
    got = {g.vec_id: (g.n_links, g.component_id) for g in report(df, block=block).collect()}
    sizes = Counter(cells.value)
    assert max(sizes.values()) <= 3 * block
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.93
    assert all(got[k][0] == linked[k].sum() - 1 for k in range(len(x)))
