"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has 64 bits: bit k is 1 if it is set in over half of the XXH64 hashes of the text's word shingles. All
pairs of fingerprints that differ in up to `distance` bits are linked, and none else:

1. Equal fingerprints are one. Correlations between bits are counted over all of them, and bits that go together are put into
   one partition, so that a partition's values are as uneven as they can be.
2. How often each partition has each value is counted over all fingerprints (of a wide partition, by its first 16 bits).
   For each fingerprint a dynamic program allots thresholds t to the partitions, -1 meaning that one isn't probed, with the
   sum of t + 1 being distance + 1, so that the estimated number of probes and candidates is least. By the pigeonhole
   principle any fingerprint within `distance` lies within t of it in some partition.
3. Each fingerprint is filed under its value in each partition and probes all values within its thresholds. What meets there is
   verified on all 64 bits. A value with very many fingerprints is dealt out as blocks of them, each pair of blocks
   being a cell of its own; links that are found in a cell leave it as a spanning forest, not as pairs.
4. Components of the links; a component's id is the least id of its rows.

The number of partitions is what makes the estimate least for the number of fingerprints; results don't depend on it.

Null and empty texts have fingerprint 0, which is linked like any other. Rows that repeat are each returned. A null id is
ignored where a component's id is chosen, unless it has no other. An empty table gives no rows. Other columns are ignored.
Texts are hashed whole, in pieces of bounded length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lakeferry.llm.base import cut, keyed, narrow_batches, tidy, utf8
from lakeferry.llm.components import Forest, components

BITS = 64
#: Shingles that are hashed at once.
PIECE = 100_000
#: A histogram of a partition's values covers its first bits, up to so many.
COARSE = 16
#: Fingerprints of a block, where one value of a partition has more.
BLOCK = 4096
#: Rows that a task of the join works on at once, and pairs.
ROWS, PAIRS = 50_000, 1 << 18

_OF_BYTE = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """Lower-cases A-Z, takes words between ASCII white space and shingles of `size` words, repeats included."""
    own = text.lower().split()
    if not own:
        return 0
    if len(own) < size:
        own = [b" ".join(own)]
        size = 1
    n, ones = len(own) - size + 1, np.zeros(BITS, np.int64)
    for at in range(0, n, PIECE):
        end = min(at + PIECE, n)
        shingles = map(b" ".join, zip(*(own[at + k : end + k] for k in range(size)), strict=True)) if size > 1 else own
        h = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, end - at).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[8 * k : 8 * k + 8] += np.bincount(h[:, k], minlength=256) @ _OF_BYTE
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(text: Column, size: int = 3, seed: int = 42) -> Column:
    """long: the fingerprint's 64 bits of each text."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, size, seed) for t in utf8(texts)], np.uint64).view(np.int64))

    return of(text.cast("string"))


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


# Partitions and thresholds


def number_of_partitions(n: int, distance: int) -> int:
    """The one with the least probes and candidates, were bits independent."""

    def cost(m: int) -> float:
        width, spare = BITS / m, distance - m + 1
        t = [spare // m + (k < spare % m) for k in range(m)]
        return sum(sum(comb(int(width), e) for e in range(x + 1)) * (1 + n / 2**width) for x in t)

    return min(range(max(2, (distance + 1) // 2), distance + 2), key=cost)


def grouped(pairs: np.ndarray, ones: np.ndarray, n: int, m: int, bits: int = BITS) -> list[list[int]]:
    """m groups of bits, about equal in size. pairs: how often bits i and j are both 1; ones: how often bit i is."""
    p = ones / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    strength = np.abs((pairs / max(1, n) - np.outer(p, p)) / np.outer(spread, spread)).round(9)
    np.fill_diagonal(strength, 0)
    left, out = list(range(bits)), []
    for k in range(m):
        size = bits // m + (k < bits % m)
        first = max(left, key=lambda i: (strength[i, left].max(), -i))
        own = [first]
        while len(own) < size:
            own.append(max((i for i in left if i not in own), key=lambda i: (strength[i, own].sum(), -i)))
        left = [i for i in left if i not in own]
        out.append(sorted(own))
    return out


def projected(x: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value that these bits make up."""
    out = np.zeros(len(x), np.uint64)
    for k, b in enumerate(bits):
        out |= (x >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
    return out


def within(histogram: np.ndarray, width: int, distance: int) -> np.ndarray:
    """[value of the first bits, t]: the estimated number of fingerprints within t of the value, for t = 0 .. distance."""
    bits = len(histogram).bit_length() - 1
    exact = np.zeros((len(histogram), distance + 1))
    exact[:, 0] = histogram
    at = np.arange(len(histogram))
    for b in range(bits):
        near = exact[at ^ (1 << b)]
        exact[:, 1:] += near[:, :-1]
    rest = width - bits
    share = np.array([comb(rest, e) / 2.0**rest for e in range(distance + 1)])
    full = np.stack([(exact[:, : e + 1] * share[e::-1]).sum(axis=1) for e in range(distance + 1)], axis=1)
    return full.cumsum(axis=1)


def thresholds(estimates: list[np.ndarray], widths: list[int], distance: int) -> np.ndarray:
    """[fingerprint, partition]: the thresholds of least cost. estimates: for each partition [fingerprint, t]."""
    n, m, need = len(estimates[0]), len(widths), distance + 1
    best = np.full((n, need + 1), np.inf)
    best[:, 0] = 0
    took = np.zeros((m, n, need + 1), np.int8)
    for k, (estimate, width) in enumerate(zip(estimates, widths, strict=True)):
        new = best.copy()  # t = -1 takes nothing and costs nothing
        for t in range(distance + 1):
            cost = estimate[:, t] + sum(comb(width, e) for e in range(t + 1))
            for total in range(t + 1, need + 1):
                c = best[:, total - t - 1] + cost
                better = c < new[:, total]
                new[better, total] = c[better]
                took[k, better, total] = t + 1
        best = new
    out, left, rows = np.zeros((n, m), np.int8), np.full(n, need), np.arange(n)
    for k in reversed(range(m)):
        t = took[k, rows, left]
        out[:, k] = t - 1
        left = left - t
    return out


@lru_cache(64)
def ball(width: int, t: int) -> np.ndarray:
    """All values with up to t of the bits set."""
    return np.array([sum(1 << b for b in own) for e in range(t + 1) for own in combinations(range(width), e)], np.uint64)


def mixed(*parts: np.ndarray | int) -> np.ndarray:
    """One hash of numbers side by side. Two cells with one hash would share a place, and verification would part them."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p, np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ h >> np.uint64(29)
    return h


# The join


class Plan:
    """What a task needs to file and probe fingerprints. At most 4 x 2^16 numbers for each partition, whatever the corpus."""

    def __init__(self, groups: list[list[int]], histograms: list[np.ndarray], distance: int, block: int):
        self.groups, self.distance, self.block = groups, distance, block
        self.widths = [len(g) for g in groups]
        self.estimates = [within(h, w, distance).astype(np.float32) for h, w in zip(histograms, self.widths, strict=True)]
        # Blocks of a value: what it has beyond the share of values that are evenly frequent.
        self.blocks = [1 + (np.maximum(0, h - 4 * h.mean()) // block).astype(np.int64) for h in histograms]

    def rows(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """cell, fingerprint and role (1: filed there, 2: probes there, 3: both)."""
        values = [projected(x, g) for g in self.groups]
        coarse = [v & np.uint64((1 << min(w, COARSE)) - 1) for v, w in zip(values, self.widths, strict=True)]
        t = thresholds([e[c] for e, c in zip(self.estimates, coarse, strict=True)], self.widths, self.distance)
        for k, (v, w) in enumerate(zip(values, self.widths, strict=True)):
            yield from self._dealt(k, v, x, np.where(t[:, k] >= 0, 3, 1))
            for r in range(1, self.distance + 1):
                own = np.flatnonzero(t[:, k] == r)
                if len(own):
                    near = ball(w, r)[1:]
                    yield from self._dealt(k, (v[own][:, None] ^ near).ravel(), np.repeat(x[own], len(near)), np.full(len(own) * len(near), 2))

    def _dealt(self, k: int, v: np.ndarray, x: np.ndarray, role: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n = self.blocks[k][v & np.uint64((1 << min(self.widths[k], COARSE)) - 1)]
        one = n == 1
        yield mixed(k, v[one], 0), x[one], role[one]
        for own in (np.flatnonzero(~one),):
            if not len(own):
                continue
            # Cell (i, j) of a value: what is filed in block i against what probes from block j.
            size = n[own]
            at = np.repeat(own, size)
            other = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            mine = (mixed(7, x[at]) % n[at].astype(np.uint64)).astype(np.int64)
            for bit, i, j in ((1, mine, other), (2, other, mine)):
                has = role[at] & bit > 0
                yield mixed(k, v[at][has], 1 + i[has] * n[at][has] + j[has]), x[at][has], np.full(has.sum(), bit)


def matched(cell: np.ndarray, x: np.ndarray, role: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The linked pairs of whole cells, as places in rows that are sorted by cell; at most PAIRS and one probe's at once are looked at."""
    start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    group = np.cumsum(np.concatenate(([False], cell[1:] != cell[:-1])))
    filed = np.flatnonzero(role & 1)
    probes = np.flatnonzero(role & 2)
    n = np.bincount(group[filed], minlength=len(start))
    first = np.cumsum(n) - n
    size = n[group[probes]]
    probes, size = probes[size > 0], size[size > 0]
    ends = np.cumsum(size)
    a = 0
    while a < len(probes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        own, many = probes[a:b], size[a:b]
        left = np.repeat(own, many)
        shift = np.cumsum(many) - many
        right = filed[np.arange(many.sum()) - np.repeat(shift, many) + np.repeat(first[group[own]], many)]
        far = np.bitwise_count(x[left] ^ x[right])
        near = (far <= distance) & (far > 0)
        if near.any():
            yield left[near], right[near]
        a = b


def links(distinct: DataFrame, distance: int = 3, block: int = BLOCK, partitions: int | None = None) -> DataFrame:
    """a, b: edges that connect the fingerprints (column fp, each once) as all links within `distance` do."""
    spark = distinct.sparkSession

    def bit_counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for b in rows:
            bits = np.unpackbits(unsigned(b.column(0)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        i, j = np.divmod(np.arange(BITS * BITS, dtype=np.int32), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "n"])

    n = distinct.count()
    both = np.zeros((BITS, BITS))
    for r in distinct.select("fp").mapInArrow(bit_counts, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        both[r.i, r.j] = r.n
    groups = grouped(both, both.diagonal(), n, partitions or number_of_partitions(n, distance))

    def value_counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(1 << min(len(g), COARSE), np.int64) for g in groups]
        for b in rows:
            x = unsigned(b.column(0))
            for h, g in zip(held, groups, strict=True):
                h += np.bincount(projected(x, g[:COARSE]).astype(np.int64), minlength=len(h))
        for k, h in enumerate(held):
            own = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int32)), pa.array(own.astype(np.int32)), pa.array(h[own])], ["part", "value", "n"])

    histograms = [np.zeros(1 << min(len(g), COARSE)) for g in groups]
    counted = distinct.select("fp").mapInArrow(value_counts, "part int, value int, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toArrow()
    part, value, many = (counted.column(c).to_numpy() for c in ("part", "value", "n"))
    for k, h in enumerate(histograms):
        h[value[part == k]] = many[part == k]
    plan = spark.sparkContext.broadcast(Plan(groups, histograms, distance, block))

    def file(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for cell, x, role in plan.value.rows(unsigned(b.column(0))):
                for a in range(0, len(cell), ROWS):
                    own = slice(a, a + ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(cell[own].view(np.int64)), pa.array(x[own].view(np.int64)), pa.array(role[own].astype(np.int8))], ["cell", "fp", "role"])

    def join(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            cell, x, role = (np.concatenate(c) for c in zip(*held, strict=True))
            end = len(cell) if last else int(np.flatnonzero(cell[1:] != cell[:-1])[-1]) + 1 if (cell[1:] != cell[:-1]).any() else 0
            held = [[cell[end:], x[end:], role[end:]]]
            size = len(cell) - end
            forest = Forest(end)
            for p, q in matched(cell[:end], x[:end], role[:end], distance) if end else ():
                forest.join(p, q)
            u, v = forest.edges()
            u, v = u[x[u] != x[v]], v[x[u] != x[v]]
            yield pa.RecordBatch.from_arrays([pa.array(x[u].view(np.int64)), pa.array(x[v].view(np.int64))], ["a", "b"])

        for b in rows:
            held.append([unsigned(b.column(0)), unsigned(b.column(1)), b.column(2).to_numpy(zero_copy_only=False)])
            size += b.num_rows
            if size >= ROWS:
                yield from flush(False)
        if held:
            yield from flush(True)
        tidy()

    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    filed = distinct.select("fp").mapInArrow(file, "cell long, fp long, role byte")
    return filed.repartition(shuffles, "cell").sortWithinPartitions("cell").mapInArrow(join, "a long, b long")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, size: int = 3, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """id, fp (long), component_id of each row."""
    narrow_batches(df.sparkSession)
    rows = cut(keyed(df, id_col, text_col).select("id", fingerprints(F.col("text"), size, seed).alias("fp")))
    linked = rooted(rows, F.min("id"), distance, block)
    # Written before they are joined: a component may hold a third of all rows, see components.
    ids = cut(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    of = cut(linked.join(ids, "root").select("fp", "component_id"))
    return rows.join(of, "fp").select("id", "fp", "component_id")


def rooted(rows: DataFrame, least: Column, distance: int, block: int) -> DataFrame:
    """fp, least, root of each fingerprint of the rows. least: an aggregate of its rows; root: one fingerprint of each component."""
    distinct = cut(rows.groupBy("fp").agg(least.alias("least")))
    root = components(links(distinct, distance, block))
    return cut(distinct.join(root, distinct.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row."""
    found = classes(df, id_col, text_col, **parameters)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
