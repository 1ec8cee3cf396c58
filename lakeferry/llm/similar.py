"""Near-duplicates by word shingles: SimHash by the generalised pigeonhole principle, for similarities that are far from 1.

Two texts are linked if the sets of their five-word shingles have a Jaccard similarity of `similarity` or more. Fingerprints of
such texts differ in about 15 % of the bits at 0.8, which no whole number of differing bits in a few partitions can cover
at a bearable cost. So thresholds are not counts of bits here, but of probes that follow each bit's margin: how far the
shingles of the text are from a tie there. Bits that differ between similar texts are nearly always those with small margins.

1. A text's fingerprint has 128 bits, one for the majority of its different shingles at each place, and a margin for each bit.
   Equal fingerprints are one. Correlations between bits are counted over all of them, and bits that go together share a partition.
2. In each partition a fingerprint has a list of keys: its own value, then those with bits of small margins flipped, by
   the sum of these margins. How often each partition has each key is counted over all fingerprints (by its first 16 bits).
3. A dynamic program allots how many keys of the list are used in each partition, none in some: so many that a pair at `similarity`
   shares a key with the chance `recall`, at the least estimated number of rows and candidates. Chances come from the
   distribution of margins. Similar fingerprints must use the same partitions, so the allotment is one for all of them.
4. Fingerprints that share a key meet and are compared on all 128 bits. A key with very many fingerprints is dealt out as
   blocks of them, each pair of blocks being a cell of its own. Pairs within `sure` bits are linked; they leave a cell as a spanning
   forest. Pairs within `far` bits are open, and leave it unless such links join them: all of them, or where they are more than
   FORESTS times the cell's rows, that many spanning forests of least distances, one after the other, marked as from a
   crowded cell. So a large group never leaves as all its pairs.
5. Of open pairs that no links join, from whatever cells these come, the Jaccard similarity is computed from their shingles' hashes,
   and decides.
6. The pairs that crowded cells left out: what is marked still connects the ends of each. Where it connects texts that no links join,
   all texts that it connects are compared with each other by their shingles' hashes, whatever their bits, but for those that links
   join already. They meet in cells of bounded size, as blocks if they are many, and leave these as spanning forests of links.
7. Components of the links; of each one row stays.

Null and empty texts have no shingle and count as equal to each other; a text of fewer words is one shingle. Rows that repeat are
copies. Which of a component's rows stays: that with the least id, a null id being the last, and of several the first row. An
empty table gives no rows. Texts are taken whole. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lakeferry.llm.base import cut, fresh, narrow_batches, once, remove, tidy, utf8
from lakeferry.llm.components import Forest, components
from lakeferry.llm.simhash import grouped, mixed

BITS = 128
WORDS = BITS // 64
#: Shingles whose bits are summed at once.
PIECE = 4096
#: Bits of a partition that may be flipped, the most keys of a partition, and the numbers of keys to choose from.
LOW, KEYS = 8, 32
CHOICES = (0, 1, 2, 4, 6, 8, 12, 16, 24, 32)
#: A histogram of a partition's keys covers its first bits, up to so many.
COARSE = 16
#: A row costs as much as so many candidates.
ROW_COST = 60
#: Units in which chances are added up: of the logarithm of the chance that a pair doesn't meet.
UNIT = 0.05
#: Fingerprints of a block, where a key has more.
BLOCK = 4096
#: Rows that a task of the join works on at once, and pairs.
ROWS, PAIRS = 50_000, 1 << 18
#: Spanning forests of open pairs that leave a cell at most.
FORESTS = 2
#: Hashes of shingles in a block of texts that are all compared; such a block has at most about BLOCK texts, too.
HASHES = 1 << 19

#: Sets of up to three flipped bits of LOW.
FLIPS = np.array([[k in own for k in range(LOW)] for n in range(4) for own in combinations(range(LOW), n)], bool)


def shingles(text: bytes, size: int, seed: int) -> np.ndarray:
    """Hashes of the different shingles, ascending. Words are between ASCII white space, A-Z as small letters."""
    own = text.lower().split()
    w = np.fromiter(map(xxh64_intdigest, own, repeat(seed)), np.uint64, len(own))
    n = max(min(1, len(w)), len(w) - size + 1)
    return np.unique(mixed(*(w[k : k + n] for k in range(min(size, len(w))))) if n else w)


def spread(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th 64 bits that a hash gives, each independent of the others."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def fingerprint(h: np.ndarray) -> tuple[bytes, bytes]:
    """Of a text's hashes: the 128 bits, and a byte for each bit's margin, in 64ths of the root of their number."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), PIECE):
        part = h[at : at + PIECE]
        bits = np.unpackbits(np.stack([spread(part, j) for j in range(WORDS)], axis=1).view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    lead = 2 * ones - len(h)
    margin = np.minimum(255, np.abs(lead) * (64 / max(1.0, len(h) ** 0.5)))
    return np.packbits(lead > 0, bitorder="little").tobytes(), margin.astype(np.uint8).tobytes()


def jaccard(a: bytes, b: bytes) -> float:
    """Of two sorted sets of hashes."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.intersect1d(x, y, assume_unique=True).size
    return both / (len(x) + len(y) - both)


def sketch(h: np.ndarray) -> bytes:
    """The set of a text's hashes, 32 bits of each."""
    return np.unique(h.astype(np.uint32)).tobytes()


def bits_between(similarity: float) -> float:
    """The share of bits that differ between sets of this Jaccard similarity and like size."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


@lru_cache(64)
def chances(width: int, similarity: float, samples: int = 3000) -> np.ndarray:
    """For each of CHOICES: the chance that two such sets share one of so many keys of a partition of `width` bits."""
    r, rho = np.random.default_rng([width, 7]), 2 * similarity / (1 + similarity)
    a = r.normal(size=(samples, width))
    b = rho * a + np.sqrt(1 - rho * rho) * r.normal(size=a.shape)
    own = [keys(np.packbits(x > 0, axis=1, bitorder="little"), np.minimum(255, np.abs(x) * 64).astype(np.uint8), list(range(width))) for x in (a, b)]
    return np.array([(own[0][:, :n, None] == own[1][:, None, :n]).any(axis=(1, 2)).mean() if n else 0.0 for n in CHOICES])


def projected(packed: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value that these bits of packed bits make up."""
    out = np.zeros(len(packed), np.uint64)
    for k, b in enumerate(bits):
        out |= (packed[:, b >> 3] >> np.uint8(b & 7) & np.uint8(1)).astype(np.uint64) << np.uint64(k)
    return out


def keys(packed: np.ndarray, margins: np.ndarray, bits: list[int]) -> np.ndarray:
    """[fingerprint, KEYS]: the keys of a partition, by the sum of the margins of flipped bits; ties go by the order of FLIPS."""
    m = margins[:, bits].astype(np.int64)
    low = np.argsort(m, axis=1, kind="stable")[:, :LOW]
    width = low.shape[1]
    flips = FLIPS[~FLIPS[:, width:].any(axis=1), :width]
    cost = np.take_along_axis(m, low, axis=1) @ flips.T.astype(np.int64)
    best = np.argsort(cost, axis=1, kind="stable")[:, :KEYS]
    mask = (np.uint64(1) << low.astype(np.uint64)) @ flips.T.astype(np.uint64)
    return projected(packed, bits)[:, None] ^ np.take_along_axis(mask, best, axis=1)


def allotted(gains: list[np.ndarray], costs: list[list[float]], need: int) -> list[int]:
    """How many keys each partition uses: of what adds up to `need`, or to as much as there can be, what costs least in all."""
    need = min(need, sum(int(g[-1]) for g in gains))
    rest = [(0.0, [])] + [(np.inf, [])] * need  # by what is still needed: the least cost of later partitions, and their choices
    for gain, cost in zip(reversed(gains), reversed(costs), strict=True):
        rest = [min(((rest[max(0, s - int(g))][0] + c, [k, *rest[max(0, s - int(g))][1]]) for k, (g, c) in enumerate(zip(gain, cost, strict=True))), key=lambda x: x[0]) for s in range(need + 1)]
    return [CHOICES[k] for k in rest[need][1]]


def number_of_partitions(n: int) -> int:
    """Keys should be more than fingerprints; with fewer than five partitions the chance to meet can't be had."""
    return int(min(8, max(5, BITS // max(1.0, np.log2(max(2, n)) + 1))))


class Plan:
    """What a task needs to file fingerprints: at most 2^16 numbers for each partition, whatever the corpus.

    counts: for each partition how often its keys, all KEYS of each fingerprint, have a value in their first bits; n: fingerprints.
    """

    def __init__(self, groups: list[list[int]], counts: list[np.ndarray], n: int, similarity: float, recall: float, block: int):
        self.groups, self.mask = groups, [np.uint64(len(c) - 1) for c in counts]
        gains = [np.floor(-np.log1p(-np.minimum(0.999, chances(len(g), similarity))) / UNIT).astype(int) for g in groups]
        # Pairs that meet, were fingerprints to use all keys: those of one value, of which the further bits leave a part.
        pairs = [float((c.astype(float) ** 2).sum() / 2 ** (len(g) - len(c).bit_length() + 2)) for c, g in zip(counts, groups, strict=True)]
        costs = [[n * ROW_COST * many + p * (many / KEYS) ** 2 for many in CHOICES] for p in pairs]
        self.many = allotted(gains, costs, int(np.ceil(-np.log(1 - recall) / UNIT)))
        # Blocks: what a key has beyond the share of keys that are evenly frequent.
        self.blocks = [1 + (np.maximum(0, c - 4 * c.mean()) // block).astype(np.int64) for c in counts]

    def rows(self, packed: np.ndarray, margins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Cells, and the places of the fingerprints that are filed there."""
        for k, (g, many) in enumerate(zip(self.groups, self.many, strict=True)):
            if not many:
                continue
            v = keys(packed, margins, g)[:, :many]
            at, key = np.repeat(np.arange(len(v)), v.shape[1]), v.ravel()
            n = self.blocks[k][(key & self.mask[k]).astype(np.int64)]
            # Cell (i, j), i <= j, of a key holds its blocks i and j.
            place = np.repeat(np.arange(len(at)), n)
            other = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
            size = n[place].astype(np.uint64)
            mine = (mixed(7, *packed[at[place]].view(np.uint64).T) % size).astype(np.int64)
            yield mixed(k, key[place], np.minimum(mine, other) * n[place] + np.maximum(mine, other)), at[place]


def forest(n: int, u: np.ndarray, v: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The edges (their places) of a spanning forest of least weights h of the places 0 .. n - 1: each component takes its least edge."""
    root, kept, left = np.arange(n), [], np.arange(len(u))
    rank = np.empty(len(u), np.int64)
    rank[np.argsort(h, kind="stable")] = np.arange(len(u))
    while len(left):
        a, b = root[u[left]], root[v[left]]
        new = a != b
        left, a, b = left[new], a[new], b[new]
        if not len(left):
            break
        least = np.full(n, len(u))
        np.minimum.at(least, a, rank[left])
        np.minimum.at(least, b, rank[left])
        own = np.flatnonzero((least[a] == rank[left]) | (least[b] == rank[left]))
        kept.append(left[own])
        a, b = a[own], b[own]
        while True:
            x, y = root[a], root[b]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
    return np.concatenate(kept) if kept else left


def sparse(group: np.ndarray, u: np.ndarray, v: np.ndarray, h: np.ndarray, sure: int, crowded_cells: np.ndarray | None = None) -> np.ndarray:
    """Places of the pairs that stand for all of these pairs: a forest of those within `sure`, and of the others those that it doesn't
    join: all of them, or in a cell where they are more than FORESTS times its rows, so many forests, which connect what all of them
    do; such cells are marked in crowded_cells. group: the cell of each row, by number."""
    n = len(group)
    close = np.flatnonzero(h <= sure)
    close = close[forest(n, u[close], v[close], h[close])]
    joined = Forest(n)
    joined.join(u[close], v[close])
    left = np.flatnonzero((h > sure) & (joined.root[u] != joined.root[v]))
    size = np.bincount(group)
    many = np.bincount(group[u[left]], minlength=len(size)) > FORESTS * size
    if crowded_cells is not None:
        crowded_cells |= many
    crowded = many[group[u[left]]]
    kept, left = [close, left[~crowded]], left[crowded]
    for _ in range(FORESTS):
        own = forest(n, u[left], v[left], h[left])
        kept.append(left[own])
        left = np.delete(left, own)
    return np.concatenate(kept)


def near(cell: np.ndarray, x: np.ndarray, node: np.ndarray, sure: int, far: int, crowded: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of whole cells, rows (x: unsigned) being sorted by cell: u, v and distance of sparse() pairs within `far` bits.
    At most PAIRS pairs, and those of one row, are looked at at once. Rows of cells that left pairs out are marked in crowded."""
    ends = np.append(np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell))
    later = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(cell)) - 1
    upto = np.cumsum(later)
    group = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    many_open = np.zeros(len(ends), bool)
    u, v, h, a = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while a < len(cell):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
        many = later[a:b]
        left = np.repeat(np.arange(a, b), many)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)
        d = sum(np.bitwise_count(x[left, j] ^ x[right, j]).astype(np.int64) for j in range(WORDS))
        own = np.flatnonzero((d <= far) & (node[left] != node[right]))
        if len(own):
            u, v, h = np.concatenate([u, left[own]]), np.concatenate([v, right[own]]), np.concatenate([h, d[own]])
            if len(u) > 16 * len(cell):
                kept = sparse(group, u, v, h, sure, many_open)
                u, v, h = u[kept], v[kept], h[kept]
        a = b
    kept = sparse(group, u, v, h, sure, many_open)
    if crowded is not None:
        crowded[:] = many_open[group]
    return u[kept], v[kept], h[kept]


def candidates(distinct: DataFrame, similarity: float, recall: float, sure: int, far: int, block: int = BLOCK, partitions: int | None = None) -> DataFrame:
    """a, b, h, crowded: numbers of fingerprints that met and differ in h <= far bits, made sparse in each cell; whether one of these
    cells left pairs out.

    distinct: node (long), fp and margins (binary), each fingerprint once."""
    spark = distinct.sparkSession
    packed = lambda c, width: np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, width)

    def bit_counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for b in rows:
            bits = np.unpackbits(packed(b.column(0), BITS // 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        i, j = np.nonzero(np.triu(total))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "n"])

    n = distinct.count()
    both = np.zeros((BITS, BITS))
    counted = distinct.select("fp").mapInArrow(bit_counts, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()
    i, j, many = (counted.column(c).to_numpy() for c in ("i", "j", "n"))
    both[i, j] = both[j, i] = many
    groups = grouped(both, both.diagonal(), n, partitions or number_of_partitions(n), BITS)

    def key_counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(1 << min(len(g), COARSE), np.int64) for g in groups]
        for b in rows:
            p, m = packed(b.column(0), BITS // 8), packed(b.column(1), BITS)
            for h, g in zip(held, groups, strict=True):
                h += np.bincount((keys(p, m, g) & np.uint64(len(h) - 1)).ravel().astype(np.int64), minlength=len(h))
        tidy()
        for k, h in enumerate(held):
            own = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int32)), pa.array(own.astype(np.int32)), pa.array(h[own])], ["part", "value", "n"])

    histograms = [np.zeros(1 << min(len(g), COARSE)) for g in groups]
    counted = distinct.select("fp", "margins").mapInArrow(key_counts, "part int, value int, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toArrow()
    part, value, many = (counted.column(c).to_numpy() for c in ("part", "value", "n"))
    for k, h in enumerate(histograms):
        h[value[part == k]] = many[part == k]
    plan = spark.sparkContext.broadcast(Plan(groups, histograms, n, similarity, recall, block))
    words = [f"x{j}" for j in range(WORDS)]

    def file(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            node, p = b.column(0).to_numpy(), packed(b.column(1), BITS // 8)
            x = p.view(np.int64)
            for cell, at in plan.value.rows(p, packed(b.column(2), BITS)):
                for a in range(0, len(cell), ROWS):
                    own = at[a : a + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(cell[a : a + ROWS].view(np.int64)), pa.array(node[own]), *(pa.array(np.ascontiguousarray(x[own, j])) for j in range(WORDS))], ["cell", "node", *words])
        tidy()

    def join(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, size
            cell, node, *x = (np.concatenate(c) for c in zip(*held, strict=True))
            cuts = np.flatnonzero(cell[1:] != cell[:-1])
            end = len(cell) if last else int(cuts[-1]) + 1 if len(cuts) else 0
            held, size = [[c[end:] for c in (cell, node, *x)]], len(cell) - end
            crowded = np.zeros(end, bool)
            u, v, h = near(cell[:end], np.stack(x, axis=1).view(np.uint64)[:end], node[:end], sure, far, crowded) if end else (np.zeros(0, np.int64),) * 3
            a, b = node[u], node[v]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(h.astype(np.int32)), pa.array(crowded[u])], ["a", "b", "h", "crowded"])

        for b in rows:
            held.append([c.to_numpy() for c in b.columns])
            size += b.num_rows
            if size >= ROWS:
                yield flush(False)
        if held:
            yield flush(True)
        tidy()

    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    filed = distinct.select("node", "fp", "margins").mapInArrow(file, f"cell long, node long, {', '.join(w + ' long' for w in words)}")
    met = filed.repartition(shuffles, "cell").sortWithinPartitions("cell", "node").mapInArrow(join, "a long, b long, h int, crowded boolean")
    return met.groupBy("a", "b", "h").agg(F.max("crowded").alias("crowded"))


def bounds(similarity: float) -> tuple[int, int]:
    """sure and far: two standard deviations of the number of differing bits below and above what is expected at the similarity."""
    p = bits_between(similarity)
    spread = 2 * (BITS * p * (1 - p)) ** 0.5
    return int(BITS * p - spread), int(np.ceil(BITS * p + spread))


def near_deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, recall: float = 0.97, seed: int = 42, block: int = BLOCK, partitions: int | None = None, max_broadcast: int = 1_000_000) -> DataFrame:
    """One row of each component of similar texts; columns and their order stay. size: words of a shingle. recall: the chance that two
    texts just at `similarity` meet. max_broadcast: numbers of rows that go, up to which they are broadcast rather than shuffled."""
    spark = df.sparkSession
    narrow_batches(spark)
    sure, far = bounds(similarity)
    number, text = fresh(df, "number"), F.col(f"`{text_col}`").cast("string")

    @F.arrow_udf("struct<fp: binary, margins: binary>")
    def of(texts: pa.Array) -> pa.Array:
        once("similar", list)
        both = [fingerprint(shingles(t, size, seed)) for t in utf8(texts)]
        tidy()
        return pa.StructArray.from_arrays([pa.array([b[k] for b in both], pa.binary()) for k in (0, 1)], ["fp", "margins"])

    whole = numbered(df, number)
    rows = cut(whole.select(F.col(f"`{id_col}`").alias("id"), F.col(number).alias("number"), of(text).alias("of")).select("id", "number", "of.*"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "number"))
    # A class is named by the number of its first row.
    distinct = cut(rows.groupBy("fp").agg(first.alias("least"), F.min("margins").alias("margins")).select("fp", "margins", "least", F.col("least.number").alias("node")))
    found = cut(candidates(distinct, similarity, recall, sure, far, block, partitions))
    links = found.where(F.col("h") <= sure).select("a", "b")
    root = cut(components(links))
    side = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    open_ = found.where(F.col("h") > sure).join(side("a"), "a", "left").join(side("b"), "b", "left")
    open_ = cut(open_.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))
    if not open_.isEmpty():
        links = links.union(_checked(open_, whole, number, text, size, seed, similarity, max_broadcast))
        root = cut(components(links))
    more = _left_out(found, root, whole, number, text, size, seed, similarity, block, max_broadcast)
    if more is not None:
        root = cut(components(links.union(more)))
    least = distinct.join(root, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    # What goes is mostly less than what stays.
    gone = cut(rows.select("number").join(least.select(F.col("least.number").alias("number")), "number", "left_anti").withColumnRenamed("number", number))
    for over in (rows, distinct, found, open_, root):
        remove(spark, over)
    return whole.join(_small(gone, max_broadcast), number, "left_anti").select(*(f"`{c}`" for c in df.columns))


def _small(table: DataFrame, most: int) -> DataFrame:
    """A written table of numbers, to be broadcast if it has no more rows than that."""
    return F.broadcast(table) if table.count() <= most else table


def numbered(df: DataFrame, number: str) -> DataFrame:
    """df with a number of each row, the same whenever it is computed, as rows are told apart by it in several passes.

    Rows of files have such a number: the file's place and the row's in it. What else df may be is written first.
    """
    node = df._jdf.queryExecution().analyzed()
    while node.children().size() == 1 and node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    try:
        of, at = fresh(df, "file"), fresh(df, "row")
        placed = df.select("*", F.col("_metadata.file_path").alias(of), F.col("_metadata.row_index").alias(at)) if node.nodeName().startswith("Relation") or node.nodeName() == "LogicalRelation" else None
    except AnalysisException:
        placed = None
    if placed is None:
        return cut(df.withColumn(number, F.monotonically_increasing_id()))
    # As many names as the table has files.
    names = sorted(r[of] for r in placed.select(of).distinct().collect())
    files = df.sparkSession.createDataFrame([(n, k << 40) for k, n in enumerate(names)], f"`{of}` string, `{number}` long")
    return placed.join(F.broadcast(files), of).withColumn(number, F.col(number) + F.col(at)).select(*(f"`{c}`" for c in df.columns), number)


def _sets(asked: DataFrame, whole: DataFrame, number: str, text: Column, size: int, seed: int) -> DataFrame:
    """node, own: the numbers of rows that are asked for (node), and the hashes of their texts' shingles."""

    @F.arrow_udf("binary")
    def sketched(texts: pa.Array) -> pa.Array:
        return pa.array([sketch(shingles(t, size, seed)) for t in utf8(texts)], pa.binary())

    return cut(whole.select(F.col(number).alias("node"), text.alias("text")).join(asked, "node", "left_semi").select("node", sketched("text").alias("own")))


def _checked(pairs: DataFrame, whole: DataFrame, number: str, text: Column, size: int, seed: int, similarity: float, max_broadcast: int) -> DataFrame:
    """Of these pairs (a, b: numbers of rows) those whose texts have the similarity."""

    @F.arrow_udf("boolean")
    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([jaccard(a, b) >= similarity for a, b in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.bool_())

    asked = _small(cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), max_broadcast)
    sets = _sets(asked, whole, number, text, size, seed)
    side = lambda c: sets.select(F.col("node").alias(c), F.col("own").alias(f"of_{c}"))
    return cut(pairs.join(side("a"), "a").join(side("b"), "b").where(alike("of_a", "of_b")).select("a", "b"))


def linked(sets: list[np.ndarray], root: np.ndarray, block: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of sets of hashes that have the similarity: so many that they and the roots, which texts share that are linked
    already, join all that do. block: if there are two, only pairs between them are asked for."""
    n, size = len(sets), np.array([len(s) for s in sets])
    _, first, root = np.unique(root, return_index=True, return_inverse=True)
    joined = Forest(n)
    joined.join(np.arange(n), first[root])
    # Each pair of different roots has an end that is not of the most frequent one.
    asks = np.flatnonzero(root != np.bincount(root).argmax())
    if two := block.min() != block.max():
        asks = min(asks, np.flatnonzero(block == block[0]), key=len)
    _, of = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    holders = np.repeat(np.arange(n), size)[np.argsort(of, kind="stable")]
    many = np.bincount(of)
    start = np.cumsum(many) - many
    u, v = [], []
    for i in asks:
        own = of[ends[i] - size[i] : ends[i]]
        upto, both, a = np.cumsum(many[own]), np.zeros(n, np.int64), 0
        while a < len(own):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
            k = many[own[a:b]]
            both += np.bincount(holders[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k - start[own[a:b]], k)], minlength=n)
            a = b
        near_by = np.flatnonzero((both > 0) & (joined.root != joined.root[i]) & ((block != block[i]) | (not two)))
        near_by = near_by[both[near_by] / (size[i] + size[near_by] - both[near_by]) >= similarity]
        if len(near_by):
            near_by = near_by[np.unique(joined.root[near_by], return_index=True)[1]]
            u.append(np.full(len(near_by), i))
            v.append(near_by)
            joined.join(u[-1], v[-1])
    return (np.concatenate(u), np.concatenate(v)) if u else (np.zeros(0, np.int64),) * 2


def _left_out(found: DataFrame, root: DataFrame, whole: DataFrame, number: str, text: Column, size: int, seed: int, similarity: float, block: int, max_broadcast: int) -> DataFrame | None:
    """Links that join, with those of root, all pairs of the similarity that crowded cells left out; None if they can't have left out any
    that isn't joined."""
    spark = whole.sparkSession
    side = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    marked = found.where("crowded").join(side("a"), "a", "left").join(side("b"), "b", "left")
    marked = cut(marked.select("a", "b", F.coalesce("root_a", "a").alias("root_a"), F.coalesce("root_b", "b").alias("root_b")))
    apart = marked.where("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    if apart.isEmpty():
        remove(spark, marked)
        return None
    group = components(apart).select(F.col("node").alias("root"), F.col("root").alias("group"))
    ends = marked.select(F.explode(F.array(*(F.struct(F.col(c).alias("node"), F.col(f"root_{c}").alias("root")) for c in "ab"))).alias("end")).select("end.*").distinct()
    ends = cut(ends.join(group, "root"))
    sets = _sets(_small(ends.select("node"), max_broadcast), whole, number, text, size, seed)
    blocks = ends.join(sets.select("node", (F.length("own") / 4).alias("n")), "node").groupBy("group").agg((1 + F.floor(F.greatest(F.sum("n") / HASHES, F.count("*") / block))).cast("int").alias("blocks"))
    mine, other = F.col("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    # Cell (i, j), i <= j, of a group holds its blocks i and j.
    dealt = ends.join(cut(blocks), "group").select("group", "node", "root", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("mine"), other)
    dealt = dealt.select("group", F.least(mine, "other").alias("i"), F.greatest(mine, "other").alias("j"), "node", "root", "mine")

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links() -> pa.RecordBatch:
            node, of, mine = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("node", "root", "mine"))
            own = [np.frombuffer(s, np.uint32) for b in held for s in b.column("own").to_pylist()]
            u, v = linked(own, of, mine, similarity)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v])], ["a", "b"])

        last = None
        for b in rows:
            cell = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("group", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for a, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e > a:
                    if held and tuple(cell[a]) != last:
                        yield links()
                    last = tuple(cell[a])
                    held.append(b.slice(a, e - a))
        if held:
            yield links()
        tidy()

    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.join(sets, "node").repartition(shuffles, "group", "i", "j").sortWithinPartitions("group", "i", "j")
    out = cut(dealt.mapInArrow(compare, "a long, b long").distinct())
    for over in (marked, ends, sets):
        remove(spark, over)
    return out
