"""Embedding near-duplicates by lattice hashing: random projections decoded to points of E8, verified by cosine.

Each of `tables` tables projects the unit vectors on 8 random orthonormal directions, scales them and decodes the result to the
nearest point of the lattice E8, which is the vector's cell. A vector is filed under its own cell and looks there and in the
`probes` neighbouring cells (of the 240 around) whose points are nearest to it. Vectors that meet are verified by their cosine
in double precision; what doesn't reach the threshold is never linked.

A pair that reaches the threshold is missed only if it meets in no table: for a cosine of 0.93 in 64 dimensions that is
less than 1 in 10,000 pairs with the defaults, for 0.96 and more less than 1 in a million.

Vectors that are equal, number by number, are one class; the class counts its rows. Only vectors of one label and dimension meet.
A pair that meets in several tables is counted in the first, which both vectors' cells tell, so pairs are never gathered:
a cell gives numbers of links for each class, and a spanning forest of its links. A cell that very many vectors are filed in, or
probe, is dealt out: both are divided into blocks, and each pair of a filed and a probing block is a cell of its own.

Links: a vector's links are the other rows whose cosine reaches the threshold, rows of its own class among them. A
component's id is the least id that links reach. Vectors that are null, empty or zero, or hold null, NaN or infinity, and rows
without a label link with nothing; each is its own component. A row with a null id counts as a link; its component's id is
the least that isn't null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeferry.llm.base import cut, narrow_batches, remove, tidy
from lakeferry.llm.components import Forest, components
from lakeferry.llm.simhash import mixed

#: Vectors of a block, where one cell has more.
BLOCK = 2048
#: Rows that a task of the join works on at once, and pairs.
ROWS, PAIRS = 20_000, 1 << 17


@lru_cache(1)
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8, in halves: two coordinates of +-2, or eight of +-1 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = s, t
            out.append(v)
    out += [v for v in product((1, -1), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out, np.int64)


def decoded(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, in halves: of D8 or of D8 shifted by a half, whichever is nearer."""

    def d8(y: np.ndarray) -> np.ndarray:
        f = np.rint(y)
        odd = np.flatnonzero(f.sum(axis=1).astype(np.int64) & 1)
        e = y[odd] - f[odd]
        k = np.abs(e).argmax(axis=1)
        f[odd, k] += np.where(e[np.arange(len(odd)), k] >= 0, 1, -1)
        return f

    a, b = d8(x), d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.rint(2 * np.where(nearer[:, None], a, b)).astype(np.int64)


@lru_cache(64)
def directions(dim: int, table: int, seed: int) -> np.ndarray:
    r = np.random.default_rng([seed, table, dim])
    return np.linalg.qr(r.normal(size=(max(dim, 8), 8)))[0][:dim]


class Lattice:
    """tables, probes and scale (the lattice's unit of length, for projections of unit vectors of 64 dimensions) set the chance
    of meeting; seed sets the directions."""

    def __init__(self, tables: int = 3, probes: int = 8, scale: float = 0.25, seed: int = 11):
        self.tables, self.probes, self.scale, self.seed = tables, probes, scale, seed

    @classmethod
    def suited(cls, n: int) -> Lattice:
        """The one with the least work for n vectors: finer cells hold fewer strangers, and need more tables for the same chance of
        meeting, which is over 0.9999 at a cosine of 0.93 for each of these."""
        return cls(3, 8, 0.25) if n < 200_000 else cls(5, 8, 0.2) if n < 2_000_000 else cls(10, 8, 0.15)

    def cells(self, x: np.ndarray, table: int) -> np.ndarray:
        """[vector, 1 + probes]: hashes of its own cell and of those that it probes. x: unit vectors."""
        # Projections shrink with the dimension; they are scaled to what they would be in 64 dimensions.
        p = x @ directions(x.shape[1], table, self.seed) * (np.sqrt(max(8, x.shape[1]) / 64) / self.scale)
        own = decoded(p)
        near = neighbours()
        # The nearest neighbours are those along which the rest of p goes furthest; ties go by their order.
        top = np.argsort(-np.round((2 * p - own) @ near.T, 9), axis=1, kind="stable")[:, : self.probes]
        all_cells = np.concatenate([own[:, None, :], own[:, None, :] + near[top]], axis=1)
        h = mixed(table)
        for k in range(8):
            h = mixed(h, (all_cells[:, :, k] + (1 << 20)).astype(np.uint64))
        return h


def unit(rows: pa.Array, dim: int) -> np.ndarray:
    """Packed vectors as unit vectors, in double precision."""
    data = b"".join(rows.to_pylist())
    x = np.frombuffer(data, np.float32 if len(data) == 4 * dim * len(rows) else np.float64).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square is beyond what a double can hold
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def packed(vector: np.ndarray) -> bytes | None:
    """A usable vector's numbers, or None."""
    return vector.tobytes() if len(vector) and np.isfinite(vector).all() and vector.any() else None


def _pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, group (of dimension and label), key and vec (in the numbers' own width) of each row; nulls where it links with nothing."""
    for b in rows:
        groups, keys, vecs, lists = [], [], [], b.column(2)
        there, at = lists.is_valid().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False)  # nulls become NaN
        width = values.dtype.itemsize
        for k, label in enumerate(b.column(1).to_pylist()):
            own = packed(values[at[k] : at[k + 1]]) if label is not None and there[k] else None
            group = f"{len(own) // width}:{label}" if own else None
            groups.append(group)
            keys.append(hashlib.blake2b(own, digest_size=16, key=group.encode()[:64]).digest() if own else None)
            vecs.append(own)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(groups, pa.string()), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["id", "grp", "key", "vec"])


def _group_hash(groups: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    for g in groups:
        if g not in known:
            known[g] = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest())
    return np.array([known[g] for g in groups], np.uint64)


def _cells(lattice: Lattice):
    """cls, n, vec -> a row for each cell that the class is filed in (role 1) or probes (2), its own one being both (3)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            groups = b.column("grp").to_pylist()
            dims = np.array([int(g.partition(":")[0]) for g in groups])
            hashes = _group_hash(groups)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                part = b.take(pa.array(own))
                x = unit(part.column("vec"), int(dim))
                for t in range(lattice.tables):
                    h = mixed(hashes[own][:, None], lattice.cells(x, t))
                    many = h.shape[1]
                    at = np.repeat(np.arange(len(own)), many)
                    role = np.tile(np.array([3] + [2] * (many - 1), np.int8), len(own))
                    cols = [part.column(c).take(pa.array(at)) for c in ("cls", "n", "grp", "vec")]
                    yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(role), pa.array(np.full(len(at), t, np.int8)), *cols], ["cell", "role", "tab", "cls", "n", "grp", "vec"])

    return run


def _first_meeting(cells: list[np.ndarray], p: np.ndarray, h: np.ndarray, above: np.ndarray) -> np.ndarray:
    """For pairs of rows that met in the last of these tables, where p probed h: is this the one meeting of the pair that counts?

    above: is p the greater of the two? It counts in the first table where they meet, and there where the greater one probes,
    or else where the smaller one does.
    """
    out = np.ones(len(p), bool)
    for t, own in enumerate(cells):
        back = (own[h] == own[p][:, :1]).any(axis=1)
        out &= (above | ~back) if t == len(cells) - 1 else ~(back | (own[p] == own[h][:, :1]).any(axis=1))
    return out


def _join(lattice: Lattice, threshold: float):
    """Rows by cell -> edges (a, b) of a spanning forest, and numbers of links (a, n)."""

    def of_cell(dim: int, table: int, cls: np.ndarray, n: np.ndarray, role: np.ndarray, vec: pa.Array) -> tuple[np.ndarray, ...] | None:
        x = unit(vec, dim)
        filed, probes = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        forest, many, cells = Forest(len(x)), np.zeros(len(x)), None
        step = max(1, PAIRS // len(filed))
        for a in range(0, len(probes), step):
            own = probes[a : a + step]
            i, j = np.nonzero(x[own] @ x[filed].T >= threshold)
            p, h = own[i], filed[j]
            new = cls[p] != cls[h]
            p, h = p[new], h[new]
            if not len(p):
                continue
            forest.join(p, h)
            cells = cells or [lattice.cells(x, t) for t in range(table + 1)]
            first = _first_meeting(cells, p, h, cls[p] > cls[h])
            p, h = p[first], h[first]
            many += np.bincount(p, n[h], len(x)) + np.bincount(h, n[p], len(x))
        if cells is None:
            return None
        u, v = forest.edges()
        u, v = u[cls[u] != cls[v]], v[cls[u] != cls[v]]
        own = np.flatnonzero(many)
        return cls[u], cls[v], cls[own], many[own].astype(np.int64)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            t = pa.Table.from_batches(held).combine_chunks()
            cell, role = t["cell"].to_numpy(), t["role"].to_numpy()
            cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            end = len(cell) if last else int(cuts[-1]) if len(cuts) else 0
            bounds = [0, *cuts[cuts < end].tolist(), end] if end else []
            cls, n, tab = t["cls"].to_numpy(), t["n"].to_numpy(), t["tab"].to_numpy()
            both = np.concatenate(([0], np.cumsum(role & 1)))
            found = []
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b - a > 1 and both[b] > both[a]:  # something is filed there and another row has come
                    one = t.slice(a, b - a)
                    dim = int(one["grp"][0].as_py().partition(":")[0])
                    own = of_cell(dim, int(tab[a]), cls[a:b], n[a:b], role[a:b], one["vec"].combine_chunks())
                    if own is not None:
                        found.append(own)
            for u, v, c, many in found:
                nulls = pa.nulls(len(c), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(u), pa.array(c)]), pa.concat_arrays([pa.array(v), nulls]), pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(many)])], ["a", "b", "n"])
            rest = t.slice(end)
            held, size = rest.to_batches(), rest.num_rows

        for b in rows:
            held.append(b)
            size += b.num_rows
            if size >= ROWS:
                yield from flush(False)
        if size:
            yield from flush(True)
        tidy()

    return run


def links(classes: DataFrame, threshold: float = 0.93, lattice: Lattice | None = None, block: int = BLOCK, max_broadcast: int = 200_000) -> DataFrame:
    """a, b: edges that connect classes as all links found do; a, n: parts of the number of a class's linked rows, b being null.

    classes: cls (long, each once), n (rows), grp, vec."""
    lattice = lattice or Lattice.suited(classes.count())
    spark = classes.sparkSession
    rows = classes.select("cls", "n", "grp", "vec").mapInArrow(_cells(lattice), "cell long, role byte, tab byte, cls long, n long, grp string, vec binary")
    # Cells with more than a block of filed or of probing vectors, by an aggregation with partial sums over cells and roles alone.
    sizes = rows.groupBy("cell").agg(*(F.count_if(F.col("role").bitwiseAND(bit) > 0).alias(c) for c, bit in (("filed", 1), ("probing", 2))))
    hot = cut(sizes.where(f"greatest(filed, probing) > {block}").select("cell", *(F.ceil(F.col(c) / block).cast("int").alias(c) for c in ("filed", "probing"))))
    n = hot.count()
    if n:
        # There are at most tables x (1 + probes) x classes / block of them: broadcast while that is known to be small.
        own = rows.join(F.broadcast(hot) if n <= max_broadcast else hot, "cell", "left")
        cold, dealt = own.where("filed IS NULL").drop("filed", "probing"), own.where("filed > 0")  # where nothing is filed, nothing meets
        # What is filed in block i meets what probes from block j in cell (i, j): a filed row goes to all j, a probing one to all i.
        dealt = dealt.withColumn("role", F.explode(F.when(F.col("role") == 3, F.array(F.lit(1).cast("byte"), F.lit(2).cast("byte"))).otherwise(F.array("role"))))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("role") == 1, F.col("probing")).otherwise(F.col("filed")) - 1)))
        mine = F.pmod(F.xxhash64("cls"), F.when(F.col("role") == 1, F.col("filed")).otherwise(F.col("probing"))).cast("int")
        place = F.when(F.col("role") == 1, F.struct(mine.alias("i"), F.col("other").alias("j"))).otherwise(F.struct(F.col("other").alias("i"), mine.alias("j")))
        rows = cold.unionByName(dealt.withColumn("cell", F.xxhash64("cell", place)).drop("filed", "probing", "other"))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(shuffles, "cell").sortWithinPartitions("cell").mapInArrow(_join(lattice, threshold), "a long, b long, n long")


def classes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, lattice: Lattice | None = None, block: int = BLOCK) -> DataFrame:
    """id, n_links, component_id of each row."""
    narrow_batches(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").alias("v"))
    # Single precision stays as it is on the way, at half the bytes; all arithmetic is in double precision.
    rows = rows if rows.schema["v"].dataType.simpleString() == "array<float>" else rows.withColumn("v", F.col("v").cast("array<double>"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = cut(rows.mapInArrow(_pack, f"id {kind}, grp string, key binary, vec binary"))
    same = rows.where("key IS NOT NULL").groupBy("grp", "key").agg(F.any_value("vec").alias("vec"), F.min("id").alias("least"), F.count("*").alias("n"))
    same = cut(same.withColumn("cls", F.monotonically_increasing_id()))
    found = cut(links(same, threshold, lattice, block))
    many = found.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    root = components(found.where("b IS NOT NULL").select("a", "b"))
    of = same.select("cls", "grp", "key", "least", "n").join(many, "cls", "left").join(root, F.col("cls") == F.col("node"), "left")
    of = cut(of.select("grp", "key", "least", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root")))
    # Written before they are joined: a component may hold a third of all rows, see components.
    ids = cut(of.groupBy("root").agg(F.min("least").alias("component_id")))
    for over in (found, same):
        remove(df.sparkSession, over)
    of = of.join(ids, "root").select("grp", "key", "n_links", "component_id")
    linked = rows.where("key IS NOT NULL").select("id", "grp", "key").join(of, ["grp", "key"])
    alone = rows.where("key IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.select("id", "n_links", "component_id").union(alone)


def report(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **parameters) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    return classes(df, id_col, vector_col, label_col, **parameters).select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"))
