"""Connected components of a graph that is a table of edges, by alternating large-star and small-star steps.

Each step joins the edges with the least neighbour of each node, so a node with very many neighbours is an aggregation with
partial sums and a join; no node's neighbours are ever gathered. The least neighbours are written to shared storage before
they are joined: both sides of the join are then plain scans, so that Spark can broadcast the smaller one where its files
are small, and can split a hot node's partition where they are not. Each round's edges are written too, which ends
their lineage; tables of rounds that are over are deleted. Tables are written by as many tasks as the counted edges of the
round before call for.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lakeferry.llm.base import cut, remove


#: Edges that a task writes, and tasks at least.
EDGES, TASKS = 100_000, 8


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, root for each node of the edges (columns a and b, of one sortable type); root is the least node it can reach.

    Loops and repeated edges change nothing; edges with a null end are ignored; without edges there are no rows.
    """
    spark = edges.sparkSession
    now, mark = _written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        few = lambda df, n=mark[0]: df.coalesce(max(TASKS, 2 * n // EDGES))
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(few(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))))
        large = cut(few(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()))
        lower = cut(few(large.groupBy("u").agg(F.min("v").alias("m"))))
        moved = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, (small, mark) = mark, _written(few(moved.union(lower).distinct()))
        for over in (now, least, large, lower):
            remove(spark, over)
        now = small
        if mark == last:
            break
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and what tells one set of edges from another, seen while they were written."""
    seen, h = Observation(), F.xxhash64("u", "v")
    table = cut(edges.observe(seen, F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")))
    return table, (seen.get["n"], seen.get["x"], seen.get["s"])


class Forest:
    """Components of the places 0 .. n - 1, joined by and by; memory holds one number for each place, however many pairs come."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            new = a != b
            if not new.any():
                return
            i, j, a, b = i[new], j[new], a[new], b[new]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Each place that isn't the least of its component, and that least one."""
        own = np.flatnonzero(self.root != np.arange(len(self.root)))
        return own, self.root[own]
