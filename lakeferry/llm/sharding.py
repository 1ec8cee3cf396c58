"""Sharding by Karmarkar-Karp differencing: rows of equal text stay together, and shards get near-equal bytes.

Differencing starts from one partial partition for each indivisible item (the item in one shard, nothing in the
others) and again and again combines the two partial partitions with the largest spread, the fullest shard of one
upon the emptiest of the other, until one is left. Groups of equal text are unbounded in number, so the driver
never sees them all: a group that holds at least 1/parts of the bytes is an item of its own (there can be no more
than `parts` of those), and all smaller groups fall by a hash of their text into `parts` bundles, which are items too.
So at most 2 x parts items are combined on the driver, whatever the corpus, and no group is ever split.

Slots number the rows of a shard from 0 without gaps, by ascending id. They come from the positions of rows in a
table written in shard order: a count per file and shard is all that is gathered.

A null text counts no bytes and groups with other null texts; equal rows get slots of their own in some order;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeferry.llm.base import cut, keyed

#: Bundles, and at most as many groups of their own.
PARTS = 8192


def karmarkar_karp(sizes: Sequence[int], shards: int) -> list[int]:
    """The shard of each item. Ties go by the order of items, so that equal input gives an equal result."""
    if not sizes:
        return []
    parent = list(range(len(sizes) * shards))  # of nodes: node k * shards + s is shard s of the partial partition k

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    heap = []
    for k, n in enumerate(sizes):
        own = [(0, k * shards + s) for s in range(shards - 1)] + [(n, k * shards + shards - 1)]
        heap.append((-n, k, own))
    heapq.heapify(heap)
    new = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = []
        for (x, i), (y, j) in zip(a, reversed(b), strict=True):
            parent[root(j)] = root(i)
            both.append((x + y, i))
        both.sort()
        heapq.heappush(heap, (both[0][0] - both[-1][0], new, both))
        new += 1
    shard = {root(i): s for s, (_, i) in enumerate(heap[0][2])}
    return [shard[root(k * shards + shards - 1)] for k in range(len(sizes))]


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, parts: int = PARTS) -> DataFrame:
    """doc_id, size, text_crc32, shard of each row: size is the text's UTF-8 bytes plus 1."""
    spark = df.sparkSession
    rows = keyed(df, id_col, text_col).select(
        F.col("id").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.coalesce(F.sha2("text", 256), F.lit("")).alias("digest"),
    )
    rows = rows.withColumn("bundle", F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int"))
    groups = cut(rows.groupBy("digest", "bundle").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    own = F.col("bytes") >= max(1, total // parts + 1)  # fewer than `parts` groups can be so large
    large = [(r.digest, r.bytes) for r in groups.where(own).orderBy("digest").collect()]
    bundles = [(r.bundle, r.bytes) for r in groups.where(~own).groupBy("bundle").agg(F.sum("bytes").alias("bytes")).orderBy("bundle").collect()]
    shard = karmarkar_karp([n for _, n in large + bundles], shards)
    of_large = spark.createDataFrame([(d, s) for (d, _), s in zip(large, shard, strict=False)], "digest string, own_shard int")
    of_bundle = spark.createDataFrame([(b, s) for (b, _), s in zip(bundles, shard[len(large) :], strict=True)], "bundle int, bundle_shard int")
    # Both tables have at most `parts` rows.
    placed = rows.join(F.broadcast(of_large), "digest", "left").join(F.broadcast(of_bundle), "bundle", "left")
    return placed.select("doc_id", "size", "text_crc32", F.coalesce("own_shard", "bundle_shard").alias("shard"))


def slotted(placed: DataFrame) -> DataFrame:
    """The rows of assign() with slot: 0, 1, 2, ... in each shard, by ascending doc_id."""
    order = ["shard", "doc_id", "text_crc32", "size"]
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = cut(placed.repartitionByRange(n, *order).sortWithinPartitions(*order))
    table = table.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    runs = table.groupBy("file", "shard").agg(F.min("row").alias("first"), F.count("*").alias("n"), F.min(F.struct("doc_id", "text_crc32", "size")).alias("least"))
    # One row for each file and shard: a file holds a stretch of the shard order.
    before, start = 0, []
    shard = None
    for r in sorted(runs.collect(), key=lambda r: (r.shard, [(x is not None, x) for x in r.least], r.file)):
        before = before if r.shard == shard else 0
        shard = r.shard
        start.append((r.file, r.shard, before - r.first))
        before += r.n
    starts = placed.sparkSession.createDataFrame(start, "file string, shard int, shift long")
    return table.join(F.broadcast(starts), ["file", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("row") + F.col("shift")).alias("slot"))


def shard_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, parts: int = PARTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row; the law is `bytes`, for which no grown shard exists."""
    out = slotted(assign(df, id_col, text_col, shards, parts))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
