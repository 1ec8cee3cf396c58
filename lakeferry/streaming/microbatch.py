"""Upserts and appends from a stream: each micro-batch is one load, numbered by its batch id, so that a repeated batch commits nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeferry.deltalog.table import Table, Txn


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of rows with equal keys the one that is greatest in `order`, by an aggregation with partial results instead of a sort."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(F.col(order), F.xxhash64(*others))).alias("__best"))
    return best.select(*(F.col(c) if c in keys else F.col(f"__best.{c}").alias(c) for c in df.columns))


def upsert_stream(stream: DataFrame, url: str, keys: Sequence[str], *, app_id: str, checkpoint: str, order: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Merge a stream into a table under a log. order: of several rows of a key in one batch the greatest counts; without it all come."""

    def load(batch: DataFrame, batch_id: int) -> None:
        own = latest(batch, keys, order) if order else batch
        Table(batch.sparkSession, url).merge(own, keys, txn=Txn(app_id, batch_version=batch_id))

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
