"""Parquet files under names of one's own: written below a hidden folder by one job, moved to their names when all is well."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeferry.functions.types import ColumnSpec
from lakeferry.plans.outcome import Outcome
from lakeferry.sources.store import Store


class FileNameError(ValueError):
    """File names that would collide."""


class ParquetSink:
    """namer gives the name of file k. A name without the index is one file, which one task writes; with it, files are as many as
    partitions, none longer than max_rows, and split further until none is larger than about max_bytes."""

    kind = "pq"
    source_rows: int | None = None

    def __init__(self, spark: SparkSession, url: str, target: str, namer: Callable[[int], str], columns: Sequence[ColumnSpec] = (), *, bloom_filters: Sequence[Sequence[str]] = (), max_rows: int | None = None, max_bytes: int | None = None):
        self.target, self.columns, self.namer = target, list(columns), namer
        self.one = namer(0) == namer(1)
        if self.one and (max_rows or max_bytes):
            raise FileNameError(f"{target}: files rotate, but their name {namer(0)!r} doesn't hold the index")
        self.store, self.bloom, self.max_rows, self.max_bytes = Store(spark, url), bloom_filters, max_rows, max_bytes
        self.folder = f"_staging-{uuid.uuid4().hex}"

    def _write(self, df: DataFrame, rows: int | None) -> None:
        writer = df.write.mode("overwrite").option("compression", "snappy").option("parquet.writer.version", "PARQUET_2_0")
        if rows:
            writer = writer.option("maxRecordsPerFile", rows)
        for path in self.bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{'.'.join(path)}", "true")
        writer.parquet(self.store.full(self.folder))

    def prepare(self, df: DataFrame, columns: list[ColumnSpec]) -> None:
        self.schema = df.schema
        # One file is one task's to write, but the scan and the casts before it stay parallel.
        self._write(df.repartition(1) if self.one else df, self.max_rows)
        self.files = self._files()
        if self.max_bytes and max((x.size for x in self.files), default=0) > self.max_bytes:
            # Bytes are known only once written: so many rows a file as have them on average.
            rows = self._counted()
            per = max(1, math.floor(sum(rows.values()) * self.max_bytes / max(1, sum(x.size for x in self.files))))
            before, self.folder = self.folder, f"_staging-{uuid.uuid4().hex}"
            try:  # from what is written already: the source runs once
                self._write(self.store.spark.read.schema(self.schema).parquet(self.store.full(before)), min(per, self.max_rows or per))
            finally:
                self.store.delete(before)
            self.files = self._files()
        self.rows = self._counted()
        self.source_rows = sum(self.rows.values())
        if empty := [x for x in self.files if not self.rows.get(x.path.rpartition("/")[2])]:
            # Empty partitions leave no file; an empty load leaves one, so that no older file passes for its result.
            full = [x for x in self.files if x not in empty]
            self.files = full or empty[:1]

    def _files(self):
        return [x for x in self.store.list(self.folder) if x.path.endswith(".parquet")]

    def _counted(self) -> dict[str, int]:
        if not self.files:
            return {}
        df = self.store.spark.read.schema(self.schema).parquet(self.store.full(self.folder))
        return {r.name: r["count"] for r in df.groupBy(F.col("_metadata.file_name").alias("name")).count().collect()}

    def publish(self) -> Outcome:
        out = Outcome(self.kind, self.target)
        for k, x in enumerate(self.files):
            name = "/".join(p for p in self.namer(k).split("/") if p)
            self.store.rename(x.path, name)
            out.files.append({"path": self.store.full(name), "rows": self.rows.get(x.path.rpartition("/")[2], 0), "size_bytes": x.size})
        self.store.delete(self.folder)
        return out

    def abort(self) -> None:
        self.store.delete(self.folder)
