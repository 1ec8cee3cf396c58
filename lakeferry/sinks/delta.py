"""Tables under a log as destinations: preparing writes the files, publishing commits them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from lakeferry.deltalog.table import StagedMerge, Table, Txn, rows_of
from lakeferry.functions.types import ColumnSpec
from lakeferry.plans.outcome import Outcome


class DeltaSink:
    def __init__(self, spark: SparkSession, url: str, target: str, columns: Sequence[ColumnSpec] = (), *, merge_keys: Sequence[str] = (), allow_null_keys: bool = False, txn: Txn | None = None, max_rows: int | None = None, max_bytes: int | None = None):
        self.kind = "delta.merge" if merge_keys else "delta.overwrite"
        self.table, self.target, self.columns = Table(spark, url), target, list(columns)
        self.keys, self.nulls, self.txn, self.limits = list(merge_keys), allow_null_keys, txn, {"max_rows": max_rows, "max_bytes": max_bytes}
        self.adds: list[dict] = []
        self.source_rows: int | None = None
        self.staged: StagedMerge | None = None

    def prepare(self, df: DataFrame, columns: list[ColumnSpec]) -> None:
        self.own = columns
        if self.keys:
            self.staged = self.table.stage_merge(df, self.keys, columns=columns, allow_null_keys=self.nulls, txn=self.txn, **self.limits)
            self.source_rows = self.staged.source_rows
        else:
            own = self.table.ensure(df, columns)
            self.adds = self.table.stage(df, partitions=self.table.partitions(own, df), **self.limits)
            self.source_rows = rows_of(self.adds)

    def publish(self) -> Outcome:
        if self.keys:
            return Outcome(self.kind, self.target, commit=asdict(self.table.commit_merge(self.staged)))
        return Outcome(self.kind, self.target, commit={"version": self.table.replace(self.adds, self.own)})

    def abort(self) -> None:
        self.table.discard(self.staged.adds if self.staged else self.adds)
