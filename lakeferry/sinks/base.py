"""The contract of a sink: prepare() does the work that can fail and leaves nothing visible; publish() makes it visible; abort() takes it back.

source_rows: how many rows came, once that is known; None if the sink has not run its input."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

from lakeferry.functions.types import ColumnSpec
from lakeferry.plans.outcome import Outcome


class Sink(Protocol):
    kind: str
    target: str
    columns: list[ColumnSpec]
    source_rows: int | None

    def prepare(self, df: DataFrame, columns: list[ColumnSpec]) -> None: ...

    def publish(self) -> Outcome: ...

    def abort(self) -> None: ...
