"""What a task did, as a line of its report."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Outcome:
    """One destination: its kind and target, an error or what it wrote."""

    kind: str
    target: str
    error: str | None = None
    files: list[dict[str, Any]] = field(default_factory=list)
    commit: dict[str, Any] | None = None


@dataclass
class Phase:
    name: str
    rows: int
    source_columns: list[dict[str, Any]]
    destinations: list[Outcome]

    def line(self) -> str:
        return json.dumps(asdict(self), default=str)

    def outputs_of(self, kind: str, target: str | None = None) -> list[str]:
        """For hooks: the files, or else the targets, that destinations of a kind (or a kind before its dot) have written."""
        own = [d for d in self.destinations if not d.error and kind in (d.kind, d.kind.partition(".")[0]) and target in (None, d.target)]
        return [p for d in own for p in ([f["path"] for f in d.files] or [d.target])]

    @property
    def failures(self) -> list[str]:
        return [f"{d.kind} {d.target}: {d.error}" for d in self.destinations if d.error]


class TaskError(RuntimeError):
    """A task with failed destinations or hooks."""


def as_rows(spark: SparkSession, phases: Sequence[Phase]) -> DataFrame:
    """One row for each destination of each task."""
    rows = [(p.name, p.rows, d.kind, d.target, d.error is None, len(d.files), sum(f["rows"] for f in d.files)) for p in phases for d in p.destinations]
    return spark.createDataFrame(rows, "task string, rows long, kind string, target string, ok boolean, files int, written long")
