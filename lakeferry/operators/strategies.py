"""What merges share: refusals, the rows that they replace, and their counts.

The probe is a semi join that is left to Catalyst, which broadcasts keys that are few and shuffles otherwise, splitting skewed
partitions; target rows are read once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class MergeError(ValueError):
    """A merge that its rows forbid."""


def _aliased(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise MergeError(f"unknown key {missing[0]!r}")
    return df.select(*(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)))


def _matches(target: DataFrame, keys: Sequence[str], null_safe: bool) -> Column:
    out: Column = F.lit(True)
    for i, k in enumerate(keys):
        a, b = target[f"`{k}`"], F.col(f"__k{i}")
        out = out & (a.eqNullSafe(b) if null_safe else a == b)
    return out


def refuse_nulls(keys: Sequence[str], nulls: Sequence[int | None]) -> None:
    """nulls: how many rows of the source have a null in each key."""
    for k, n in zip(keys, nulls, strict=True):
        if n:
            raise MergeError(f"{n} source rows have a null in key {k!r}")


def matched_rows(target: DataFrame, source: DataFrame, keys: Sequence[str], *, null_safe: bool = False) -> DataFrame:
    """The target rows whose key the source has."""
    return target.join(_aliased(source, keys), _matches(target, keys, null_safe), "left_semi")


@dataclass(frozen=True)
class MergeStats:
    source_rows: int
    matched_rows: int
    inserted_rows: int
    files_written: int = 0
    files_removed: int = 0
    skipped: bool = False
    skipped_version: int | None = None
