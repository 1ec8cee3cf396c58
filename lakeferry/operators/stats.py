"""Statistics of files and keys: counts, nulls, least and greatest values; watermarks."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered(t: T.DataType) -> bool:
    return isinstance(t, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType, T.BinaryType))


def file_stats(df: DataFrame, by: Sequence[Column] = ()) -> DataFrame:
    """num_records, and null_count_, min_ and max_ of each column; one row, or one for each file or other group `by`."""
    n = F.count("*")
    if by:
        # Least and greatest texts don't fit a hash aggregate's rows, and Spark would sort all rows by group. An aggregate of objects, here of
        # nothing but nulls, makes it keep one row of objects for each group instead.
        n = n + F.size(F.collect_set(F.lit(None).cast("int")))
    aggs = [n.alias("num_records")]
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        aggs.append(F.count_if(c.isNull()).alias(f"null_count_{f.name}"))
        if ordered(f.dataType) and not isinstance(f.dataType, T.BooleanType):
            aggs += [F.min(c).alias(f"min_{f.name}"), F.max(c).alias(f"max_{f.name}")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def as_watermark(c: Column, t: T.DataType) -> Column:
    """A whole number that grows with the value: of whole numbers themselves, of dates days, of times microseconds."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long")
    if isinstance(t, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(t, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(t, T.TimestampNTZType):
        # Without a zone, and so without the session's.
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
    raise ValueError(f"{t.simpleString()} makes no watermark")


def watermark(df: DataFrame, column: str) -> DataFrame:
    """One row: the greatest value of the column as a whole number, null if there is none."""
    return df.agg(F.max(as_watermark(F.col(f"`{column}`"), df.schema[column].dataType)).alias("watermark"))


def is_stale(version: int | None, committed: int | None) -> bool:
    """Is what has been committed as new as this version?"""
    return committed is not None and version is not None and committed >= version


def stat_text(v: Any, t: T.DataType) -> Any:
    """A value as a table log's statistics write it: dates and times (to the millisecond, Z if zoned) and decimals as texts."""
    if v is None or isinstance(v, (bool, int)):
        return v
    if isinstance(v, float):
        return v if v - v == 0 else None
    if isinstance(v, Decimal):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.strftime("%Y-%m-%dT%H:%M:%S.") + f"{v.microsecond // 1000:03d}" + "Z" * isinstance(t, T.TimestampType)
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return "".join(f"\\u{b:04x}" for b in v)
    return v
