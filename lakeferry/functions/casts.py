"""The cast matrix: from one logical type to another, as Spark expressions that fail on bad values.

plan_cast() decides before anything runs: None for a column that stays as it is, an expression builder for one that is
cast, an error for a pair that can't be. Expressions are Catalyst's own, so a cast stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeferry.functions.types import ColumnSpec, SchemaError, from_schema
from lakeferry.operators.schema import layered

Cast = Callable[[Column], Column]

UUID_TEXT = "^[0-9A-Fa-f]{8}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{12}$"
TEXTS = ("varchar", "text")
WHOLE = ("smallint", "integer", "bigint")
NUMBERS = (*WHOLE, "numeric", "real", "double")
TIMES = ("timestamp", "timestamptz")
BYTES = ("bytea", "custom", "fixedsizebinary")
WHOLE_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class CastError(SchemaError):
    """A pair of types between which there is no cast."""


def uuid_from_text(c: Column) -> Column:
    """Sixteen bytes; anything but a uuid's text raises."""
    bad = F.raise_error(F.concat(F.lit("not a uuid: "), c)).cast("binary")
    return F.when(c.isNull(), F.lit(None).cast("binary")).when(c.rlike(UUID_TEXT), F.unhex(F.regexp_replace(c, "-", ""))).otherwise(bad)


def uuid_to_text(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.hex(c), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def at_unit(c: Column, spec: ColumnSpec) -> Column:
    """A time cut to the unit's precision; what Spark holds is microseconds, so nanoseconds stay as they are read."""
    unit = {"Second": "SECOND", "Millis": "MILLISECOND"}.get(spec.time_unit)
    return c if unit is None else F.date_trunc(unit, c).cast(spec.spark_type())


def scaled(c: Column, precision: int, scale: int) -> Column:
    """The number that whole digits stand for, `scale` of them behind the point."""
    return (c.cast("decimal(38,0)") * F.lit(Decimal(1).scaleb(-scale))).cast(T.DecimalType(precision, scale))


def castable(source: ColumnSpec, target: ColumnSpec) -> bool:
    a, b = source.kind, target.kind
    if a in NUMBERS + ("boolean",) and b in NUMBERS + TEXTS + ("boolean",):
        return True
    if a in TEXTS + ("jsonb",):
        return b in NUMBERS + TEXTS + TIMES + ("jsonb", "boolean", "date") + BYTES
    if a in TIMES + ("date",):
        return b in TIMES + TEXTS + ("date",)
    return a in BYTES + ("uuid",) and b in BYTES


def plan_cast(source: ColumnSpec, target: ColumnSpec, physical: T.DataType) -> Cast | None:
    """How a column of logical type `source`, held as `physical`, becomes `target`; None: it stays."""
    to = target.spark_type()
    of_digits = source.kind == "numeric" and source.scale > 0 and isinstance(physical, WHOLE_TYPES)
    same = physical == to and source.kind in (target.kind, *({"varchar", "text", "jsonb"} if target.kind in ("varchar", "text", "jsonb") else ()))
    if target.kind == "uuid":
        if source.kind in TEXTS:
            return uuid_from_text
        if source.kind == "uuid" or source.kind == "fixedsizebinary" and source.size == 16:
            return None
        raise CastError(f"column {source.name!r}: no cast from {source.kind} to uuid")
    if source.kind == "uuid" and target.kind in TEXTS:
        return uuid_to_text
    if source.kind == "numeric" and source.scale > 0:
        if target.kind in WHOLE:
            raise CastError(f"column {source.name!r}: numeric with scale {source.scale} has no cast to {target.kind}")
        if of_digits:
            if target.kind == "double":
                return lambda c: c.cast("double") / F.lit(10.0**source.scale)
            if target.kind == "numeric" and target.scale == source.scale:
                return lambda c: scaled(c, target.precision, source.scale)
            return lambda c: scaled(c, max(source.precision, source.scale), source.scale).cast(to)
    if source.kind in TIMES and target.kind in TIMES:
        if same and (source.time_unit == target.time_unit or target.time_unit in ("Micros", "Nanos")):
            return None
        return lambda c: at_unit(c.cast(to), target)
    if same and (source.kind != "numeric" or (source.precision, source.scale) == (target.precision, target.scale)):
        return None
    if not castable(source, target):
        raise CastError(f"column {source.name!r}: no cast from {source.kind} to {target.kind}")
    if source.kind in TEXTS and target.kind == "bytea":
        return lambda c: c.cast("binary")
    if target.kind in TIMES:
        return lambda c: at_unit(c.cast(to), target)
    return lambda c: c.cast(to)


def apply_casts(df: DataFrame, columns: list[ColumnSpec], *, source: list[ColumnSpec | None] | None = None) -> tuple[DataFrame, list[ColumnSpec]]:
    """df with its columns cast as `columns` say, and the resulting specs.

    `columns` neither project nor reorder; entries that name no column of df are passed over. Names are taken from the specs, but
    only if any column is cast at all; else df passes as it is. source: what is known of df's columns beyond their types.
    """
    own = layered(from_schema(df.schema), [source] if source else [])
    target = layered(own, [columns] if columns else [])
    plans = [plan_cast(a, b, f.dataType) for a, b, f in zip(own, target, df.schema.fields, strict=True)]
    if not any(plans):
        return df, [t.renamed(f.name) for t, f in zip(target, df.schema.fields, strict=True)]
    out = []
    for f, spec, plan in zip(df.schema.fields, target, plans, strict=True):
        c = F.col(f"`{f.name}`")
        out.append((plan(c) if plan else c).alias(spec.name, metadata=spec.field().metadata))
    return df.select(*out), target
