"""Logical column types, in SQL's vocabulary, and what they are in Spark.

A ColumnSpec names a logical type and its parameters. Spark types alone can't tell a uuid from bytes or json from text, so
specs travel beside a DataFrame, and in the metadata of its fields where those survive.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import types as T

UNITS = ("Second", "Millis", "Micros", "Nanos")

#: Each logical type's parameters, and other names that configuration may use for it.
PARAMETERS: dict[str, tuple[str, ...]] = {
    "varchar": ("length",), "text": (), "timestamptz": ("time_unit",), "timestamp": ("time_unit",), "uuid": (), "jsonb": (),
    "numeric": ("precision", "scale"), "real": (), "double": (), "smallint": (), "integer": (), "bigint": (), "boolean": (),
    "date": (), "custom": ("ddl_type",), "fixedsizebinary": ("size",), "bytea": (),
}
ALIASES = {"float8": "double", "int4": "integer", "int": "integer", "int8": "bigint"}
#: What a parameter's type hint may be called.
HINTS = {
    "UUID": "uuid", "INT": "integer", "INTEGER": "integer", "BIGINT": "bigint", "INT8": "bigint", "SMALLINT": "smallint", "INT2": "smallint",
    "BOOL": "boolean", "BOOLEAN": "boolean", "TEXT": "text", "TIMESTAMP": "timestamp", "TIMESTAMPTZ": "timestamptz", "REAL": "real", "FLOAT4": "real",
    "DOUBLE": "double", "FLOAT8": "double", "DATE": "date", "JSONB": "jsonb", "BYTEA": "bytea",
}


class SchemaError(ValueError):
    """A column that has no logical type, or a description that makes none."""


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str
    length: int | None = None
    time_unit: str | None = None
    precision: int | None = None
    scale: int | None = None
    ddl_type: str | None = None
    size: int | None = None

    def __post_init__(self) -> None:
        if self.kind not in PARAMETERS:
            raise SchemaError(f"unknown column type {self.kind!r}")
        for p in ("length", "time_unit", "precision", "scale", "ddl_type", "size"):
            if (getattr(self, p) is None) == (p in PARAMETERS[self.kind]):
                raise SchemaError(f"{self.kind} {'needs' if p in PARAMETERS[self.kind] else 'has no'} {p}")
        if self.time_unit is not None and self.time_unit not in UNITS:
            raise SchemaError(f"unknown time unit {self.time_unit!r}")

    @classmethod
    def parse(cls, entry: dict[str, Any]) -> ColumnSpec:
        """From a configuration entry: type, name and the type's parameters, nothing else."""
        own = dict(entry)
        try:
            given, name = str(own.pop("type")), str(own.pop("name"))
        except KeyError as e:
            raise SchemaError(f"a column needs {e.args[0]!r}: {entry}") from None
        kind = ALIASES.get(given.lower(), given.lower())
        if kind not in PARAMETERS or given not in (given.lower(), given.upper()):
            raise SchemaError(f"unknown column type {given!r}")
        if unknown := set(own) - set(PARAMETERS[kind]):
            raise SchemaError(f"column {name!r}: unknown field {sorted(unknown)[0]!r}")
        return cls(name, kind, **own)

    def as_dict(self) -> dict[str, Any]:
        return {"type": self.kind, "name": self.name} | {p: getattr(self, p) for p in PARAMETERS[self.kind]}

    def renamed(self, name: str) -> ColumnSpec:
        return replace(self, name=name)

    @property
    def of_integers(self) -> bool:
        """A numeric that fits a whole number's type, being held as one."""
        return self.kind == "numeric" and self.scale == 0 and self.precision <= 9

    def spark_type(self) -> T.DataType:
        if self.kind == "numeric":
            if self.of_integers:
                return T.ByteType() if self.precision <= 2 else T.ShortType() if self.precision <= 4 else T.IntegerType()
            return T.DecimalType(self.precision, self.scale)
        return {
            "varchar": T.StringType(), "text": T.StringType(), "jsonb": T.StringType(), "timestamptz": T.TimestampType(), "timestamp": T.TimestampNTZType(),
            "uuid": T.BinaryType(), "real": T.FloatType(), "double": T.DoubleType(), "smallint": T.ShortType(), "integer": T.IntegerType(), "bigint": T.LongType(),
            "boolean": T.BooleanType(), "date": T.DateType(), "custom": T.BinaryType(), "fixedsizebinary": T.BinaryType(), "bytea": T.BinaryType(),
        }[self.kind]

    def field(self) -> T.StructField:
        return T.StructField(self.name, self.spark_type(), True, {"logical": self.kind} | {p: getattr(self, p) for p in PARAMETERS[self.kind]})

    def ddl(self) -> str:
        """The type in a CREATE TABLE of PostgreSQL."""
        fixed = {"varchar": f"varchar({self.length})", "numeric": f"numeric({self.precision}, {self.scale})", "double": "double precision", "custom": self.ddl_type, "fixedsizebinary": "bytea"}
        return fixed.get(self.kind, self.kind)

    def delta_type(self) -> str:
        """The type in a table log's schema."""
        if self.kind == "numeric":
            return {"ByteType": "byte", "ShortType": "short", "IntegerType": "integer"}.get(type(self.spark_type()).__name__, f"decimal({self.precision},{self.scale})")
        return {
            "varchar": "string", "text": "string", "jsonb": "string", "timestamptz": "timestamp", "timestamp": "timestamp_ntz", "uuid": "binary", "real": "float", "double": "double",
            "smallint": "short", "integer": "integer", "bigint": "long", "boolean": "boolean", "date": "date", "custom": "binary", "fixedsizebinary": "binary", "bytea": "binary",
        }[self.kind]


def hinted(hint: str) -> str:
    """The logical type that a parameter's hint names."""
    try:
        return HINTS[hint.upper()]
    except KeyError:
        raise SchemaError(f"unknown type hint {hint!r}") from None


def _spec(name: str, kind: str, **more: Any) -> ColumnSpec:
    return ColumnSpec(name, kind, **({"time_unit": "Micros"} if kind in ("timestamp", "timestamptz") and "time_unit" not in more else {}) | more)


def from_field(field: T.StructField) -> ColumnSpec:
    """The logical type of a Spark field: what its metadata say, else what its type is. Nested types have none."""
    own = dict(field.metadata or {})
    if own.get("logical") in PARAMETERS:
        return ColumnSpec(field.name, own["logical"], **{p: own[p] for p in PARAMETERS[own["logical"]]})
    t = field.dataType
    if isinstance(t, T.DecimalType):
        return _spec(field.name, "numeric", precision=t.precision, scale=t.scale)
    if isinstance(t, T.VarcharType):
        return _spec(field.name, "varchar", length=t.length)
    kind = {
        "StringType": "text", "CharType": "text", "ByteType": "smallint", "ShortType": "smallint", "IntegerType": "integer", "LongType": "bigint", "FloatType": "real", "DoubleType": "double",
        "BooleanType": "boolean", "DateType": "date", "TimestampType": "timestamptz", "TimestampNTZType": "timestamp", "BinaryType": "bytea",
    }.get(type(t).__name__)
    if kind is None:
        raise SchemaError(f"column {field.name!r}: no logical type for {t.simpleString()}")
    return _spec(field.name, kind)


def from_schema(schema: T.StructType) -> list[ColumnSpec]:
    return [from_field(f) for f in schema.fields]


def from_warehouse(field: T.StructField) -> ColumnSpec | None:
    """The logical type that a warehouse driver's field metadata name (logicalType, precision, scale, charLength), if any."""
    own = {k: v for k, v in (field.metadata or {}).items()}
    number = lambda k, d: int(own.get(k, d))
    kind = str(own.get("logicalType", "")).upper()
    if kind == "FIXED":
        return _spec(field.name, "numeric", precision=number("precision", 38), scale=number("scale", 0))
    if kind == "TEXT":
        length = number("charLength", 0)
        # The warehouse's own unbounded length, and the longest varchar there is.
        return _spec(field.name, "text") if length == 16777216 or length > 10485760 or not length else _spec(field.name, "varchar", length=length)
    simple = {"REAL": "double", "BOOLEAN": "boolean", "DATE": "date", "BINARY": "bytea", "VARIANT": "jsonb", "OBJECT": "jsonb", "ARRAY": "jsonb", "TIMESTAMP_NTZ": "timestamp", "TIMESTAMP_TZ": "timestamptz", "TIMESTAMP_LTZ": "timestamptz"}.get(kind)
    return _spec(field.name, simple) if simple else None


def from_footer(file: Any) -> list[ColumnSpec | None]:
    """What the footer of a Parquet file (a path, or a file object that ends with it) says of its columns, read on the driver; None where it
    has no opinion. Tells uuid and json, which Spark's schema doesn't."""
    import pyarrow.parquet as pq

    schema = pq.ParquetFile(file).schema
    out = []
    for k in range(len(schema.names)):
        c = schema.column(k)
        kind, name = c.logical_type.type, c.name
        if c.max_definition_level > 1 or c.max_repetition_level:
            out.append(None)
        elif kind == "UUID":
            out.append(_spec(name, "uuid"))
        elif kind == "JSON":
            out.append(_spec(name, "jsonb"))
        elif kind == "STRING":
            out.append(_spec(name, "text"))
        elif kind == "DECIMAL":
            out.append(_spec(name, "numeric", precision=c.precision, scale=c.scale))
        elif kind == "TIMESTAMP":
            text = str(c.logical_type)
            unit = "Millis" if "milliseconds" in text else "Nanos" if "nanoseconds" in text else "Micros"
            out.append(_spec(name, "timestamptz" if "isAdjustedToUTC=true" in text else "timestamp", time_unit=unit))
        elif kind == "NONE":
            simple = {"FLOAT": "real", "DOUBLE": "double", "INT32": "integer", "INT64": "bigint", "BOOLEAN": "boolean"}.get(c.physical_type)
            out.append(_spec(name, simple) if simple else None)
        else:
            out.append(None)
    return out
