"""Logical types of database columns, from what a JDBC driver says of them."""

from __future__ import annotations

from lakeferry.functions.types import ColumnSpec

#: Codes of java.sql.Types without parameters.
SIMPLE = {-7: "boolean", 16: "boolean", -6: "smallint", 5: "smallint", 4: "integer", -5: "bigint", 7: "real", 6: "double", 8: "double", -1: "text", 2005: "text", 91: "date", -4: "bytea", -3: "bytea", -2: "bytea", 2004: "bytea"}
#: Types that drivers call something else, by their own names.
NAMED = {"uuid": "uuid", "json": "jsonb", "jsonb": "jsonb", "text": "text", "timestamptz": "timestamptz"}
NUMERIC, TEXTS, TIMES, ZONED = (2, 3), (1, 12), 93, 2014


def from_jdbc(name: str, code: int, size: int, digits: int, type_name: str = "") -> ColumnSpec | None:
    """size and digits: length of a text, precision and scale of a number; of times digits are those of fractions of a second."""
    unit = "Second" if digits == 0 else "Millis" if 0 < digits <= 3 else "Micros"
    if (kind := NAMED.get(type_name.lower())) is not None:
        return ColumnSpec(name, kind, time_unit=unit) if kind == "timestamptz" else ColumnSpec(name, kind)
    if code in NUMERIC:
        return ColumnSpec(name, "numeric", precision=size, scale=digits) if 0 < size <= 38 else None
    if code in TEXTS:
        return ColumnSpec(name, "varchar", length=size) if 0 < size < 1 << 20 else ColumnSpec(name, "text")
    if code in (TIMES, ZONED):
        return ColumnSpec(name, "timestamptz" if code == ZONED else "timestamp", time_unit=unit)
    return ColumnSpec(name, SIMPLE[code]) if code in SIMPLE else None
