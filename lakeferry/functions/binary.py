"""Texts of binary values, and strict reading of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_text(c: Column) -> Column:
    """Lower-case hexadecimal digits."""
    return F.lower(F.hex(c))


def from_hex(c: Column) -> Column:
    """Bytes of hexadecimal digits; anything else raises."""
    good = c.rlike("^(?:[0-9A-Fa-f]{2})*$")
    return F.when(c.isNull(), F.lit(None).cast("binary")).when(good, F.unhex(c)).otherwise(F.raise_error(F.concat(F.lit("not hexadecimal: "), c)).cast("binary"))


def json_key(c: Column, key: str) -> Column:
    """The text of a top-level key of JSON text, null if there is none."""
    return F.get_json_object(c, f"$.{key}")
