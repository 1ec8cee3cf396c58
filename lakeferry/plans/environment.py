"""What the environment says: locations by tiers, parameters with types, template variables. All names start with FERRY_."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from lakeferry.functions.types import hinted
from lakeferry.plans.templates import shouty

PREFIX = "FERRY_"
#: Endings of a parameter's name that tell its type.
HINT_ENDINGS = ("UUID", "INT", "BIGINT", "SMALLINT", "BOOL", "TIMESTAMP", "TIMESTAMPTZ", "TEXT", "VARCHAR", "REAL", "DOUBLE", "DATE", "JSONB", "BYTEA")


class MissingVariable(KeyError):
    """A variable that must be set and isn't."""

    def __str__(self) -> str:
        return str(self.args[0])


@dataclass(frozen=True)
class Parameter:
    name: str
    value: str
    kind: str | None = None

    def typed(self) -> Any:
        """The value, as a Python value that Spark's parameters take."""
        import datetime
        from decimal import Decimal

        read = {
            "smallint": int, "integer": int, "bigint": int, "real": float, "double": float, "numeric": Decimal, "date": datetime.date.fromisoformat,
            "timestamp": datetime.datetime.fromisoformat, "timestamptz": datetime.datetime.fromisoformat, "boolean": lambda v: {"true": True, "1": True, "t": True, "false": False, "0": False, "f": False}[v.lower()],
            "bytea": bytes.fromhex,
        }.get(self.kind, str)
        try:
            return read(self.value)
        except (ValueError, KeyError):
            raise ValueError(f"parameter {self.name}: {self.value!r} is no {self.kind}") from None


class Environment:
    def __init__(self, variables: Mapping[str, str]):
        self.variables = {k: v for k, v in variables.items() if k.upper().startswith(PREFIX)}

    def get(self, *names: str) -> str | None:
        """The first of these that is set, whatever the case of its letters."""
        low = {k.lower(): v for k, v in self.variables.items()}
        return next((low[n.lower()] for n in names if n.lower() in low), None)

    def location(self, base: str, ident: str, kind: str) -> str:
        """The most specific location: FERRY_SRC_<ident>, _<IDENT_IN_CAPITALS>, _<KIND>, or FERRY_SRC alone; likewise FERRY_DEST."""
        tried = [f"{PREFIX}{base}_{ident}", f"{PREFIX}{base}_{shouty(ident)}", f"{PREFIX}{base}_{kind.upper()}", f"{PREFIX}{base}"]
        if (found := self.get(*tried)) is None:
            raise MissingVariable(f"no location; set one of {', '.join(tried)}")
        return found

    def kind_of(self, base: str) -> str | None:
        """The kind that a location's URL tells."""
        url = self.get(f"{PREFIX}{base}")
        if url is None:
            return None
        low = url.lower()
        for start, kind in (("snowflake", "sf"), ("delta+", "delta"), ("postgres://", "pg"), ("postgresql://", "pg"), ("jdbc:", "pg")):
            if low.startswith(start):
                return kind
        return "file" if re.match(r"^(file|s3a?|gs|az|abfss?|adl|https?|hdfs|memory|viewfs)://", low) else None

    @property
    def template_variables(self) -> dict[str, str]:
        start = f"{PREFIX}TEMPL_"
        return {k[len(start) :]: v for k, v in self.variables.items() if k.startswith(start)}

    @property
    def parameters(self) -> list[Parameter]:
        """By name; an ending that names a type is cut off and tells it."""
        start, out = f"{PREFIX}PARAM_", []
        for k, v in self.variables.items():
            if k.startswith(start):
                name, kind = k[len(start) :], None
                for end in HINT_ENDINGS:
                    if name.endswith(f"_{end}"):
                        name, kind = name[: -len(end) - 1], hinted(end) if end != "VARCHAR" else "text"
                        break
                out.append(Parameter(name, v, kind))
        return sorted(out, key=lambda p: p.name)

    def parameters_for(self, table: str) -> list[Parameter]:
        """Those whose names start with the table's; if it has none, those without an underscore."""
        start = f"{shouty(table)}_"
        own = [p for p in self.parameters if p.name.startswith(start)]
        return own or [p for p in self.parameters if "_" not in p.name]

    def parameters_named(self, keys: Sequence[str]) -> list[Parameter]:
        """In the order of the keys; each must be set."""
        by = {p.name.lower(): p for p in reversed(self.parameters)}
        missing = [k for k in keys if k.lower() not in by]
        if missing:
            raise MissingVariable(f"expected {len(keys)} parameters, {len(keys) - len(missing)} are set; missing: {', '.join(missing)}")
        return [by[k.lower()] for k in keys]

    def key_value(self, table: str, column: str) -> Parameter:
        """The value of a column to delete by: FERRY_PARAM_<TABLE>_<COLUMN>, or FERRY_PARAM_<COLUMN>."""
        names = (f"{shouty(table)}_{shouty(column)}", shouty(column))
        by = {p.name.upper(): p for p in self.parameters}
        for n in names:
            if n in by:
                return by[n]
        raise MissingVariable(f"no value for {column}; set {PREFIX}PARAM_{names[0]} or {PREFIX}PARAM_{names[1]}")
