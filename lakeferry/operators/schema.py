"""Schema resolution: layers of knowledge about columns, and the difference between two schemas."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from lakeferry.functions.types import ColumnSpec


def same_name(a: str, b: str) -> bool:
    """Names are equal whatever the case of their ASCII letters."""
    fold = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    return fold(a) == fold(b)


def layered(base: Sequence[ColumnSpec], layers: Sequence[Sequence[ColumnSpec | None] | None]) -> list[ColumnSpec]:
    """The columns of base, in its order, each as the last layer that knows it says.

    Within a layer the first entry of a name counts and serves one column only; entries without a column are passed over.
    """
    out = list(base)
    for layer in layers:
        left = [c for c in layer or () if c is not None]
        for k, own in enumerate(base):
            found = next((i for i, c in enumerate(left) if same_name(c.name, own.name)), None)
            if found is not None:
                out[k] = left.pop(found)
    return out


@dataclass(frozen=True)
class SchemaChange:
    """What turns one schema into another. changes: for each current column None, `modified` or `removed`."""

    columns: list[ColumnSpec]
    additions: list[ColumnSpec]
    changes: list[str | None]
    final_schema: list[ColumnSpec]

    @classmethod
    def between(cls, current: Sequence[ColumnSpec], after: Sequence[ColumnSpec]) -> SchemaChange:
        """additions are the columns of `after` that current doesn't have exactly so; a changed column is among them."""
        left, changes = list(after), []
        for own in current:
            found = next((c for c in left if same_name(c.name, own.name)), None)
            if found is None:
                changes.append("removed")
            else:
                left.remove(found)
                changes.append(None if found == own else "modified")
        return cls(list(current), [c for c in after if c not in current], changes, list(after))

    def ddl(self) -> str:
        """The columns of the final schema, as PostgreSQL's CREATE TABLE lists them."""
        return ", ".join(f"{c.name} {c.ddl()}" for c in self.final_schema)
