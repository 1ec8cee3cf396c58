"""Configuration: a YAML document of tables, each a source and its destinations, as parsed blocks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import yaml

from lakeferry.functions.types import ColumnSpec


class ConfigError(ValueError):
    """A configuration that can't be read."""


#: Each kind's fields: required ones, and optional ones with what they are without.
SOURCES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "file": (("name",), ("filename",)),
    "csv": (("name", "filename"), ("null", "header")),
    "sf.query": (("name", "sql"), ("param_keys",)),
    "sf.table": (("name",), ()),
    "duckdb.query": (("name", "sql"), ("pre_sql", "param_keys")),
    "duckdb.raw": (("name", "sql"), ("pre_sql", "param_keys")),
    "sql": (("name", "sql"), ("pre_sql", "param_keys")),
    "table": (("name",), ()),
    "jdbc": (("name",), ("sql", "partition_column", "lower", "upper")),
    "process": (("name", "command"), ("stdin",)),
}
_PG = ("target", "pre_sql", "post_sql", "role", "columns")
DESTINATIONS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "pq": (("name", "filename"), ("target", "columns", "bloom_filters", "max_rows", "max_bytes")),
    "arrow": (("name",), ("columns",)),
    "pg.drop_replace": (("name",), _PG),
    "pg.truncate_insert": (("name",), _PG),
    "pg.delete_insert": (("name", "delete_keys"), _PG),
    "pg.merge": (("name", "merge_keys"), _PG),
    "delta.overwrite": (("name",), ("target", "columns", "max_rows", "max_bytes")),
    "delta.merge": (("name", "merge_keys"), ("target", "columns", "max_rows", "max_bytes", "allow_null_keys", "txn_mode", "watermark_column", "batch_version", "app_id")),
}
APP_ID = "lakeferry-merge-{{ name }}"
TXN_MODES = ("source_watermark", "processing_time")


@dataclass(frozen=True)
class UnknownKey:
    key: str
    suggestions: tuple[str, ...]

    def __str__(self) -> str:
        own = [f"'{s}'" for s in self.suggestions]
        hint = "" if not own else f" (did you mean {own[0]}?)" if len(own) == 1 else f" (did you mean one of {', '.join(own)}?)"
        return f"'{self.key}' is not a known field{hint}"


@dataclass
class Block:
    """A source or destination: its kind and the fields that the kind has."""

    kind: str
    fields: dict[str, Any]
    columns: list[ColumnSpec] = field(default_factory=list)

    @property
    def name(self) -> str:
        return self.fields["name"]

    @property
    def target(self) -> str:
        return self.fields.get("target") or self.name

    def get(self, key: str, default: Any = None) -> Any:
        return self.fields.get(key, default)


@dataclass
class TableConfig:
    source: Block
    destinations: list[Block]
    finalize: list[dict[str, Any]] = field(default_factory=list)
    unknown: list[UnknownKey] = field(default_factory=list)

    @property
    def name(self) -> str:
        return self.source.name


def distance(a: str, b: str) -> int:
    """Single letters to add, drop or change."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def unknown_keys(block: Mapping[str, Any], allowed: set[str]) -> list[UnknownKey]:
    """Keys that nothing reads, each with names at most two letters off. What stands before a dot is a kind, and not compared."""
    out = []
    for key in block:
        bare = str(key).rpartition(".")[2]
        if bare not in allowed:
            near = sorted((d, a) for a in allowed if (d := distance(bare, a)) <= 2)
            out.append(UnknownKey(str(key), tuple(a for _, a in near)))
    return out


def _field(block: Mapping[str, Any], kind: str, name: str) -> Any:
    return block.get(f"{kind.partition('.')[0]}.{name}", block.get(name))


def _block(block: Mapping[str, Any], kind: str, known: Mapping[str, tuple[tuple[str, ...], tuple[str, ...]]]) -> Block:
    required, optional = known[kind]
    fields = {n: v for n in (*required, *optional) if (v := _field(block, kind, n)) is not None}
    if missing := [n for n in required if n not in fields]:
        raise ConfigError(f"missing {missing[0]} for kind {kind}")
    columns = [ColumnSpec.parse(c) for c in fields.pop("columns", None) or []]
    return Block(kind, fields, columns)


def parse_source(block: Mapping[str, Any], default: str | None) -> Block:
    kind = block.get("src", default)
    if not isinstance(kind, str):
        raise ConfigError("src is not set" if kind is None else "src is no text")
    prefix = kind.partition(".")[0]
    if prefix == "pg":
        raise ConfigError("pg is a kind of destination; to read a database use src: jdbc or src: sql")
    if kind == "duckdb":
        kind = "duckdb.query"
    if kind == "sf":
        kind = "sf.query" if _field(block, "sf", "sql") is not None else "sf.table"
    if kind not in SOURCES:
        raise ConfigError(f"unsupported src {kind!r}; kinds: {', '.join(SOURCES)}")
    return _block(block, kind, SOURCES)


def parse_destination(block: Mapping[str, Any], default: str | None) -> Block:
    kind = block.get("dest", default)
    if not isinstance(kind, str):
        raise ConfigError("dest is not set" if kind is None else "dest is no text")
    merge, delete = _field(block, kind, "merge_keys"), _field(block, kind, "delete_keys")
    if kind.partition(".")[0] == "pg":
        if merge is not None and delete is not None:
            raise ConfigError("both merge_keys and delete_keys are set")
        if kind == "pg":
            if merge is None and delete is None:
                raise ConfigError("without keys a tag must say pg.drop_replace or pg.truncate_insert")
            kind = "pg.merge" if merge is not None else "pg.delete_insert"
        if merge is not None and kind != "pg.merge" or delete is not None and kind != "pg.delete_insert":
            raise ConfigError(f"keys don't fit {kind}")
    if kind not in DESTINATIONS:
        raise ConfigError(f"unsupported dest {kind!r}; kinds: {', '.join(DESTINATIONS)}")
    if kind == "delta.overwrite" and merge is not None:
        raise ConfigError("delta.overwrite takes no merge_keys")
    out = _block(block, kind, DESTINATIONS)
    if kind.endswith("merge") and not out.fields["merge_keys"]:
        raise ConfigError("merge_keys cannot be empty")
    if kind == "delta.merge":
        if (mode := out.get("txn_mode")) is not None and mode not in TXN_MODES:
            raise ConfigError(f"unknown txn_mode {mode!r}")
        if mode == "source_watermark" and not out.get("watermark_column"):
            raise ConfigError("source_watermark needs watermark_column")
        out.fields.setdefault("app_id", APP_ID)
    return out


def _names(known: tuple[tuple[str, ...], tuple[str, ...]]) -> set[str]:
    return {*known[0], *known[1]}


def _is_nested(table: Mapping[str, Any], config: Mapping[str, Any]) -> bool:
    there, version = "destinations" in table or config.get("destinations") is not None, config.get("version")
    if version not in (None, 1, 2):
        raise ConfigError(f"unsupported version {version}; 1 or 2")
    if version is not None and (version == 2) != there:
        raise ConfigError(f"version {version}, but {'a list of destinations is there' if there else 'there is no list of destinations'}")
    return there


def parse_table(table: Mapping[str, Any], config: Mapping[str, Any], src: str | None, dest: str | None) -> TableConfig:
    """The table's own keys win over defaults."""
    source = parse_source((config.get("src_defaults") or {}) | table, src)
    if not _is_nested(table, config):
        out = parse_destination((config.get("dest_defaults") or {}) | table, dest)
        allowed = _names(SOURCES[source.kind]) | _names(DESTINATIONS[out.kind]) | {"src", "dest"}
        return TableConfig(source, [out], unknown=unknown_keys(table, allowed))
    blocks = table.get("destinations", config.get("destinations"))
    if not isinstance(blocks, list):
        raise ConfigError("destinations must be a list")
    inherited = {"name": source.name} | ({"columns": table["columns"]} if "columns" in table else {})
    outs, unknown = [], []
    for b in blocks:
        if "name" in b:
            raise ConfigError("a destination must not set name; it has its table's")
        outs.append(parse_destination(inherited | b, None))
        unknown += unknown_keys(b, _names(DESTINATIONS[outs[-1].kind]) - {"name"} | {"dest"})
    finalize = table.get("finalize", config.get("finalize")) or []
    if not isinstance(finalize, list):
        raise ConfigError("finalize must be a list")
    unknown += unknown_keys(table, _names(SOURCES[source.kind]) | {"src", "destinations", "columns", "finalize"})
    return TableConfig(source, outs, list(finalize), unknown)


TOP = {"src", "src_defaults", "dest", "dest_defaults", "version", "destinations", "finalize", "modules", "tables"}


def parse(text: str, env=None) -> list[TableConfig]:
    """All tables of a document. Kinds that it doesn't name are told by the locations in the environment."""
    config = yaml.safe_load(text)
    if not isinstance(config, dict) or not isinstance(config.get("tables"), list):
        raise ConfigError("a configuration is a mapping with a list of tables")
    src = config.get("src") or (env.kind_of("SRC") if env else None)
    dest = config.get("dest") or (env.kind_of("DEST") if env else None)
    return [parse_table(t, config, src, dest) for t in config["tables"]]


def selected(tables: Sequence[TableConfig], names: Sequence[str] | None) -> list[TableConfig]:
    """Those with one of the names, whatever its case; all of them without names."""
    low = None if names is None else {n.lower() for n in names}
    return [t for t in tables if low is None or t.name.lower() in low]


def validate(tables: Sequence[TableConfig]) -> None:
    if sum(d.kind == "arrow" for t in tables for d in t.destinations) > 1:
        raise ConfigError("at most one arrow destination in a run: a second stream would spoil the output")


def json_schema(kind: str | None = None) -> dict[str, Any]:
    """JSON Schema of a kind's block, or the list of kinds."""
    kinds = {**SOURCES, **DESTINATIONS}
    if kind is None:
        return {"sources": list(SOURCES), "destinations": list(DESTINATIONS)}
    found = {k: v for k, v in kinds.items() if k == kind or k.startswith(f"{kind}.")}
    if not found:
        raise ConfigError(f"unknown kind {kind!r}; kinds: {', '.join(kinds)}")
    lists = {"merge_keys", "delete_keys", "param_keys", "columns", "bloom_filters", "command"}
    kind_of = lambda n: {"type": "array"} if n in lists else {"type": "integer"} if n.startswith("max_") or n in ("lower", "upper") else {"type": "boolean"} if n in ("allow_null_keys", "header") else {"type": "string"}
    tag = lambda k: "src" if k in SOURCES else "dest"
    return {"oneOf": [{"title": k, "type": "object", "properties": {tag(k): {"const": k}, **{n: kind_of(n) for n in (*r, *o)}}, "required": list(r)} for k, (r, o) in found.items()]}
