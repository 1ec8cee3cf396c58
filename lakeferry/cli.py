"""Command line: ld, run, delta vacuum, delta vacuum-table, ingest, schema."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence
from typing import Any

import yaml

from lakeferry.plans.config import ConfigError, TableConfig, json_schema, parse, parse_destination, parse_source, selected
from lakeferry.plans.environment import Environment


def session():
    """A session with what loads rely on: UTC, strict casts, adaptive execution, and the object stores that the environment names."""
    from pyspark.sql import SparkSession

    from lakeferry.sources.readers import object_store_conf

    own = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}
    own |= {f"spark.hadoop.{k}": v for k, v in object_store_conf(os.environ).items()}
    return SparkSession.builder.appName("lakeferry").config(map=own).getOrCreate()


def finalize_hooks(tables: Sequence[TableConfig], base: str) -> dict[str, Any]:
    """The functions `finalize` of the modules that finalize blocks name, in the configuration's folder of modules."""
    from lakeferry.plans.ingest import IngestError, find_hook

    names = {h.get("run") for t in tables for h in t.finalize}
    if bad := [n for n in names if not isinstance(n, str) or not n.isidentifier()]:
        raise ConfigError(f"a finalize hook is named by an identifier, not {bad[0]!r}")
    try:
        return {n: find_hook([os.path.join(base, n, "__init__.py"), os.path.join(base, f"{n}.py")], "finalize") for n in sorted(names)}
    except IngestError as e:
        raise ConfigError(f"unknown finalize hook: {e}") from None


def run_block(inline: str | None, options: Sequence[str], flags: dict[str, Any]) -> dict[str, Any]:
    """One table's block: inline YAML, over it key=value options, over them flags."""
    block = yaml.safe_load(inline) if inline else {}
    if not isinstance(block, dict):
        raise ConfigError("inline YAML must be a mapping")
    for o in options:
        key, eq, value = o.partition("=")
        if not eq or not key:
            raise ConfigError(f"an option is key=value, not {o!r}")
        try:
            block[key] = value if "{{" in value else yaml.safe_load(value)
        except yaml.YAMLError:
            block[key] = value
    return block | {k: v for k, v in flags.items() if v is not None}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lakeferry")
    subs = top.add_subparsers(dest="command", required=True)
    ld = subs.add_parser("ld", help="run the tables of a configuration")
    run = subs.add_parser("run", help="run one table without a configuration")
    for p in (ld, run):
        p.add_argument("--report", help="file for a JSON line for each task")
    ld.add_argument("--config", required=True)
    ld.add_argument("--select", help="names of tables, comma-separated")
    run.add_argument("--src")
    run.add_argument("--dest")
    run.add_argument("--name")
    run.add_argument("--sql")
    run.add_argument("--opt", action="append", default=[], metavar="KEY=VALUE")
    run.add_argument("--yaml", dest="inline")
    delta = subs.add_parser("delta").add_subparsers(dest="action", required=True)
    many, one = delta.add_parser("vacuum", help="vacuum the tables of a configuration"), delta.add_parser("vacuum-table", help="vacuum one table")
    many.add_argument("--config", required=True)
    many.add_argument("--select")
    one.add_argument("url")
    for p in (many, one):
        p.add_argument("--retention")
        p.add_argument("--dry-run", action="store_true")
        p.add_argument("--unchecked", action="store_true")
    take = subs.add_parser("ingest", help="run the statements that a hook gives for a file")
    take.add_argument("url")
    take.add_argument("--pattern", required=True)
    take.add_argument("--modules", default="modules")
    schema = subs.add_parser("schema", help="what a kind's block may hold")
    schema.add_argument("kind", nargs="?")
    return top


def delta_targets(tables: Sequence[TableConfig], env: Environment) -> list[tuple[str, str]]:
    """Name and location of each table under a log that the configuration loads, each location once."""
    from lakeferry.functions.paths import join_url
    from lakeferry.plans.templates import context, render

    out: dict[str, str] = {}
    for t in tables:
        ctx = context(t.name, env.template_variables)
        for d in t.destinations:
            if d.kind.startswith("delta."):
                target = render(d.target, ctx)
                out.setdefault(join_url(env.location("DEST", target, "DELTA").removeprefix("delta+"), target), t.name)
    if not out:
        raise ConfigError("the configuration names no delta destinations")
    return [(name, url) for url, name in out.items()]


def main(argv: Sequence[str] | None = None, *, spark=None, environment: dict[str, str] | None = None, hooks=None, out=None) -> int:
    a = parser().parse_args(argv)
    if a.command == "schema":
        print(json.dumps(json_schema(a.kind), indent=2))
        return 0
    from lakeferry.deltalog.vacuum import vacuum
    from lakeferry.plans.runner import run

    if a.command == "ingest":
        from lakeferry.plans.ingest import ingest

        for line in ingest(spark or session(), a.url, a.pattern, a.modules):
            print(json.dumps(line, default=str))
        return 0
    env = Environment(environment if environment is not None else dict(os.environ))
    names = a.select.split(",") if getattr(a, "select", None) else None
    if a.command == "delta":
        if a.action == "vacuum-table":
            targets = [("", a.url)]
        else:
            with open(a.config) as f:
                targets = delta_targets(selected(parse(f.read(), env), names), env)
        failures = []
        for name, url in targets:
            try:
                r = vacuum(spark or session(), url, retention=a.retention, dry_run=a.dry_run, unchecked=a.unchecked)
                print(json.dumps({"table": name, "url": url, "listed": r.listed, "kept": r.kept, "skipped": r.skipped, "selected": r.selected, "deleted": r.deleted}))
            except Exception as e:
                failures.append(f"{url}: {e}")
        for f in failures:
            print(f, file=sys.stderr)
        return int(bool(failures))
    if a.command == "ld":
        with open(a.config) as f:
            text = f.read()
        tables = parse(text, env)
        if hooks is None:
            folder = (yaml.safe_load(text) or {}).get("modules") or "modules"
            hooks = finalize_hooks(selected(tables, names), os.path.join(os.path.dirname(os.path.abspath(a.config)), folder))
    else:
        block = run_block(a.inline, a.opt, {"src": a.src, "dest": a.dest, "name": a.name, "sql": a.sql})
        tables = [TableConfig(parse_source(block, env.kind_of("SRC")), [parse_destination(block, env.kind_of("DEST"))])]
    report = open(a.report, "w") if a.report else None  # noqa: SIM115  before any work: a bad path must fail first
    try:
        run(spark or session(), tables, env, select=names, report=report, hooks=hooks, out=out)
    finally:
        if report:
            report.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
