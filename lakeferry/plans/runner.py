"""Running a task: open the source, cast, prepare every destination, settle the source, publish each destination, run hooks, report.

Nothing is published before all destinations are prepared and the source is known to be whole; after that destinations succeed
or fail each on its own.
"""

from __future__ import annotations

import json
import logging
import sys
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession

from lakeferry.deltalog.table import Txn
from lakeferry.functions.casts import apply_casts
from lakeferry.functions.paths import join_url
from lakeferry.functions.types import ColumnSpec, from_schema
from lakeferry.operators.schema import layered
from lakeferry.plans.config import Block, ConfigError, TableConfig, selected, validate
from lakeferry.plans.environment import PREFIX, Environment
from lakeferry.plans.outcome import Outcome, Phase, TaskError
from lakeferry.plans.templates import context, render, shouty
from lakeferry.sinks.arrow import ArrowSink
from lakeferry.sinks.delta import DeltaSink
from lakeferry.sinks.jdbc import JdbcSink
from lakeferry.sinks.parquet import ParquetSink
from lakeferry.sources import readers
from lakeferry.sources.readers import Opened

log = logging.getLogger("lakeferry")
Hook = Callable[[Phase], Sequence[str]]


@dataclass
class Task:
    """One source, several destinations; nothing in it is a template any more."""

    name: str
    open: Callable[[], Opened]
    sinks: list[Callable[[], Any]]
    hooks: list[Hook] = field(default_factory=list)


def run_task(spark: SparkSession, task: Task) -> Phase | None:
    """None where the source has no columns: then there is nothing to load."""
    source = task.open()
    built: list[Any] = []
    kept: list[DataFrame] = []
    try:
        if source.df is None:
            source.settle()
            log.warning("%s: the source has no columns; nothing is loaded", task.name)
            return None
        for make in task.sinks:
            built.append(make())
        columns = layered(from_schema(source.df.schema), [source.columns])
        # A destination runs its input once, and counts it there; with several, it is kept, so that the source is read once for all.
        df = source.df
        if len(built) > 1:
            df = df.persist()
            kept.append(df)
        shared: dict[str, tuple[DataFrame, list[ColumnSpec]]] = {}
        for sink in built:
            key = repr(sink.columns)
            if key not in shared:
                shared[key] = apply_casts(df, sink.columns, source=source.columns)
        with ThreadPoolExecutor(max(1, len(built))) as pool:
            jobs = [pool.submit(sink.prepare, *shared[repr(sink.columns)]) for sink in built]
        for j in jobs:
            j.result()
        source.settle()
    except BaseException:
        for sink in built:
            try:
                sink.abort()
            except Exception as e:
                log.warning("%s: could not clean up %s: %s", task.name, sink.target, e)
        for d in kept:
            d.unpersist()
        source.close()
        raise
    try:
        with ThreadPoolExecutor(max(1, len(built))) as pool:
            outcomes = list(pool.map(_published, built))
        # One that had nothing to do may not have run it at all.
        rows = next((sink.source_rows for sink in built if sink.source_rows is not None), 0)
    finally:
        for d in kept:
            d.unpersist()
        source.close()
    return Phase(task.name, rows, [c.as_dict() for c in columns], outcomes)


def _published(sink: Any) -> Outcome:
    try:
        return sink.publish()
    except Exception as e:
        try:
            sink.abort()
        except Exception as e2:
            log.warning("could not clean up %s: %s", sink.target, e2)
        return Outcome(sink.kind, sink.target, error=str(e).splitlines()[0] if str(e) else type(e).__name__)


def run_hooks(spark: SparkSession, hooks: Sequence[Hook], phase: Phase) -> list[str]:
    """Each hook sees what was done and gives statements to run. What fails is returned, and doesn't keep the others from running."""
    failures = []
    for hook in hooks:
        try:
            for statement in hook(phase):
                spark.sql(statement)
        except Exception as e:
            failures.append(f"{getattr(hook, '__name__', 'hook')}: {e}")
    return failures


def captured(spark: SparkSession, statements: Sequence[str], most: int = 5) -> list[dict[str, Any]]:
    """Run statements and keep up to `most` rows of each, and whether there were more."""
    out = []
    for s in statements:
        rows = spark.sql(s).limit(most + 1).collect()
        out.append({"statement": s, "rows": [r.asDict(recursive=True) for r in rows[:most]], "truncated": len(rows) > most})
    return out


# From configuration to tasks


def resolve(spark: SparkSession, table: TableConfig, env: Environment, hooks: Mapping[str, Hook] | None = None, out=None) -> Task:
    ctx = context(table.name, env.template_variables)
    missing = [h.get("run") for h in table.finalize if h.get("run") not in (hooks or {})]
    if missing:
        raise ConfigError(f"unknown finalize hook {missing[0]!r}")
    sinks = [_sink(spark, d, ctx, env, out) for d in table.destinations]
    return Task(table.name, _source(spark, table.source, ctx, env), sinks, [hooks[h["run"]] for h in table.finalize])


def _source(spark: SparkSession, b: Block, ctx: dict[str, Any], env: Environment) -> Callable[[], Opened]:
    kind = b.kind.partition(".")[0]
    if b.kind in ("file", "csv"):
        url = join_url(env.location("SRC", b.name, kind), render(b.get("filename") or b.name, ctx))
        return (lambda: readers.parquet(spark, url)) if b.kind == "file" else (lambda: readers.csv(spark, url, null=b.get("null", ""), header=b.get("header", True)))
    if b.kind in ("sf.table", "table"):
        return lambda: readers.table(spark, b.name)
    if b.kind == "jdbc":
        url, what = env.location("SRC", b.name, "JDBC"), render(f"({b.get('sql')}) q" if b.get("sql") else b.name, ctx)
        bounds = (b.get("lower"), b.get("upper")) if b.get("partition_column") else None
        return lambda: readers.jdbc(spark, url, what, partition_column=b.get("partition_column"), bounds=bounds)
    if b.kind == "process":
        command = [render(str(c), ctx) for c in b.get("command")]
        return lambda: readers.spawned(spark, command, stdin=(b.get("stdin") or "").encode())
    if (src := env.get(f"{PREFIX}SRC_{b.name}", f"{PREFIX}SRC_{shouty(b.name)}", f"{PREFIX}SRC_{kind.upper()}", f"{PREFIX}SRC")) is not None:
        ctx = ctx | {"src_url": src}
    sql, pre = render(b.get("sql"), ctx), render(b.get("pre_sql") or "", ctx)
    own = env.parameters_named(b.get("param_keys")) if b.get("param_keys") else env.parameters_for(b.name)
    args: Any = [p.typed() for p in own] if "?" in sql else {p.name.lower(): p.typed() for p in (own if b.get("param_keys") else env.parameters)} if ":" in sql else None
    raw = b.kind == "duckdb.raw"
    return lambda: readers.query(spark.newSession() if raw else spark, sql, args=args, pre_sql=pre, utc=not raw)


def namer(template: str, ctx: Mapping[str, Any]) -> Callable[[int], str]:
    return lambda k: render(template, {**ctx, "index": k})


def _sink(spark: SparkSession, b: Block, ctx: dict[str, Any], env: Environment, out) -> Callable[[], Any]:
    kind, target = b.kind.partition(".")[0], render(b.target, ctx)
    ctx = ctx | {"target": target}
    if b.kind == "arrow":
        return lambda: ArrowSink(out or sys.stdout.buffer, target, b.columns)
    url = env.location("DEST", target, kind)
    if b.kind == "pq":
        return lambda: ParquetSink(spark, url, target, namer(b.get("filename"), ctx), b.columns, bloom_filters=b.get("bloom_filters") or (), max_rows=b.get("max_rows"), max_bytes=b.get("max_bytes"))
    if kind == "delta":
        txn = None
        if mode := b.get("txn_mode"):
            app = render(b.get("app_id"), ctx)
            version = b.get("batch_version")
            try:
                number = int(render(str(version), ctx)) if version is not None and mode == "processing_time" else None
            except ValueError as e:
                raise ConfigError(f"batch_version must be a whole number: {e}") from None
            txn = Txn(app, b.get("watermark_column") if mode == "source_watermark" else None, number)
        return lambda: DeltaSink(spark, join_url(url.removeprefix("delta+"), target), target, b.columns, merge_keys=b.get("merge_keys") or (), allow_null_keys=bool(b.get("allow_null_keys")), txn=txn, max_rows=b.get("max_rows"), max_bytes=b.get("max_bytes"))
    schema, dot, name = target.partition(".")
    if not dot:
        raise ConfigError(f"a database target is schema.table, not {target!r}")
    ctx |= {"schema": schema, "table": name}
    url, role = split_role(url)
    role = b.get("role") or role or env.get(f"{PREFIX}PG_ROLE_{shouty(target)}", f"{PREFIX}PG_ROLE")
    values = {k: env.key_value(target, k).typed() for k in b.get("delete_keys") or ()}
    pre, post = (render(b.get(k) or "", ctx) for k in ("pre_sql", "post_sql"))
    return lambda: JdbcSink(spark, url, target, b.kind.partition(".")[2], b.columns, keys=b.get("merge_keys") or (), delete_values=values, pre_sql=pre, post_sql=post, role=role)


def split_role(url: str) -> tuple[str, str | None]:
    """A connection's URL without its role, and the role: of role=, or else the last of options=-c role=..."""
    import re
    from urllib.parse import parse_qsl, unquote, urlencode, urlsplit, urlunsplit

    if url.startswith("jdbc:"):
        return url, None
    parts = urlsplit(url)
    pairs = parse_qsl(parts.query, keep_blank_values=True)
    role = next((v for k, v in pairs if k == "role"), None)
    if role is None:
        found = [r for k, v in pairs if k == "options" for r in re.findall(r"-c\s*role=(\S+)", unquote(v))]
        role = found[-1] if found else None
    return urlunsplit(parts._replace(query=urlencode([p for p in pairs if p[0] != "role"]))), role


def run(spark: SparkSession, tables: Sequence[TableConfig], env: Environment, *, select: Sequence[str] | None = None, report: TextIO | None = None, hooks: Mapping[str, Hook] | None = None, out=None) -> list[Phase]:
    """One after the other; the first failure ends the run, after its line in the report."""
    own = selected(tables, select)
    validate(own)
    done = []
    for t in own:
        for u in t.unknown:
            log.warning("table %s: %s", t.name, u)
        task = resolve(spark, t, env, hooks, out)
        phase = run_task(spark, task)
        if phase is None:
            continue
        done.append(phase)
        failed = run_hooks(spark, task.hooks, phase)
        for f in (*phase.failures, *failed):
            log.error("table %s: %s", t.name, f)
        if report:
            report.write(phase.line() + "\n")
            report.flush()
        if phase.failures or failed:
            raise TaskError(f"task {t.name!r} failed: {len(phase.failures)} load, {len(failed)} finalize: " + "; ".join([*phase.failures, *failed]))
    return done


def report_lines(path: str) -> list[dict[str, Any]]:
    with open(path) as f:
        return [json.loads(line) for line in f]
