"""Sources: each gives a DataFrame and what is known of its columns beyond Spark's types."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import tempfile
import threading
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from lakeferry.functions.paths import join_url, local_path, resolve_url
from lakeferry.functions.types import ColumnSpec, from_footer, from_warehouse
from lakeferry.sources.scratch import shared_root
from lakeferry.sources.store import Store


class SourceError(RuntimeError):
    """A source that failed or ended early."""


@dataclass
class Opened:
    """df is None where a source has no columns at all: then there is nothing to do. settle() raises if the source failed after all."""

    df: DataFrame | None
    columns: list[ColumnSpec | None] = field(default_factory=list)
    settle: Callable[[], None] = lambda: None
    close: Callable[[], None] = lambda: None


def _opened(df: DataFrame, columns: list[ColumnSpec | None] | None = None) -> Opened:
    return Opened(df if df.columns else None, columns if columns is not None else [c for f in df.schema.fields if (c := from_warehouse(f))])


def parquet(spark: SparkSession, url: str) -> Opened:
    """Parquet files; a single file's footer tells uuid and json columns apart. Nanoseconds are read as whole numbers where the session allows it."""
    full = resolve_url(url)
    path = local_path(full)
    df = spark.read.parquet(full)
    if path:
        footer = from_footer(path) if os.path.isfile(path) else []
    else:
        folder, _, name = full.rpartition("/")
        last = Store(spark, folder).footer(name) if not set("*?[{") & set(name) else None
        footer = from_footer(pa.BufferReader(last)) if last else []
    flat = {f.name for f in df.schema.fields}
    return _opened(df, [c for c in footer if c and c.name in flat] or None)


def csv(spark: SparkSession, glob: str, *, null: str = "", header: bool = True, schema: Any = None) -> Opened:
    """CSV files; types are inferred by a pass over all rows unless a schema is given."""
    reader = spark.read.option("header", header).option("nullValue", null).option("multiLine", False).option("quote", '"').option("escape", '"')
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return _opened(reader.csv(resolve_url(glob)), [])


def table(spark: SparkSession, name: str) -> Opened:
    return _opened(spark.table(name))


def query(spark: SparkSession, sql: str, *, args: Mapping[str, Any] | Sequence[Any] | None = None, pre_sql: str | None = None, utc: bool = True) -> Opened:
    """One SELECT, with named or positional parameters, after any statements of pre_sql. utc: pin the session's time zone."""
    if utc:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for statement in statements(pre_sql or ""):
        spark.sql(statement)
    own = statements(sql)
    if len(own) != 1:
        raise SourceError(f"a query is one statement, not {len(own)}")
    return _opened(spark.sql(own[0], args=args or None))


def statements(text: str) -> list[str]:
    """The statements of a text: split at semicolons outside of quotes and comments; comments alone are none."""
    out, now, quote, k = [], [], "", 0
    while k < len(text):
        c, two = text[k], text[k : k + 2]
        if quote:
            end = quote == "--" and c == "\n" or quote == "/*" and two == "*/" or quote in "'\"`" and c == quote
            now.append(two if end and quote == "/*" else c)
            k += 2 if end and quote == "/*" else 1
            quote = "" if end else quote
            continue
        if two in ("--", "/*") or c in "'\"`":
            quote = two if two in ("--", "/*") else c
            now.append(quote)
            k += len(quote)
            continue
        if c == ";":
            out.append("".join(now).strip())
            now = []
        else:
            now.append(c)
        k += 1
    bare = lambda s: re.sub(r"--[^\n]*|/\*.*?\*/", "", s, flags=re.DOTALL).strip()
    return [s for s in [*out, "".join(now).strip()] if bare(s)]


def jdbc(spark: SparkSession, url: str, table_or_query: str, *, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> Opened:
    """A table or (select) of a database; with a partition column and its bounds, read by several tasks."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table_or_query).options(**options)
    if partition_column and bounds:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    from lakeferry.sinks.jdbc import DRIVERS, Connection, exported, out_of_reach

    columns: list[ColumnSpec] = []
    if re.fullmatch(r"\w+\.\w+", table_or_query):  # of a table the driver knows more than Spark's types say
        if url.startswith(tuple(DRIVERS)):
            with Connection(spark, url, {k: v for k, v in options.items() if k in ("user", "password")}) as c:
                columns = c.columns(*table_or_query.split("."))
    df = reader.load()
    if out_of_reach(spark, url):
        with Connection(spark, url, {k: v for k, v in options.items() if k in ("user", "password")}) as c:
            df = exported(spark, c, table_or_query, df.schema)
    return _opened(df, columns or None)


def arrow_stream(spark: SparkSession, stream, staging: str | None = None) -> tuple[DataFrame | None, Callable[[], None]]:
    """An Arrow IPC stream, batch by batch into a Parquet file of shared storage, and read from there: memory holds one batch.

    Returns a DataFrame, None for a stream without columns, and what removes the file again.
    """
    root = staging or shared_root(spark)
    folder = tempfile.mkdtemp(prefix="lakeferry-arrow-")
    path, to = os.path.join(folder, "stream.parquet"), None
    try:
        with pa.ipc.open_stream(stream) as reader:
            if not reader.schema.names:
                shutil.rmtree(folder)
                return None, lambda: None
            with pq.ParquetWriter(path, reader.schema, compression="snappy") as out:
                for batch in reader:
                    out.write_batch(batch)
        # Executors must see it: into the folder that they share with the driver.
        jvm = spark.sparkContext._jvm
        to = jvm.org.apache.hadoop.fs.Path(join_url(resolve_url(root), os.path.basename(folder)))
        fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.copyFromLocalFile(True, jvm.org.apache.hadoop.fs.Path(f"file://{path}"), jvm.org.apache.hadoop.fs.Path(to, "stream.parquet"))
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return spark.read.parquet(to.toString()), lambda: fs.delete(to, True)


def spawned(spark: SparkSession, argv: Sequence[str], *, stdin: bytes | None = None, env: Mapping[str, str] | None = None) -> Opened:
    """A process that writes an Arrow IPC stream to its output. Its exit status is the sign that the stream is whole.

    Input and errors are served by threads, so that neither side waits for the other.
    """
    p = subprocess.Popen(list(argv), stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, env=dict(env) if env is not None else None)
    said: list[bytes] = []

    def feed() -> None:
        try:
            p.stdin.write(stdin or b"")
            p.stdin.close()
        except OSError:
            pass  # a process needn't read its input

    threads = [threading.Thread(target=feed), threading.Thread(target=lambda: said.extend(p.stderr))]
    for t in threads:
        t.start()
    failure: Exception | None = None
    df, close = None, lambda: None
    try:
        df, close = arrow_stream(spark, p.stdout)
    except Exception as e:  # the exit status says more, if it is bad
        failure = e
        p.stdout.close()
    status = p.wait()
    for t in threads:
        t.join()

    def settle() -> None:
        if status:
            raise SourceError(f"{argv[0]} ended with status {status}: {b''.join(said)[-2000:].decode(errors='replace')}")

    if failure is not None:
        settle()
        if isinstance(failure, pa.ArrowInvalid) and "null" in str(failure).lower() or isinstance(failure, EOFError):
            return Opened(None, [], settle, close)  # it never opened a stream
        raise SourceError(f"{argv[0]} wrote no whole stream: {failure}") from failure
    return Opened(df, [], settle, close)


def object_store_conf(env: Mapping[str, str]) -> dict[str, str]:
    """Hadoop's settings for object stores, from the usual environment variables. Secrets aren't copied: providers read them."""
    low = {k.lower(): v for k, v in env.items()}
    out: dict[str, str] = {}
    truthy = lambda k: low.get(k, "").lower() in ("1", "true", "yes", "on")
    if v := low.get("aws_endpoint_url") or low.get("aws_endpoint"):
        out["fs.s3a.endpoint"] = v
        out["fs.s3a.path.style.access"] = "true"
        out["fs.s3a.connection.ssl.enabled"] = str(not v.startswith("http://")).lower()
    if v := low.get("aws_region") or low.get("aws_default_region"):
        out["fs.s3a.endpoint.region"] = v
    if truthy("aws_skip_signature"):
        out["fs.s3a.aws.credentials.provider"] = "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"
    if v := low.get("azure_storage_account_name"):
        out[f"fs.azure.account.auth.type.{v}.dfs.core.windows.net"] = "Anonymous" if truthy("azure_skip_signature") else "OAuth"
    if truthy("google_skip_signature"):
        out["fs.gs.auth.type"] = "UNAUTHENTICATED"
    return out
