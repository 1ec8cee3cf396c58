"""Reading, overwriting and merging tables under a log.

Data files are written by one Spark job into a folder of their own below the table, and count only once the log names them. That
job is the only one that runs the source: null keys and watermarks are seen while it writes, and a load that may not be committed
is deleted again. A merge finds the rows that it replaces by joining keys with the files whose ranges of all keys meet the source's,
of which it reads only row groups that do, and marks them in deletion vectors; no file is rewritten. Reading leaves marked
rows out by an anti join on file and row number. Values of partition columns come from the log, file by file.
"""

from __future__ import annotations

import datetime
import json
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal
from typing import Any
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DecimalType, NumericType, StringType, StructType, TimestampNTZType, TimestampType

from lakeferry.deltalog import vectors
from lakeferry.deltalog.log import TableLog, commit_info, decoded_path, encoded_path, now_ms, protocol, removal, schema_string, Snapshot
from lakeferry.functions.types import ColumnSpec, from_schema
from lakeferry.operators.stats import as_watermark, file_stats, is_stale, ordered, stat_text
from lakeferry.operators.strategies import MergeError, MergeStats, matched_rows, refuse_nulls
from lakeferry.shipping import ship

OVERWRITE_ATTEMPTS, MERGE_ATTEMPTS = 10, 3
#: Bits of a row's number beside its file's, and how many marked rows and files are broadcast at most.
ROW_BITS, MARKED_BROADCAST, FILES_BROADCAST = 40, 4_000_000, 100_000
#: Row numbers that a worker packs at once.
PACKED = 2_000_000


@dataclass(frozen=True)
class Txn:
    """Idempotency: app_id, and where the version comes from: a column's greatest value, a given number, or the clock."""

    app_id: str
    watermark_column: str | None = None
    batch_version: int | None = None


@dataclass(frozen=True)
class StagedMerge:
    """A merge whose files are written and whose commit is to come; skipped: the version for which there is nothing to do."""

    adds: list[dict]
    keys: list[str]
    null_safe: bool
    txn: Txn | None
    version: int | None
    schema: StructType
    skipped: int | None = None
    source_rows: int | None = None


def rows_of(adds: Sequence[dict]) -> int:
    return sum(json.loads(a["stats"])["numRecords"] for a in adds)


def stat_bounds(low: Any, high: Any, t: DataType) -> tuple[Any, Any] | None:
    """Statistics' texts as values that bound a column: times are written to the millisecond, so the upper one is the end of it."""
    if low is None or high is None or not isinstance(t, (NumericType, StringType, DateType, TimestampType, TimestampNTZType)):
        return None
    if isinstance(t, DecimalType):
        return Decimal(str(low)), Decimal(str(high))
    if isinstance(t, NumericType):
        return (low, high) if all(isinstance(x, (int, float, Decimal)) for x in (low, high)) else None
    if isinstance(t, (TimestampType, TimestampNTZType)):
        a, b = (datetime.datetime.fromisoformat(x.replace("Z", "")) for x in (low, high))
        return a, b + datetime.timedelta(milliseconds=1)
    return (low, high) if isinstance(low, str) and isinstance(high, str) else None


def _literal(value: Any, t: DataType):
    """A bound as a literal of the column's type; times of statistics are UTC."""
    if isinstance(t, TimestampType):
        return F.timestamp_micros(F.lit(int((value - datetime.datetime(1970, 1, 1)) / datetime.timedelta(microseconds=1))))
    return F.lit(str(value)).cast(t) if isinstance(t, (DecimalType, TimestampNTZType, DateType)) else F.lit(value)


def _file_key(c):
    """A file's URL in one spelling."""
    return F.regexp_replace(c, "^file:/+", "file:/")


class Table:
    def __init__(self, spark: SparkSession, url: str):
        ship(spark)
        self.spark, self.log = spark, TableLog(spark, url)
        self.store = self.log.store

    # reading

    def read(self, snapshot: Snapshot | None = None) -> DataFrame:
        """The table's rows. Without a table an error, of a table without files no rows."""
        own = snapshot or self.log.snapshot()
        if own is None:
            raise FileNotFoundError(f"no table at {self.store.url}")
        schema = self.schema(own)
        plain = [p for p, a in own.files.items() if not a.get("deletionVector")]
        marked = [p for p, a in own.files.items() if a.get("deletionVector")]
        parts = []
        if plain:
            parts.append(self._scan(plain, schema, own))
        if marked:
            parts.append(self._live(self._scan(marked, schema, own, "__file", "__row"), own, marked).drop("__file", "__row"))
        if not parts:
            return self.spark.createDataFrame([], schema)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def schema(self, own: Snapshot) -> StructType:
        return StructType.fromJson(json.loads(own.metadata["schemaString"]))

    def _scan(self, paths: Sequence[str], schema: StructType, own: Snapshot, *where: str) -> DataFrame:
        """Rows of files, and where they are. Partition columns aren't in the files: the log has them, as text, for each file."""
        parts = own.metadata.get("partitionColumns") or []
        stored = StructType([f for f in schema.fields if f.name not in parts])
        df = self.spark.read.schema(stored).parquet(*(self.store.full(decoded_path(p)) for p in sorted(paths)))
        meta = [F.col("_metadata.file_path").alias(where[0]), F.col("_metadata.row_index").alias(where[1])] if where else []
        if not parts:
            return df.select("*", *meta)
        values = [(self._url(p), *((own.files[p].get("partitionValues") or {}).get(c) or None for c in parts)) for p in sorted(paths)]
        named = self.spark.createDataFrame(values, ", ".join(["__of string", *(f"__p{k} string" for k in range(len(parts)))]))
        named = F.broadcast(named) if len(paths) <= FILES_BROADCAST else named
        df = df.select("*", F.col("_metadata.file_path").alias("__from"), *meta).join(named, _file_key(F.col("__from")) == _file_key(F.col("__of")), "left")
        of = {c: F.col(f"__p{k}").cast(schema[c].dataType).alias(c) for k, c in enumerate(parts)}
        return df.select(*(of.get(f.name, F.col(f"`{f.name}`")) for f in schema.fields), *where)

    def _live(self, rows: DataFrame, own: Snapshot, paths: Sequence[str]) -> DataFrame:
        """Rows (with __file and __row) that no vector marks: an anti join on file number and row number, packed into one whole number.

        Vectors are read by the executors, one row for each file. How many rows they mark is known beforehand: up to MARKED_BROADCAST
        they are broadcast, so that the table's rows stay where they are; beyond it both sides shuffle.
        """
        paths = sorted(paths)
        marks = [vectors.Descriptor.of(own.files[p]["deletionVector"]) for p in paths]
        names = self.spark.createDataFrame([(self._url(p), k) for k, p in enumerate(paths)], "__name string, __id long")
        dvs = self._vectors(marks)

        def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    marked = (k << ROW_BITS) + vectors.decode(data)
                    for at in range(0, len(marked), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(marked[at : at + 100_000])], ["__gone"])

        gone = dvs.mapInArrow(spread, "__gone long")
        if sum(m.cardinality for m in marks) <= MARKED_BROADCAST:
            gone = F.broadcast(gone)
        names = F.broadcast(names) if len(paths) <= FILES_BROADCAST else names
        placed = rows.join(names, _file_key(F.col("__file")) == _file_key(F.col("__name")), "left")  # files without a vector keep all rows
        return placed.join(gone, F.shiftleft(F.col("__id"), ROW_BITS) + F.col("__row") == F.col("__gone"), "left_anti").drop("__name", "__id")

    def _vectors(self, marks: Sequence[vectors.Descriptor]) -> DataFrame:
        """id (the place in marks) and data of each vector: short ones come from the log, the files of others are read by tasks."""
        inline = self.spark.createDataFrame([(k, vectors.inline(m)) for k, m in enumerate(marks) if m.file is None], "id long, data binary")
        beside = [(self._spelled(self.store.url_of(m.file)), k, m.offset or 0, m.size, m.file) for k, m in enumerate(marks) if m.file is not None]
        if not beside:
            return inline
        asked = self.spark.createDataFrame(beside, "__url string, id long, at int, size int, file string")
        files = self.spark.read.format("binaryFile").load(sorted({self.store.full(m.file) for m in marks if m.file is not None})).select("path", "content")

        def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in rows:
                ids, data = b.column(0), [vectors.checked(*x) for x in zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(data, pa.binary())], ["id", "data"])

        # As many rows as there are files with vectors.
        asked = F.broadcast(asked) if len(beside) <= FILES_BROADCAST else asked
        found = files.join(asked, _file_key(F.col("path")) == _file_key(F.col("__url"))).select("id", "content", "at", "size", "file")
        return inline.union(found.mapInArrow(cut, "id long, data binary"))

    # writing

    def stage(self, df: DataFrame, *, max_rows: int | None = None, max_bytes: int | None = None, bloom: Sequence[str] = (), partitions: Sequence[str] = ()) -> list[dict]:
        """Write df's rows as files of the table that nothing names yet; their adds, with statistics."""
        folder = f"load-{uuid.uuid4().hex}"
        rows = df
        while True:
            writer = rows.write.option("compression", "snappy").partitionBy(*partitions)
            if max_rows:
                writer = writer.option("maxRecordsPerFile", max_rows)
            for c in bloom:
                if c not in partitions:
                    writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
            try:
                writer.parquet(self.store.full(folder))
            except Exception:
                self.store.delete(folder)
                raise
            if rows is not df:
                self.store.delete(last)
            files = {x.path.removeprefix(f"{folder}/"): x for x in self.store.list(folder, recursive=True) if x.path.endswith(".parquet")}
            written = self.spark.read.schema(df.schema).parquet(self.store.full(folder))
            stats = file_stats(written, [F.col("_metadata.file_path").alias("__name")])
            found = {unquote(r["__name"]).partition(f"/{folder}/")[2]: r for r in stats.collect()}  # one row for each file
            if rows is df and max_bytes and files and max(x.size for x in files.values()) > max_bytes:
                # Bytes are known only once written: so many rows a file as have them on average, from what is written already.
                per = max(1, math.floor(sum(r.num_records for r in found.values()) * max_bytes / sum(x.size for x in files.values())))
                rows, last, folder, max_rows = written, folder, f"load-{uuid.uuid4().hex}", min(per, max_rows or per)
                continue
            break
        adds = []
        for name, x in sorted(files.items()):
            r = found.get(name)
            if r is None:  # Spark's file of an empty load holds no rows
                self.store.delete(x.path)
                continue
            low, high, nulls = {}, {}, {}
            for f in df.schema.fields:
                if f.name in partitions:
                    continue
                nulls[f.name] = r[f"null_count_{f.name}"]
                if ordered(f.dataType) and f"min_{f.name}" in stats.columns and r[f"min_{f.name}"] is not None:
                    a, b = stat_text(r[f"min_{f.name}"], f.dataType), stat_text(r[f"max_{f.name}"], f.dataType)
                    if a is not None and b is not None:
                        low[f.name], high[f.name] = a, b
            values = dict(p.partition("=")[::2] for p in name.split("/")[:-1])
            values = {unquote(k): None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v) for k, v in values.items()}
            adds.append({"path": encoded_path(f"{folder}/{name}"), "partitionValues": values, "size": x.size, "modificationTime": x.modified_ms, "dataChange": True, "stats": json.dumps({"numRecords": r.num_records, "minValues": low, "maxValues": high, "nullCount": nulls, "tightBounds": True})})
        return adds

    def discard(self, adds: list[dict]) -> None:
        for folder in {decoded_path(a["path"]).partition("/")[0] for a in adds}:
            self.store.delete(folder)

    def ensure(self, df: DataFrame, columns: Sequence[ColumnSpec] | None = None) -> Snapshot:
        return self.log.snapshot() or self.log.create(list(columns or from_schema(df.schema)))

    def partitions(self, own: Snapshot, df: DataFrame) -> list[str]:
        """The table's partition columns, which df must have."""
        parts = list(own.metadata.get("partitionColumns") or ())
        if missing := [c for c in parts if c not in df.columns]:
            raise MergeError(f"the table is partitioned by {missing[0]!r}, which the source lacks")
        return parts

    def overwrite(self, df: DataFrame, columns: Sequence[ColumnSpec] | None = None, *, max_rows: int | None = None) -> int:
        """The table holds df's rows and nothing else, in df's schema; an empty df empties it. The new version."""
        columns = list(columns or from_schema(df.schema))
        own = self.ensure(df, columns)
        return self.replace(self.stage(df, max_rows=max_rows, partitions=self.partitions(own, df)), columns)

    def replace(self, adds: list[dict], columns: list[ColumnSpec]) -> int:
        """Commit staged files as all that the table holds."""

        def work(own: Snapshot) -> list[dict]:
            features = own.features | {"timestampNtz"}
            meta = own.metadata | {"schemaString": schema_string(columns)}  # id, creation time and properties stay
            return [commit_info("WRITE", mode="Overwrite"), {"protocol": protocol(*features)}, {"metaData": meta}, *map(removal, own.files.values()), *({"add": a} for a in adds)]

        try:
            return self.log.retried(OVERWRITE_ATTEMPTS, work)
        except Exception:
            self.discard(adds)
            raise

    def merge(self, df: DataFrame, keys: Sequence[str], *, columns: Sequence[ColumnSpec] | None = None, allow_null_keys: bool = False, txn: Txn | None = None, max_rows: int | None = None) -> MergeStats:
        """Rows whose key df has go, all rows of df come. With a txn that isn't newer than what it committed, nothing happens."""
        return self.commit_merge(self.stage_merge(df, keys, columns=columns, allow_null_keys=allow_null_keys, txn=txn, max_rows=max_rows))

    def stage_merge(self, df: DataFrame, keys: Sequence[str], *, columns: Sequence[ColumnSpec] | None = None, allow_null_keys: bool = False, txn: Txn | None = None, max_rows: int | None = None, max_bytes: int | None = None) -> StagedMerge:
        """Everything of a merge but its commit. The source runs once: while its rows are written, null keys are counted and the
        watermark is seen. Files of a load that they forbid, or make needless, are deleted; a version known before is compared before."""
        if not keys:
            raise MergeError("merge_keys cannot be empty")
        if unknown := [k for k in keys if k not in df.columns]:
            raise MergeError(f"unknown key {unknown[0]!r}")
        own = self.ensure(df, columns)
        if unknown := [k for k in keys if k not in self.schema(own).names]:
            raise MergeError(f"the table has no key {unknown[0]!r}")
        version = None
        if txn and not txn.watermark_column:
            version = txn.batch_version if txn.batch_version is not None else now_ms()
            if is_stale(version, own.txns.get(txn.app_id)):
                return StagedMerge([], list(keys), allow_null_keys, txn, version, df.schema, own.txns[txn.app_id])
        seen, asked = Observation(), [F.count_if(F.col(f"`{k}`").isNull()).alias(f"n{i}") for i, k in enumerate(keys)]
        if txn and txn.watermark_column:
            asked.append(F.max(as_watermark(F.col(f"`{txn.watermark_column}`"), df.schema[txn.watermark_column].dataType)).alias("w"))
        adds = self.stage(df.observe(seen, *asked), max_rows=max_rows, max_bytes=max_bytes, bloom=keys, partitions=self.partitions(own, df))
        found, n = seen.get, rows_of(adds)
        try:
            if not allow_null_keys:
                refuse_nulls(keys, [found.get(f"n{i}") for i in range(len(keys))])
        except MergeError:
            self.discard(adds)
            raise
        if txn and txn.watermark_column:
            version = found.get("w")
            if is_stale(version, own.txns.get(txn.app_id)):
                self.discard(adds)
                return StagedMerge([], list(keys), allow_null_keys, txn, version, df.schema, own.txns[txn.app_id], n)
        return StagedMerge(adds, list(keys), allow_null_keys, txn, version, df.schema, source_rows=n)

    def commit_merge(self, staged: StagedMerge) -> MergeStats:
        adds, keys, txn = staged.adds, staged.keys, staged.txn
        if staged.skipped is not None:
            return MergeStats(0, 0, 0, skipped=True, skipped_version=staged.skipped)
        n = rows_of(adds)
        if not n:
            self.discard(adds)
            return MergeStats(0, 0, 0)
        out: dict = {}

        def work(now: Snapshot) -> list[dict] | None:
            if txn and is_stale(staged.version, now.txns.get(txn.app_id)):
                out["skipped"] = now.txns[txn.app_id]
                return None
            new = Snapshot(now.version, now.protocol, now.metadata, {a["path"]: a for a in adds})
            source = self._scan(list(new.files), staged.schema, new)
            marks = self._marks(now, source, adds, keys, staged.null_safe)
            actions = [commit_info("MERGE", mergeKeys=json.dumps(keys))]
            if txn and staged.version is not None:
                actions.append({"txn": {"appId": txn.app_id, "version": staged.version, "lastUpdated": now_ms()}})
            if marks and "deletionVectors" not in now.features:
                actions += [{"protocol": protocol("deletionVectors", *now.features)}, {"metaData": now.metadata | {"configuration": now.configuration | {"delta.enableDeletionVectors": "true"}}}]
            replaced = []
            for path, (data, held, _) in sorted(marks.items()):
                actions.append(removal(now.files[path]))
                stats = json.loads(now.files[path].get("stats") or "{}") | {"tightBounds": False}
                replaced.append({"add": now.files[path] | {"stats": json.dumps(stats), "dataChange": True, "deletionVector": vectors.store(self.store, data, held).as_action()}})
            out["matched"] = sum(m for *_, m in marks.values())
            out["marked"] = len(marks)
            return actions + replaced + [{"add": a} for a in adds]

        try:
            done = self.log.retried(MERGE_ATTEMPTS, work)
        except Exception:
            self.discard(adds)
            raise
        if done is None:
            self.discard(adds)
            return MergeStats(0, 0, 0, skipped=True, skipped_version=out["skipped"])
        return MergeStats(n, out["matched"], max(0, n - out["matched"]), len(adds), out["marked"])

    def ranges(self, own: Snapshot, adds: list[dict], keys: Sequence[str]) -> dict[str, tuple[Any, Any]]:
        """The least and greatest value of each key in the adds, for keys of which all adds have both, and no nulls, which match nulls."""
        out, schema = {}, self.schema(own)
        stats = [json.loads(a["stats"], parse_float=Decimal) for a in adds]
        for k in keys:
            found = [None if s["nullCount"].get(k) else stat_bounds(s["minValues"].get(k), s["maxValues"].get(k), schema[k].dataType) for s in stats]
            if found and None not in found:
                out[k] = min(x for x, _ in found), max(y for _, y in found)
        return out

    def candidates(self, own: Snapshot, adds: list[dict], keys: Sequence[str]) -> list[str]:
        """The files whose range of each key meets that of the adds; what has no range on either side meets all."""
        wanted, schema = self.ranges(own, adds, keys), self.schema(own)
        out = []
        for path, a in own.files.items():
            s = json.loads(a.get("stats") or "{}", parse_float=Decimal)
            meets = True
            for k, (low, high) in wanted.items():
                held = stat_bounds(s.get("minValues", {}).get(k), s.get("maxValues", {}).get(k), schema[k].dataType)
                meets = meets and (held is None or held[0] <= high and held[1] >= low)
            if meets:
                out.append(path)
        return out

    def probe(self, own: Snapshot, adds: list[dict], keys: Sequence[str]) -> DataFrame | None:
        """keys, __file and __row of the live rows that the adds may replace: of candidate files alone, and of these, by the keys' ranges, of
        row groups that may hold them. None if there is no such file."""
        paths = self.candidates(own, adds, keys)
        if not paths:
            return None
        schema = self.schema(own)
        rows = self._scan(paths, schema, own, "__file", "__row").select(*(F.col(f"`{k}`") for k in keys), "__file", "__row")
        for k, (low, high) in self.ranges(own, adds, keys).items():
            t = schema[k].dataType
            rows = rows.where(F.col(f"`{k}`").between(_literal(low, t), _literal(high, t)))
        if marked := [p for p in paths if own.files[p].get("deletionVector")]:
            rows = self._live(rows, own, marked)
        return rows

    def _marks(self, own: Snapshot, source: DataFrame, adds: list[dict], keys: Sequence[str], null_safe: bool) -> dict[str, tuple[bytes, int, int]]:
        """For each file with rows to replace: the vector of all its marked rows, old ones too, how many these are and how many are new.

        Files go by number through the join. Workers pack rows as they come, to containers of 65,536 row numbers, and put those of equal
        numbers together: a worker holds PACKED rows at most, and the driver at most one bit for each row of the files.
        """
        rows = self.probe(own, adds, keys)
        if rows is None:
            return {}
        paths, schema = sorted(own.files), self.schema(own)
        names = self.spark.createDataFrame([(self._url(p), k) for k, p in enumerate(paths)], "__name string, __id long")
        names = F.broadcast(names) if len(paths) <= FILES_BROADCAST else names
        rows = rows.join(names, _file_key(F.col("__file")) == _file_key(F.col("__name")), "left")
        number = F.coalesce("__id", F.raise_error(F.concat(F.lit("a file that the log doesn't name: "), "__file")).cast("long"))
        rows = rows.select(*(F.col(f"`{k}`") for k in keys), number.alias("__id"), "__row")
        want = source.select(*(F.col(f"`{k}`").cast(schema[k].dataType).alias(k) for k in keys))
        hit = matched_rows(rows, want, keys, null_safe=null_safe).select((F.shiftleft("__id", ROW_BITS) + F.col("__row")).alias("at"))
        form = "at long, data binary, n long"

        def batch(found: dict[int, tuple[bytes, int]]) -> pa.RecordBatch:
            columns = pa.array(list(found), pa.int64()), pa.array([d for d, _ in found.values()], pa.binary()), pa.array([n for _, n in found.values()], pa.int64())
            return pa.RecordBatch.from_arrays(list(columns), ["at", "data", "n"])

        def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for b in parts:
                held.append(b.column(0).to_numpy())
                n += len(b)
                if n >= PACKED:
                    yield batch(vectors.containers(np.concatenate(held)))
                    held, n = [], 0
            if n:
                yield batch(vectors.containers(np.concatenate(held)))

        def unite(t: pa.Table) -> pa.Table:
            whole = vectors.joined(list(zip(t.column("data").to_pylist(), t.column("n").to_pylist(), strict=True)))
            return pa.Table.from_batches([batch({t.column("at")[0].as_py(): whole})])

        found: dict[int, dict[int, tuple[bytes, int]]] = {}
        for r in hit.mapInArrow(pack, form).groupBy("at").applyInArrow(unite, form).collect():
            found.setdefault(r["at"] >> (ROW_BITS - 16), {})[r["at"] & ((1 << (ROW_BITS - 16)) - 1)] = bytes(r["data"]), r["n"]
        out = {}
        for k in sorted(found):
            new = found.pop(k)
            n = sum(m for _, m in new.values())
            if old := vectors.Descriptor.of(own.files[paths[k]].get("deletionVector")):
                for at, part in vectors.containers(vectors.load(self.store, old)).items():
                    new[at] = vectors.joined([part, new[at]]) if at in new else part
            out[paths[k]] = vectors.assembled(new), sum(m for _, m in new.values()), n
        return out

    def _url(self, path: str) -> str:
        """A file's URL as the scan names it in its metadata."""
        return self.store.url_of(decoded_path(path))

    @staticmethod
    def _spelled(url: str) -> str:
        return "file:/" + url[len("file:") :].lstrip("/") if url.startswith("file:") else url
