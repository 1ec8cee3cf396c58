"""What the corpus operators share: reading tables, working storage, Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeferry.shipping import ship

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another system's library keeps memory as it likes
    _LIBC = None

#: Arrow batches hold at most so many rows, so that a batch of long texts stays small beside an executor's memory.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Make ready for Python functions: send the package to the executors, and bound the rows of an Arrow batch. Spark bounds its bytes
    (spark.sql.execution.arrow.maxBytesPerBatch)."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or, only where that is unset, a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="lakeferry-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lakeferry-{uuid.uuid4().hex}"


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows, written to shared storage and read back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that cut() wrote, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def refuse_taken(df: DataFrame, name: str) -> None:
    """A result's column must not replace one of the table's."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {name!r} already; name another for the result")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that text operators need, under fixed names, so that no other column can clash."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def bounded_sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """About `rows` of the distinct rows of df, or all if there are fewer, and never more than twice as many.

    A hash of the columns `by` decides on each row where it is, so that what reaches the driver doesn't grow with the number of
    tasks; copies of a row fall together and count once.
    """
    share = min(1.0, rows / max(1, df.count()))
    return df.where(F.pmod(F.xxhash64(*by), F.lit(1 << 40)) < int(share * (1 << 40))).distinct().limit(2 * rows)


#: In a Python worker, what operators have built there (models, hash sets), by name, with the task that used it last.
_HELD: dict[str, list] = {}


def once(name: str, make: Callable[[], Any]) -> Any:
    """What `make` gives, made once for each worker. What earlier tasks have left behind goes when something new comes: workers outlive
    tasks and stages, and an operator's model must not stay beside the next one's."""
    task = TaskContext.get()
    now = task.taskAttemptId() if task else None
    if name not in _HELD:
        for old in [k for k, (_, last) in _HELD.items() if last != now]:
            del _HELD[old]
        _HELD[name] = [make(), now]
    _HELD[name][1] = now
    return _HELD[name][0]


def tidy() -> None:
    """Give memory that a Python worker no longer needs back to the system: workers outlive tasks, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def strings(column: pa.Array) -> list[str]:
    """Texts; null is empty."""
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that have rows."""
    return (b for b in rows if b.num_rows)
