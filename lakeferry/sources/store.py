"""Small files in any store that Spark reaches: through Hadoop's file systems, or directly where the store is local."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

from lakeferry.functions.paths import join_url, local_path, resolve_url


@dataclass(frozen=True)
class Listed:
    path: str  # relative to the store
    size: int
    modified_ms: int


class Store:
    """A folder."""

    def __init__(self, spark: SparkSession, url: str):
        self.spark, self.url = spark, resolve_url(url)
        self.local = local_path(self.url)
        jvm = spark.sparkContext._jvm
        self._path = lambda rel="": jvm.org.apache.hadoop.fs.Path(join_url(self.url, rel) if rel else self.url)
        self._path_of = lambda local: jvm.org.apache.hadoop.fs.Path(f"file://{local}")
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def full(self, rel: str) -> str:
        return join_url(self.url, rel)

    def url_of(self, rel: str) -> str:
        """A file's URL with what Hadoop escapes in it."""
        return self._path(rel).toUri().toString()

    def read(self, rel: str) -> bytes:
        if self.local:
            with open(os.path.join(self.local, rel), "rb") as f:
                return f.read()
        stream = self._fs.open(self._path(rel))
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def footer(self, rel: str) -> bytes | None:
        """The last bytes of a Parquet file from its footer on, by ranged reads; None if there is no such file."""
        path = self._path(rel)
        if not self._fs.exists(path) or not (status := self._fs.getFileStatus(path)).isFile() or status.getLen() < 12:
            return None
        stream, last = self._fs.open(path), b""
        try:
            for n in (8, None):
                n = n or min(status.getLen(), 8 + int.from_bytes(last[:4], "little"))
                stream.seek(status.getLen() - n)
                last = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        return last if last.endswith(b"PAR1") else None

    def exists(self, rel: str = "") -> bool:
        return self._fs.exists(self._path(rel))

    def write(self, rel: str, data: bytes) -> None:
        """Put a file there, whole, in place of any other."""
        if self.local:
            self._staged(rel, data, os.replace)
            return
        out = self._fs.create(self._path(rel), True)
        try:
            out.write(data)
        finally:
            out.close()

    def write_new(self, rel: str, data: bytes) -> None:
        """Put a file there, whole, or raise FileExistsError: of several writers one succeeds.

        Locally by a link; elsewhere by an exclusive create, which a store must offer (HDFS does; object stores need conditional puts).
        """
        if self.local:
            self._staged(rel, data, os.link)
            return
        try:
            out = self._fs.create(self._path(rel), False)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(rel) from e
            raise
        try:
            out.write(data)
        finally:
            out.close()

    def _staged(self, rel: str, data: bytes, place) -> None:
        path = os.path.join(self.local, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temp = os.path.join(os.path.dirname(path), f".{uuid.uuid4().hex}.tmp")
        try:
            with open(temp, "wb") as f:
                f.write(data)
            place(temp, path)
        finally:
            if os.path.exists(temp):
                os.unlink(temp)

    def delete(self, rel: str) -> bool:
        return self._fs.delete(self._path(rel), True)

    def fetch(self, rel: str, local: str) -> None:
        """A copy of a file on the driver's disk."""
        self._fs.copyToLocalFile(False, self._path(rel), self._path_of(local), True)

    def put(self, local: str, rel: str) -> None:
        self._fs.mkdirs(self._path())
        self._fs.copyFromLocalFile(False, True, self._path_of(local), self._path(rel))

    def rename(self, rel: str, to: str) -> None:
        self._fs.mkdirs(self._path(to).getParent())
        self.delete(to)
        if not self._fs.rename(self._path(rel), self._path(to)):
            raise OSError(f"can't rename {rel} to {to}")

    def list(self, rel: str = "", recursive: bool = False) -> list[Listed]:
        if not self.exists(rel):
            return []
        root = self._path().toUri().getPath().rstrip("/") + "/"
        files, out = self._fs.listFiles(self._path(rel), recursive), []
        while files.hasNext():
            f = files.next()
            path = f.getPath().toUri().getPath()
            if not path.endswith(".tmp") and not path.endswith(".crc"):
                out.append(Listed(path.removeprefix(root), f.getLen(), f.getModificationTime()))
        return sorted(out, key=lambda x: x.path)
