"""An Arrow IPC stream into a file object, partition by partition: the driver holds the batches of one."""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame

from lakeferry.functions.types import ColumnSpec
from lakeferry.plans.outcome import Outcome
from lakeferry.shipping import ship


class ArrowSink:
    kind = "arrow"
    source_rows: int | None = None

    def __init__(self, out: BinaryIO, target: str, columns=()):
        if getattr(out, "isatty", lambda: False)():
            raise ValueError("an Arrow stream isn't written to a terminal; redirect it to a file or another command")
        self.out, self.target, self.columns = out, target, list(columns)

    def prepare(self, df: DataFrame, columns: list[ColumnSpec]) -> None:
        ship(df.sparkSession)
        schema = df.limit(0).toArrow().schema

        def packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in rows:
                yield pa.RecordBatch.from_arrays([pa.array([b.serialize().to_pybytes()], pa.binary())], ["batch"])

        self.parts, self.schema = df.mapInArrow(packed, "batch binary"), schema

    def publish(self) -> Outcome:
        n = 0
        with pa.ipc.new_stream(self.out, self.schema) as stream:
            sent = None
            for r in self.parts.toLocalIterator(prefetchPartitions=True):
                if sent is None:
                    sent = self.schema
                batch = pa.ipc.read_record_batch(pa.py_buffer(bytes(r.batch)), sent)
                stream.write_batch(batch)
                n += batch.num_rows
        self.source_rows = n
        return Outcome(self.kind, self.target, files=[{"path": "-", "rows": n, "size_bytes": 0}])

    def abort(self) -> None:
        pass
