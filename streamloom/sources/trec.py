"""The binary record format: an 8-byte header ("TREC", version 1) and 64-byte records. A Python data source and a writer."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from streamloom.operators.order import numbered, settle

MAGIC, VERSION, HEADER, RECORD = b"TREC", 1, 8, 64
FIELDS = np.dtype({"names": ["stream_id", "ts_ns", "value", "seq"], "formats": ["<u4", "<i8", "<f8", "<u8"], "offsets": [0, 8, 16, 24], "itemsize": RECORD})
NAMES = ["pos", "stream_id", "ts_ns", "value", "seq"]
SCHEMA = "pos long, stream_id long, ts_ns long, value double, seq long"
BATCH = 1 << 16


def trec_status(path: str) -> tuple[str, int, bool]:
    """(status, complete records, whether a partial record follows them); never raises."""
    try:
        size = os.path.getsize(path)
        with open(path, "rb") as f:
            head = f.read(HEADER)
    except OSError:
        return "file_not_found", 0, False
    if len(head) < HEADER or head[:4] != MAGIC:
        return "bad_magic", 0, False
    if struct.unpack("<I", head[4:])[0] != VERSION:
        return "unsupported_version", 0, False
    return "ok", (size - HEADER) // RECORD, (size - HEADER) % RECORD > 0


class _Slice(InputPartition):
    def __init__(self, first: int, end: int):
        super().__init__((first, end))
        self.first, self.end = first, end


class _Reader(DataSourceReader):
    def __init__(self, path: str, per_task: int, bad: str):
        self.path, self.per_task, self.bad = path, per_task, bad

    def partitions(self) -> list[InputPartition]:
        status, n, _ = trec_status(self.path)
        if status != "ok" and self.bad != "empty":
            raise ValueError(f"{self.path}: {status}")
        return [_Slice(at, min(at + self.per_task, n)) for at in range(0, n, self.per_task)] or [_Slice(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.end <= partition.first:
            return
        with open(self.path, "rb") as f:
            for first in range(partition.first, partition.end, BATCH):
                end = min(first + BATCH, partition.end)
                f.seek(HEADER + RECORD * first)
                rows = np.frombuffer(f.read(RECORD * (end - first)), FIELDS)
                if (over := np.flatnonzero(rows["seq"] >= 2**63)).size:
                    raise OverflowError(f"record {first + over[0]}: seq {rows['seq'][over[0]]} exceeds a signed 64-bit integer")
                columns = [np.arange(first, end), rows["stream_id"].astype(np.int64), rows["ts_ns"], rows["value"], rows["seq"].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=NAMES)


class TrecSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trec"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("records_per_task", "1000000")), self.options.get("bad", "fail"))


def read_trec(spark: SparkSession, path: str, records_per_task: int = 1_000_000, bad: str = "fail") -> DataFrame:
    """The complete records of a file, pos being their place. A file that is missing or isn't such a file fails; with bad="empty" it
    has no records."""
    spark.dataSource.register(TrecSource)
    return spark.read.format("trec").option("records_per_task", records_per_task).option("bad", bad).load(path)


def write_trec(messages: DataFrame, path: str) -> int:
    """One file in order of pos; the number of records. Every task writes its records at their own places, so that one that runs again
    does no harm; the file must be where all tasks can write."""
    placed = settle(numbered(messages.select("pos", "stream_id", "ts_ns", "value", "seq"), "nth", ties=("stream_id", "seq")))
    n = placed.count()
    with open(path, "wb") as f:
        f.write(MAGIC + struct.pack("<I", VERSION))
        f.truncate(HEADER + RECORD * n)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        with open(path, "r+b") as f:
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows = np.zeros(batch.num_rows, FIELDS)
                for name in NAMES[1:]:
                    rows[name] = batch.column(name).to_numpy(zero_copy_only=False)
                at = batch.column("nth").to_numpy() - 1
                edges = np.flatnonzero(np.append(True, np.diff(at) != 1)).tolist()
                for lo, hi in zip(edges, [*edges[1:], len(at)], strict=True):
                    f.seek(HEADER + RECORD * int(at[lo]))
                    f.write(rows[lo:hi].tobytes())
                done += batch.num_rows
        yield pa.RecordBatch.from_pydict({"n": [done]})

    put_there = placed.repartitionByRange("nth").sortWithinPartitions("nth").mapInArrow(put, "n long").agg(F.sum("n").alias("n")).first().n or 0
    if put_there != n:
        raise OSError(f"{path}: {put_there} of {n} records were written")
    return n
