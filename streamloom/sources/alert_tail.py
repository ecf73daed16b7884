"""A growing file of alerts, one JSON object per line, read as a stream whose offset is a place in the file.

Only whole lines count. The checkpoint holds the offset, so that a restart neither repeats nor loses a line. Executors must see
the file; a batch is read in ranges, each by its own task. Malformed lines are left out. A file shorter than its offset (it was
cut) gives nothing until it has grown past it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "pos long, stream_id long, ts_ns long, layer string, detail string, created_at string"
FIELDS = [tuple(c.split()) for c in SCHEMA.split(", ")][1:]
KINDS = {"long": int, "string": str}
BLOCK = 1 << 16


def whole_lines(path: str) -> int:
    """The place after the last line end; 0 without a file or a whole line."""
    try:
        end = os.path.getsize(path)
        with open(path, "rb") as f:
            while end > 0:
                begin = max(0, end - BLOCK)
                f.seek(begin)
                at = f.read(end - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
    except FileNotFoundError:
        pass
    return 0


def parse_alert(line: bytes) -> tuple | None:
    """The fields of SCHEMA but pos, each as its kind; None if one is missing or doesn't fit."""
    try:
        said = json.loads(line)
        row = tuple(KINDS[kind](said[name]) for name, kind in FIELDS)
    except (LookupError, ArithmeticError, ValueError, TypeError):
        return None
    return row if all(kind != "long" or -(2**63) <= v < 2**63 for v, (_, kind) in zip(row, FIELDS, strict=True)) else None


class Range(InputPartition):
    def __init__(self, begin: int, end: int, first: bool):
        super().__init__((begin, end))
        self.begin, self.end, self.first = begin, end, first


def ranges(begin: int, end: int, per_task: int) -> list[InputPartition]:
    return [Range(at, min(at + per_task, end), at == begin) for at in range(begin, end, per_task)] or [Range(0, 0, True)]


def read_range(path: str, part: Range) -> Iterator[tuple]:
    """Alerts of the lines that begin within the range; pos is where."""
    if part.end <= part.begin:
        return
    with open(path, "rb") as f:
        f.seek(part.begin if part.first else part.begin - 1)
        if not part.first:
            f.readline()  # the rest of a line that begins in the range before
        at = f.tell()
        while at < part.end:
            line = f.readline()
            if not line.endswith(b"\n"):
                return
            row = parse_alert(line)
            if row:
                yield at, *row
            at += len(line)


class _Batch(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task

    def partitions(self) -> list[InputPartition]:
        return ranges(0, whole_lines(self.path), self.per_task)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return read_range(self.path, partition)


class _Tail(DataSourceStreamReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task, self.known = path, per_task, 0

    def initialOffset(self) -> dict:
        return {"byte": 0}

    def latestOffset(self) -> dict:
        self.known = max(self.known, whole_lines(self.path))
        return {"byte": self.known}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.known = max(self.known, end["byte"])
        return ranges(start["byte"], end["byte"], self.per_task)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return read_range(self.path, partition)


class AlertFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "alert_lines"

    def schema(self) -> str:
        return SCHEMA

    def _arguments(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("bytes_per_task", str(1 << 26)))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(*self._arguments())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Tail(*self._arguments())


def read_alerts(spark: SparkSession, path: str, bytes_per_task: int = 1 << 26) -> DataFrame:
    spark.dataSource.register(AlertFile)
    return spark.read.format("alert_lines").option("bytes_per_task", bytes_per_task).load(path)


def tail_alerts(spark: SparkSession, path: str, bytes_per_task: int = 1 << 26) -> DataFrame:
    spark.dataSource.register(AlertFile)
    return spark.readStream.format("alert_lines").option("bytes_per_task", bytes_per_task).load(path)
