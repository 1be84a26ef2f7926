"""A stream of the lines that are appended to text files, polled at every batch.

Spark's file stream takes a file once, when it is new; this source follows files
that grow, as monitors write them.  Its offset is the length of each file's whole
lines, so a query that stops or dies goes on from its checkpoint without losing
or repeating a line, and a line that isn't finished waits.  A batch's new bytes
are dealt into ranges of bounded size, each read by a task of its own.

The files have to be in a folder that the driver and all workers have mounted.
A file that got shorter is an error, as what was read of it can't be told.
"""

from __future__ import annotations

import glob
import os
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a task's range, and of a file that a batch takes at most.
RANGE, PER_BATCH = 16 << 20, 1 << 30


class Range(InputPartition):
    """Lines that begin in bytes ``low`` to ``high`` of a file."""

    def __init__(self, file: str, low: int, high: int):
        self.file, self.low, self.high = file, low, high


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range, self.per_batch = int(options.get("rangebytes", RANGE)), int(options.get("batchbytes", PER_BATCH))
        self.at: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The end of the last whole line of each file, but not much more than a batch behind the last offset."""
        for file in sorted(glob.glob(self.path)):
            known, size = self.at.get(file, 0), os.path.getsize(file)
            if size < known:
                raise ValueError(f"{file} is shorter than what was read of it")
            if size > known:
                self.at[file] = self._whole(file, known, min(size, known + self.per_batch), size)
        return dict(self.at)

    @staticmethod
    def _whole(file: str, known: int, end: int, size: int) -> int:
        """The end of the last line that ends by ``end``; if none does, that of the first line."""
        with open(file, "rb") as f:
            at = end
            while at > known:
                low = max(known, at - (1 << 16))
                f.seek(low)
                if (k := f.read(at - low).rfind(b"\n")) >= 0:
                    return low + k + 1
                at = low
            f.seek(end)
            line = f.readline() if end < size else b""
            return end + len(line) if line.endswith(b"\n") else known

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.at = {**self.at, **{f: max(n, self.at.get(f, 0)) for f, n in start.items()}}
        return [Range(file, a, min(a + self.range, high)) for file, high in sorted(end.items()) for a in range(start.get(file, 0), high, self.range)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.file:
            return
        with open(partition.file, "rb") as f:
            at = partition.low
            if at:  # a line that begins before belongs to the range before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            while at < partition.high:
                line = f.readline()
                yield partition.file, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plumbline_tail"

    def schema(self) -> str:
        return "file string, position long, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tailed(spark: SparkSession, path: str, range_bytes: int = RANGE, batch_bytes: int = PER_BATCH) -> DataFrame:
    """The stream (file, position, value) of lines appended to the files of a glob pattern."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the source's own process doesn't get what workers get
    spark.dataSource.register(TailSource)
    return spark.readStream.format("plumbline_tail").option("path", path).option("rangebytes", range_bytes).option("batchbytes", batch_bytes).load()
