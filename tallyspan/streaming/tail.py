"""A stream source for growing record files: its offset is a byte position in each file.

Spark's file source reads a file once; appended lines need a source of their own. Only whole lines are handed
out; a file that has become shorter is read from its start again.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes that one partition reads at most.
SLICE = 64 * 1024 * 1024


class Slice(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        super().__init__(None)
        self.path, self.start, self.end = path, start, end


def whole_lines_end(path: str, start: int, size: int, step: int = 1 << 20) -> int:
    """The position after the last newline in [start, size)."""
    end = size
    with open(path, "rb") as file:
        while end > start:
            low = max(start, end - step)
            file.seek(low)
            at = file.read(end - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            end = low
    return start


def cuts(path: str, start: int, end: int, size: int = SLICE) -> list[tuple[int, int]]:
    """[start, end) in pieces that end at newlines."""
    out = []
    with open(path, "rb") as file:
        while start < end:
            stop = min(end, start + size)
            if stop < end:
                file.seek(stop - 1)
                file.readline()
                stop = min(end, file.tell())
            out.append((start, stop))
            start = stop
    return out


class TailReader(DataSourceStreamReader):
    def __init__(self, pattern: str) -> None:
        self.pattern = pattern

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: os.path.getsize(path) for path in sorted(glob.glob(self.pattern))}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        out = []
        for path, size in end.items():
            first = start.get(path, 0)
            if size < first:
                first = 0
            # both ends are moved back to whole lines, so a torn line is read once it is complete
            low, high = whole_lines_end(path, 0, first) if first else 0, whole_lines_end(path, 0, size)
            out += [Slice(path, a, b) for a, b in cuts(path, low, high)]
        return out

    def read(self, partition: Slice) -> Iterator[tuple]:
        with open(partition.path, "rb") as file:
            file.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = file.readline()
                if line.strip():
                    yield (line.rstrip(b"\n").decode(errors="replace"), partition.path, at)
                at += len(line)

    def commit(self, end: dict) -> None:
        """Spark's checkpoint holds the offsets; nothing else is kept."""


class GrowingLines(DataSource):
    """``spark.readStream.format("growing_lines").option("path", pattern)``: value, file, offset of every appended line."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "value string, file string, offset long"

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options["path"])
