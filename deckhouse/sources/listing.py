"""Listing a library on the executors.

``spark.read.format("library")`` walks folders breadth first on the driver only until there are ``seeds`` of them to deal out; tasks
walk what is below. The driver holds those folders and the children of one at a time, never the library's paths (S1, S2, S4).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .decks import is_deck, open_library

FILES = "path string, bytes long, modified long"
#: Folders that are dealt out to tasks, if the library has as many.
SEEDS = 256
_BATCH = 4096


@dataclass
class Walk(InputPartition):
    """Folders whose own files are wanted, and folders with everything below them."""

    flat: list[str]
    deep: list[str]


class LibrarySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "library"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: StructType) -> DataSourceReader:
        return LibraryReader(dict(self.options))


class LibraryReader(DataSourceReader):
    """Decks below ``path`` under the rule ``hidden``, with ``only`` in their path: path, size and time of the last change (microseconds)."""

    def __init__(self, options: dict[str, str]) -> None:
        self.uri, self.hidden, self.only, self.seeds = options["path"], options.get("hidden", "audit"), options.get("only", ""), int(options.get("seeds", SEEDS))

    def partitions(self) -> list[Walk]:
        files, info = open_library(self.uri)
        if info.type == pafs.FileType.File:
            return [Walk([info.path], [])]
        queue, flat = deque([info.path]), []
        while queue and len(queue) < self.seeds:
            folder = queue.popleft()
            flat.append(folder)
            queue.extend(c.path for c in files.get_file_info(pafs.FileSelector(folder)) if c.type == pafs.FileType.Directory and self._enters(c.base_name))
        n = max(1, min(self.seeds, len(queue) + len(flat)))
        deep = list(queue)
        return [Walk(flat[i::n], deep[i::n]) for i in range(n)]

    def _enters(self, folder: str) -> bool:
        return self.hidden == "export" or not folder.startswith(".")

    def read(self, partition: Walk) -> Iterator[pa.RecordBatch]:
        files, info = open_library(self.uri)
        rows: list[tuple] = []
        waiting = [(f, True) for f in partition.deep] + [(f, False) for f in partition.flat]
        while waiting:
            folder, below = waiting.pop()
            found = [info] if info.type == pafs.FileType.File else files.get_file_info(pafs.FileSelector(folder))
            for c in found:
                if c.type == pafs.FileType.Directory:
                    if below and self._enters(c.base_name):
                        waiting.append((c.path, True))
                elif (c is info or is_deck(c.path, info.path, self.hidden)) and self.only in c.path:
                    rows.append((c.path, c.size, (c.mtime_ns or 0) // 1000))
                if len(rows) >= _BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "bytes", "modified"])


def read_library(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """``path, bytes, modified`` of the decks of a library (a folder or one deck), listed by executors. ValueError or FileNotFoundError for anything else (S3)."""
    open_library(path)
    spark.dataSource.register(LibrarySource)
    return spark.read.format("library").options(path=path, **options).load()
