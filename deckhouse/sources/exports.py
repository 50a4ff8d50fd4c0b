"""The output store as a table: the export folders that are there, and which deck each says it is from.

``spark.read.format("exports")`` lists breadth first on the driver only until there are enough folders to deal out; executors
walk what is below them. A folder counts as exported if its name is that of an export and something is in it (S16, TV15).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

EXPORTS = "dest string, path string, run string, files long"
#: What an export folder holds about itself: a JSON object with ``source`` and ``run``.
RECORD = ".source.json"
EXPORT_NAME = re.compile(r" \(export\)( \(\d+\))?$")
#: Folders that are dealt out to tasks, at least.
SEEDS = 256


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a local path or URI, and the path in it."""
    files, root = pafs.FileSystem.from_uri(uri) if re.match(r"[a-z0-9+.-]+://", uri) else (pafs.LocalFileSystem(), uri)
    return files, root.rstrip("/") or "/"


def scheme_of(uri: str) -> str:
    return uri.partition("://")[0] + "://" if "://" in uri else ""


def source_record(files: pafs.FileSystem, folder: str) -> tuple[str | None, str | None]:
    """The deck that an export folder says it is from, and the run; nulls if it says nothing that can be read."""
    try:
        with files.open_input_file(f"{folder}/{RECORD}") as f:
            said = json.loads(f.read())
        return tuple(x if isinstance(x, str) else None for x in (said.get("source"), said.get("run")))
    except (OSError, ValueError, AttributeError):
        return None, None


def _children(files: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    try:
        return files.get_file_info(pafs.FileSelector(folder))
    except OSError:  # it went meanwhile, or may not be read
        return []


def _folders(files: pafs.FileSystem, folder: str) -> list[str]:
    return [c.path for c in _children(files, folder) if c.type == pafs.FileType.Directory and not c.base_name.startswith(".")]


@dataclass
class Folders(InputPartition):
    found: list[str]
    below: list[str]


class ExportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "exports"

    def schema(self) -> str:
        return EXPORTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return ExportReader(self.options["path"], int(self.options.get("seeds", SEEDS)))


class ExportReader(DataSourceReader):
    def __init__(self, uri: str, seeds: int) -> None:
        self.uri, self.seeds = uri, seeds

    def partitions(self) -> list[Folders]:
        files, root = file_system(self.uri)
        level, found = [root], []
        if files.get_file_info(root).type != pafs.FileType.Directory:
            return [Folders([], [])]
        while level and len(level) < self.seeds:
            inner = [f for folder in level for f in _folders(files, folder)]
            found += [f for f in inner if EXPORT_NAME.search(f)]
            level = [f for f in inner if not EXPORT_NAME.search(f)]
        n = max(1, min(self.seeds, len(level) + len(found)))
        return [Folders(found[i::n], level[i::n]) for i in range(n)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        files, _ = file_system(self.uri)
        scheme = scheme_of(self.uri)
        rows: list[tuple] = []

        def walk(folders: list[str]) -> Iterator[str]:
            while folders:
                for f in _folders(files, folders.pop()):
                    if EXPORT_NAME.search(f):
                        yield f
                    else:
                        folders.append(f)

        for folders in (partition.found, walk(list(partition.below))):
            for folder in folders:
                held = _children(files, folder)
                if held:
                    rows.append((scheme + folder, *source_record(files, folder), sum(c.base_name != RECORD for c in held)))
                if len(rows) >= 1000:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["dest", "path", "run", "files"])


def read_exports(spark: SparkSession, uri: str, **options: str) -> DataFrame:
    """``dest, path, run, files`` of the export folders below ``uri`` that hold anything, whatever wrote them; ``path`` and ``run`` are null where a
    folder doesn't say. No rows if there is no such folder. Hidden folders, and what is in an export folder, aren't looked at."""
    spark.dataSource.register(ExportSource)
    return spark.read.format("exports").options(path=uri, **options).load()
