"""Deck libraries as a Spark data source.

``read_parts`` and ``read_decks`` list on the executors (``sources.listing``) and deal the decks out by path, to ``tasks`` tasks. With
``partition_bytes``, as by ``spark.read.format("decks")`` after ``register(spark)``, the driver lists and packs decks by size. Every URI that
Arrow's file systems read (local folders, s3, gs, hdfs) works, by ranged reads: executors open packages
by path, read their directories, and inflate no member but those asked for.

Options
-------
path       a folder or a single deck
hidden     ``audit`` (default): dot folders and names starting ``.`` or ``~$`` are left out (S1);
           ``export``: only names starting ``~$`` or ``._`` are (S2)
only       a literal part of the path (F1)
rows       ``parts`` (default): a row for each member (M2, S5); ``decks``: a row for each deck (M1)
content    regular expression of the members whose bytes are wanted (S6); default: XML and
           relationships. With ``rows=decks``: ``true`` for the whole package.
partition_bytes  size of the decks that one task takes together; a larger deck is a task of its own
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

PARTS = "path string, name string, bytes long, status string, error string, ordinal int, part string, part_bytes long, compress_type int, content binary"
DECKS = "path string, name string, bytes long, status string, error string, content binary"
#: Large decks can hang an office program; they are tasks of their own here.
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 16 << 20


def is_deck(path: str, root: str, hidden: str) -> bool:
    """Whether a path below ``root`` is a deck under a hidden rule."""
    *folders, name = path.removeprefix(root.rstrip("/") + "/").split("/")
    if not name.lower().endswith(".pptx"):
        return False
    if hidden == "export":
        return not name.startswith(("~$", "._"))
    return not name.startswith((".", "~$")) and not any(f.startswith(".") for f in folders)


def open_library(uri: str) -> tuple[pafs.FileSystem, pafs.FileInfo]:
    """S3: the file system of a folder or deck and its entry; an error for anything else."""
    files, root = pafs.FileSystem.from_uri(uri) if re.match(r"[a-z0-9+.-]+://", uri) else (pafs.LocalFileSystem(), uri)
    info = files.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"no such file or folder: {uri}")
    if info.type == pafs.FileType.File and not root.lower().endswith(".pptx"):
        raise ValueError(f"not a .pptx file: {uri}")
    return files, info


def list_decks(uri: str, hidden: str = "audit", only: str = "") -> list[tuple[str, int]]:
    """Decks of a library, by code point of their path, with their sizes."""
    files, info = open_library(uri)
    root = info.path
    if info.type == pafs.FileType.File:
        found = [info]
    else:
        listed = files.get_file_info(pafs.FileSelector(root, recursive=True))
        found = [f for f in listed if f.type == pafs.FileType.File and is_deck(f.path, root, hidden)]
    return sorted((f.path, f.size) for f in found if only in f.path)


def list_files(uri: str, suffix: str, only: str = "") -> list[tuple[str, int]]:
    """Files below a folder whose name ends so, by path, with their sizes."""
    files, root = pafs.FileSystem.from_uri(uri) if re.match(r"[a-z0-9+.-]+://", uri) else (pafs.LocalFileSystem(), uri)
    listed = files.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in listed if f.type == pafs.FileType.File and f.path.endswith(suffix) and only in f.path)


@dataclass
class DeckPartition(InputPartition):
    decks: list[tuple[str, int]]


def packed(decks: list[tuple[str, int]], most: int) -> list[DeckPartition]:
    """Decks in their order, as many to a partition as ``most`` bytes hold (one at least)."""
    out: list[DeckPartition] = []
    held = most + 1
    for path, size in decks:
        if held + size > most:
            out.append(DeckPartition([]))
            held = 0
        out[-1].decks.append((path, size))
        held += size
    return out or [DeckPartition([])]


class DeckSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "decks"

    def schema(self) -> str:
        return DECKS if self.options.get("rows") == "decks" else PARTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return DeckReader(dict(self.options), [f.name for f in schema.fields])


class DeckReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        self.options, self.columns = options, columns

    def partitions(self) -> list[DeckPartition]:
        found = list_decks(self.options["path"], self.options.get("hidden", "audit"), self.options.get("only", ""))
        return packed(found, int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def read(self, partition: DeckPartition) -> Iterator[pa.RecordBatch]:
        uri = self.options["path"]
        files = pafs.FileSystem.from_uri(uri)[0] if re.match(r"[a-z0-9+.-]+://", uri) else pafs.LocalFileSystem()
        whole = self.options.get("rows") == "decks"
        wanted = re.compile(self.options.get("content", "" if whole else r"\.(xml|rels)$"))
        rows: list[tuple] = []
        held = 0
        for path, size in partition.decks:
            for row in self._deck(files, path, size, self.options.get("content") == "true") if whole else self._members(files, path, size, wanted):
                rows.append(row)
                held += len(row[-1] or b"")
                if held > BATCH_BYTES:
                    yield self._batch(rows, whole)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows, whole)

    def _batch(self, rows: list[tuple], whole: bool) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        named = [c.split() for c in (DECKS if whole else PARTS).split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), named, strict=True)], names=[n for n, _ in named])

    @staticmethod
    def _deck(files: pafs.FileSystem, path: str, size: int, content: bool) -> Iterator[tuple]:
        from ..functions.package import status_of

        names, error = None, None
        try:
            with files.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                names = z.namelist()
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
        data = None
        if content:
            with files.open_input_file(path) as f:
                data = f.read()
        yield path, path.rpartition("/")[2], size, status_of(names), error, data

    @staticmethod
    def _members(files: pafs.FileSystem, path: str, size: int, wanted: re.Pattern) -> Iterator[tuple]:
        """A row for each member; a package that can't be read has one row, without a member."""
        from ..functions.package import status_of

        deck = path, path.rpartition("/")[2], size
        try:
            with files.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                # Of members with one name, the last is the one that counts.
                members = list({m.filename: (i, m) for i, m in enumerate(z.infolist())}.values())
                status = status_of([m.filename for _, m in members])
                for i, m in members:
                    data, error = None, None
                    if wanted.search(m.filename):
                        try:
                            data = z.read(m)
                        except Exception as e:
                            error = f"{type(e).__name__}: {e}"
                    yield *deck, status, error, i, m.filename, m.file_size, m.compress_type, data
                if not members:
                    yield *deck, status, None, None, None, None, None, None
        except Exception as e:
            yield *deck, "unreadable", f"{type(e).__name__}: {e}", None, None, None, None, None


def register(spark: SparkSession) -> None:
    """Make ``format("decks")`` known to a session."""
    spark.dataSource.register(DeckSource)


def _opened(spark: SparkSession, schema: str, options: dict[str, str]) -> DataFrame:
    """Decks that executors list, dealt out by path and opened where they come."""
    from .listing import read_library

    if "partition_bytes" in options:
        register(spark)
        return spark.read.format("decks").options(**options).load()
    listed = read_library(spark, options["path"], **{k: v for k, v in options.items() if k in ("hidden", "only", "seeds")})
    reader = DeckReader(options, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from reader.read(DeckPartition(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))))

    tasks = int(options.get("tasks", 4 * spark.sparkContext.defaultParallelism))
    return listed.select("path", "bytes").repartition(tasks, "path").mapInArrow(run, schema)


def read_parts(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return _opened(spark, PARTS, {**options, "path": path, "rows": "parts"})


def read_decks(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return _opened(spark, DECKS, {**options, "path": path, "rows": "decks"})
