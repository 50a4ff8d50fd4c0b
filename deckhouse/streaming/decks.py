"""A library as a stream: every deck once, and again whenever it has changed.

The source keeps a log of its own, one file for each increment with the decks that it found new (path, size, time of the last change), and its
offset is the number of the last one. An increment is read again from the log, never from a new listing, so a query that is started anew
sees what it saw before. The rules for names are those of the batch source: ``_draft.pptx`` is a deck here, which Spark's file source passes over.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader
from pyspark.sql.types import StructType

from ..sources.decks import DECKS, PARTITION_BYTES, PARTS, DeckPartition, DeckReader, packed
from ..sources.exports import file_system
from ..sources.listing import LibraryReader

#: Decks in an increment at most.
DECKS_A_BATCH = 10_000


class DeckStream(DataSource):
    """Options of the batch source, and ``log`` (a folder for the source's own log) and ``batch`` (decks in an increment at most)."""

    @classmethod
    def name(cls) -> str:
        return "deck_stream"

    def schema(self) -> str:
        return DECKS if self.options.get("rows") == "decks" else PARTS

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return DeckStreamReader(dict(self.options))


class DeckStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.most = int(options.get("batch", DECKS_A_BATCH))
        self.seen: set[int] | None = None  # hashes of what the log has
        self.last = -1

    def initialOffset(self) -> dict:
        return {"batch": -1}

    def _log(self) -> tuple[pafs.FileSystem, str]:
        return file_system(self.options["log"])

    def _batch(self, k: int) -> list[tuple[str, int, int]]:
        files, log = self._log()
        with files.open_input_stream(f"{log}/{k:08d}.jsonl") as f:
            return [tuple(json.loads(line)) for line in f.read().splitlines()]

    def latestOffset(self) -> dict:
        files, log = self._log()
        if self.seen is None:
            files.create_dir(log, recursive=True)
            names = sorted(i.base_name for i in files.get_file_info(pafs.FileSelector(log)) if i.base_name.endswith(".jsonl"))
            self.last = len(names) - 1
            self.seen = {hash(deck) for k in range(len(names)) for deck in self._batch(k)}
        new: list[tuple[str, int, int]] = []
        reader = LibraryReader(self.options)
        for partition in reader.partitions():
            for batch in reader.read(partition):
                new += [deck for deck in zip(*(c.to_pylist() for c in batch.columns), strict=True) if hash(deck) not in self.seen]
                while len(new) >= self.most:
                    self._add(new[: self.most])
                    new = new[self.most :]
        if new:
            self._add(new)
        return {"batch": self.last}

    def _add(self, decks: list[tuple[str, int, int]]) -> None:
        files, log = self._log()
        name = f"{log}/{self.last + 1:08d}.jsonl"
        with files.open_output_stream(f"{name}.part") as f:
            f.write("".join(json.dumps(deck) + "\n" for deck in decks).encode())
        files.move(f"{name}.part", name)
        self.last += 1
        self.seen.update(map(hash, decks))

    def partitions(self, start: dict, end: dict) -> list[DeckPartition]:
        decks = [(path, size) for k in range(start["batch"] + 1, end["batch"] + 1) for path, size, _ in self._batch(k)]
        return packed(decks, int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def read(self, partition: DeckPartition) -> Iterator[pa.RecordBatch]:
        yield from DeckReader(self.options, []).read(partition)


def deck_stream(spark: SparkSession, path: str, log: str, **options: str) -> DataFrame:
    """Decks (``rows="decks"``) or their members of a growing library as a stream, with the columns of ``sources.decks``. A deck comes once for each
    state (size and time) that a listing finds it in; ``log`` belongs to one query, as its checkpoint does. An empty library has no increments."""
    spark.dataSource.register(DeckStream)
    return spark.readStream.format("deck_stream").options(path=path, log=log, **options).load()
