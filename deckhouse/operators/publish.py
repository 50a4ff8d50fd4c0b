"""Export folders that appear whole or not at all.

Tasks write the folders of their decks to a staging area, each attempt to a place of its own, and only what the job commits counts: a
``DataSource`` writer's commit names the lists of the attempts that won, in one small file. After it ``publish`` moves every folder to where it belongs, on the executors
and as often as it takes: a folder that was moved before says so itself. A job that is killed before its commit has shown nothing, one that is killed
after it is completed by ``recover``. Folders move by one rename, so the store needs a file system that has those.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..sources.exports import RECORD, file_system, scheme_of, source_record

STAGING = ".deckhouse-staging"
#: Runs that haven't committed after so long are taken for dead.
STALE = timedelta(hours=24)
PUBLISHED = "dest string, path string, files long, bytes long, status string"
_COMMITTED = "committed.json"


@dataclass
class Staged(WriterCommitMessage):
    listing: str


class FolderSink(DataSource):
    """Rows ``dest, path, file, content, replace`` as files ``dest/file``, staged; options ``staging`` and ``run``."""

    @classmethod
    def name(cls) -> str:
        return "export_folders"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FolderWriter(self.options["staging"], self.options["run"])


class FolderWriter(DataSourceWriter):
    def __init__(self, staging: str, run: str) -> None:
        self.staging, self.run = staging, run

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        files, staging = file_system(self.staging)
        place = f"{staging}/{self.run}/{uuid.uuid4().hex}"
        files.create_dir(place, recursive=True)
        last, folder, k = None, "", 0
        with files.open_output_stream(f"{place}/list.jsonl") as listing:
            for row in iterator:
                if row["dest"] != last:
                    last, folder, k = row["dest"], f"{place}/{k}", k + 1
                    files.create_dir(folder, recursive=True)
                    _put(files, f"{folder}/{RECORD}", json.dumps({"source": row["path"], "run": self.run}).encode())
                    said = {"staged": folder, "dest": file_system(row["dest"])[1], "path": row["path"], "replace": bool(row["replace"])}
                    listing.write(json.dumps(said).encode() + b"\n")
                if row["file"] is not None and row["content"] is not None:
                    name = f"{folder}/{row['file']}"
                    files.create_dir(name.rpartition("/")[0], recursive=True)
                    _put(files, name, bytes(row["content"]))
        return Staged(f"{place}/list.jsonl")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, staging = file_system(self.staging)
        files.create_dir(f"{staging}/{self.run}", recursive=True)
        where = f"{staging}/{self.run}/{_COMMITTED}"
        _put(files, f"{where}.part", json.dumps([m.listing for m in messages if m]).encode())
        files.move(f"{where}.part", where)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, staging = file_system(self.staging)
        _remove(files, f"{staging}/{self.run}")


def _put(files: pafs.FileSystem, name: str, data: bytes) -> None:
    with files.open_output_stream(name) as out:
        out.write(data)


def _remove(files: pafs.FileSystem, folder: str) -> None:
    if files.get_file_info(folder).type == pafs.FileType.Directory:
        files.delete_dir(folder)


def _filled(files: pafs.FileSystem, folder: str) -> bool:
    return files.get_file_info(folder).type == pafs.FileType.Directory and bool(files.get_file_info(pafs.FileSelector(folder)))


def settle(files: pafs.FileSystem, said: dict, run: str) -> str:
    """Put one staged folder in its place: ``ok``, or ``exists`` if something of another run is there that wasn't to be replaced. Doing it again changes nothing."""
    staged, dest = said["staged"], said["dest"]
    if files.get_file_info(staged).type != pafs.FileType.Directory:
        return "ok" if source_record(files, dest)[1] == run else "exists"
    if _filled(files, dest):
        if not said["replace"]:
            return "exists"
        _remove(files, f"{staged}.old")
        files.move(dest, f"{staged}.old")
    else:
        _remove(files, dest)
    files.create_dir(dest.rpartition("/")[0], recursive=True)
    files.move(staged, dest)
    return "ok"


def stage(folders: DataFrame, out: str, run: str | None = None) -> str:
    """Write ``folders(dest, path, file, content, replace)`` to the staging area of the store ``out``; the run's name. A folder's rows come to one task, one
    file at a time, so a deck costs its largest file; a null file or content gives the folder alone."""
    run = run or f"{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    spark = folders.sparkSession
    spark.dataSource.register(FolderSink)
    rows = folders.select("dest", "path", "file", "content", "replace").repartition("dest").sortWithinPartitions("dest", "file")
    rows.write.format("export_folders").mode("append").options(staging=f"{out.rstrip('/')}/{STAGING}", run=run).save()
    return run


def publish(spark: SparkSession, out: str, run: str) -> DataFrame:
    """Move what a committed run has staged to where it belongs: ``dest, path, files, bytes, status`` of every folder, kept in the staging area until ``clear``."""
    staging = f"{out.rstrip('/')}/{STAGING}"
    files, root = file_system(staging)
    kept = f"{staging}/{run}/published"
    with files.open_input_file(f"{root}/{run}/{_COMMITTED}") as f:
        lists = json.loads(f.read())
    scheme = scheme_of(out)

    def move(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = file_system(staging)
        for batch in batches:
            for listing in batch.column(0).to_pylist():
                with files.open_input_stream(listing) as f:
                    entries = [json.loads(line) for line in f.read().splitlines()]
                for said in entries:
                    status = settle(files, said, run)
                    held = [i for i in files.get_file_info(pafs.FileSelector(said["dest"], recursive=True)) if i.type == pafs.FileType.File and i.base_name != RECORD] if status == "ok" else []
                    yield pa.RecordBatch.from_pylist([{"dest": scheme + said["dest"], "path": said["path"], "files": len(held), "bytes": sum(i.size for i in held), "status": status}], schema=_SCHEMA)

    named = spark.createDataFrame([(x,) for x in lists], "list string").repartition(max(1, len(lists)))  # a list for each task that wrote
    named.mapInArrow(move, PUBLISHED).write.mode("overwrite").parquet(kept)
    return spark.read.schema(PUBLISHED).parquet(kept)


_SCHEMA = pa.schema([("dest", pa.string()), ("path", pa.string()), ("files", pa.int64()), ("bytes", pa.int64()), ("status", pa.string())])


def log(published: DataFrame, manifest: str, run: str) -> None:
    """The rows of a run in a manifest, as a partition of their own; logging a run twice leaves it once."""
    rows = published.where("status = 'ok'").select("dest", "path", "bytes", F.current_timestamp().alias("exported"))
    rows.write.mode("overwrite").parquet(f"{manifest.rstrip('/')}/run={run}")


def clear(out: str, run: str) -> None:
    """Remove what a run has in the staging area, replaced folders included."""
    files, staging = file_system(f"{out.rstrip('/')}/{STAGING}")
    _remove(files, f"{staging}/{run}")
    if files.get_file_info(staging).type == pafs.FileType.Directory and not _filled(files, staging):
        files.delete_dir(staging)


def recover(spark: SparkSession, out: str, manifest: str | None = None, stale: timedelta = STALE) -> list[str]:
    """Complete the runs of a store that have committed and gone no further, and remove those that never did for ``stale``; the names of the former."""
    files, staging = file_system(f"{out.rstrip('/')}/{STAGING}")
    done = []
    if files.get_file_info(staging).type != pafs.FileType.Directory:
        return done
    for each in files.get_file_info(pafs.FileSelector(staging)):
        if files.get_file_info(f"{each.path}/{_COMMITTED}").type == pafs.FileType.File:
            finish(spark, out, each.base_name, manifest)
            done.append(each.base_name)
        elif each.mtime and datetime.now(UTC) - each.mtime > stale:
            _remove(files, each.path)
    clear(out, "none")
    return done


def finish(spark: SparkSession, out: str, run: str, manifest: str | None = None) -> list[Row]:
    """``publish``, ``log`` and ``clear``; folders that stood in the way, as rows ``dest, path``."""
    published = publish(spark, out, run)
    if manifest:
        log(published, manifest, run)
    blocked = published.where("status <> 'ok'").select("dest", "path").collect()  # none, but where two runs write one folder
    clear(out, run)
    return blocked
