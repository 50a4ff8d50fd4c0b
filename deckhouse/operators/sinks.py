"""Results as files: JSON records, expanded decks, media, manifests and reports.

Files are written by the executors, under a temporary name that is renamed when whole, so a task that
is run again leaves the same files.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import text

PAGES = "struct<source:string,expanded_slides:array<struct<slide:int,pages:int>>,pages:array<struct<page:int,slide:int,state:int,of:int>>>"
MANIFEST = "dest string, path string, bytes long, exported timestamp"


def write_files(files: DataFrame, folder: str, name: str = "file", content: str = "content") -> None:
    """K3, K4, K7: the bytes of each row as a file below ``folder`` (a local path or an Arrow file system's URI)."""

    def write(rows: Iterator[Row]) -> None:
        target, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        for row in rows:
            path = f"{root.rstrip('/')}/{row[0]}"
            target.create_dir(path.rpartition("/")[0], recursive=True)
            with target.open_output_stream(f"{path}.part") as out:
                out.write(bytes(row[1]))
            target.move(f"{path}.part", path)

    files.select(name, content).where(F.col(content).isNotNull()).foreachPartition(write)


def audit_json(records: DataFrame) -> DataFrame:
    """K1: ``path, json`` of deck records."""
    return records.select("path", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def page_map_json(pages: DataFrame, expanded: DataFrame) -> DataFrame:
    """K5: ``deck, json`` with the source, the expanded slides and the pages of every deck."""
    listed = pages.groupBy("deck").agg(F.array_sort(F.collect_list(F.struct("page", "slide", "state", "of"))).alias("pages"))
    slides = expanded.groupBy("deck").agg(F.array_sort(F.collect_list(F.struct(F.col("slide_no").alias("slide"), F.col("n_states").alias("pages")))).alias("expanded_slides"))
    none = F.array().cast(slides.schema["expanded_slides"].dataType)
    whole = F.struct(text.base_name(F.col("deck")).alias("source"), F.coalesce("expanded_slides", none).alias("expanded_slides"), "pages")
    return listed.join(slides, "deck", "left").select("deck", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


def read_page_maps(spark: SparkSession, path: str) -> DataFrame:
    """``deck, page, slide, state, of`` of page-map files (one JSON document each); a file that is none gives no rows."""
    files = spark.read.text(path, wholetext=True).select(F.from_json("value", PAGES).alias("m"))
    return files.select(F.col("m.source").alias("deck"), F.explode("m.pages").alias("p")).select("deck", "p.*")


def parse_notes(notes: DataFrame, column: str = "json") -> DataFrame:
    """A JSON object of page to note as a map; null for anything else."""
    return notes.withColumn("notes", F.from_json(column, "map<string,string>"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """What earlier runs exported; none if there is no manifest."""
    try:
        return spark.read.schema(MANIFEST).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)


def append_manifest(exported: DataFrame, path: str) -> None:
    """Add ``dest, path, bytes`` of this run, with its time."""
    exported.select("dest", "path", F.col("bytes").cast("long"), F.current_timestamp().alias("exported")).write.mode("append").parquet(path)


def substitution_report(recovered: DataFrame) -> DataFrame:
    """``path`` of decks exported without their embedded fonts, each once, by path."""
    return recovered.where("recovery = 'fonts stripped'").select("path").distinct().orderBy("path")


def human_summary(summary: Row, oversized: list[Row], unreadable: list[Row]) -> str:
    """K2: a library in a few lines, from its one-row summary and its top-5 lists."""
    s = summary
    lines = [
        f"{s.decks} decks, {s.slides} slides, {s.bytes / 1e9:.2f} GB",
        f"  {s.font_risk_decks} decks miss fonts, {s.decks_embedding_fonts} embed theirs",
        f"  {s.animated_slides} animated slides with {s.build_states} builds",
        f"  {s.hidden_slides} hidden slides in {s.decks_with_hidden} decks; they have no page",
        f"  {s.animated_gifs} animated GIFs, {s.videos} videos, {s.external_media} links, {s.noted_slides} slides with notes",
        f"  {s.redundant_copies} redundant copies",
    ]
    if oversized:
        lines += [f"{s.oversized_decks} decks of {s.oversized_bytes_threshold // 1_000_000} MB or more:", *(f"  {d.bytes / 1e6:6.0f} MB  {d.path}" for d in oversized)]
    if unreadable:
        lines += [f"{s.unreadable} decks that can't be read:", *(f"  {d.path}  ({d.error})" for d in unreadable)]
    return "\n".join(lines)


def lines(df: DataFrame) -> Iterator[str]:
    """Rows as tab-separated text, all of them, a partition at a time on the driver."""
    for row in df.toLocalIterator():
        yield "\t".join("" if x is None else str(x) for x in row)


def to_document(records: Iterable[Row], summary: Row) -> Iterator[str]:
    """K1 as one JSON document, piece by piece: the summary and a record for each deck."""
    yield f'{{"summary": {json.dumps(summary.asDict(True))},\n "decks": ['
    for i, r in enumerate(records):
        yield f"{',' if i else ''}\n  {json.dumps(r.asDict(True))}"
    yield "\n ]}\n"


def write_document(records: DataFrame, summary: Row, file: str) -> None:
    """K1: the document as a file; records pass the driver a partition at a time."""
    target, path = pafs.FileSystem.from_uri(file) if "://" in file else (pafs.LocalFileSystem(), file)
    with target.open_output_stream(f"{path}.part") as out:
        for piece in to_document(records.toLocalIterator(), summary):
            out.write(piece.encode())
    target.move(f"{path}.part", path)
