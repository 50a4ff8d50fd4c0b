"""Rendering: which PDF files want images, and exporting decks through a renderer that is plugged in.

An office program can't run here; whoever has one passes a function from deck bytes to PDF bytes.
"""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..sources.decks import list_files
from ..sources.exports import file_system
from . import pages
from .settle import settled
from .sinks import PAGES

IMAGE_EXTENSION = {"png": "png", "jpeg": "jpg", "jpg": "jpg"}
#: Deck bytes to PDF bytes; None or an error means that it failed.
Renderer = Callable[[bytes], bytes | None]
EXPORTED = "path string, status string, recovery string, attempts int, feed string, pdf binary, expanded array<struct<slide:int,pages:int>>, reason string"
#: Failures in a row after which a task tries no further deck.
MOST_FAILURES = 3
#: The page map in an export folder.
PAGE_MAP = "slides.json"


def archive(spark: SparkSession, folder: str, only: str = "") -> DataFrame:
    """``path, dir, stem`` of the PDF files of an archive, by path."""
    files = spark.createDataFrame(list_files(folder, ".pdf", only), "path string, bytes long")
    return files.select("path", text.folder_name(F.col("path")).alias("dir"), F.regexp_replace(text.base_name(F.col("path")), r"\.pdf$", "").alias("stem"))


def archive_images(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` of the images of an archive."""
    found = [f for extension in sorted(set(IMAGE_EXTENSION.values())) for f in list_files(folder, f".{extension}")]
    return spark.createDataFrame(found, "path string, bytes long").select("path")


def render_plan(pdfs: DataFrame, images: DataFrame, image_format: str = "png", force: bool = False) -> DataFrame:
    """the PDFs whose ``images`` folder has no ``images(path)`` of the wanted format yet; all of them by force."""
    if image_format not in IMAGE_EXTENSION:
        raise ValueError("images are png or jpeg")
    if force:
        return pdfs
    have = images.where(F.endswith("path", F.lit("." + IMAGE_EXTENSION[image_format]))).select(text.folder_name(F.col("path")).alias("have")).distinct()
    return pdfs.join(have, F.concat("dir", F.lit("/images")) == F.col("have"), "left_anti")


def only_page(drawn: DataFrame, page: int | None) -> DataFrame:
    """one page, or all."""
    return drawn if page is None else drawn.where(F.col("page") == page)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``page, label`` of a label file, a label a line; empty lines keep their page."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("i", "label"))
    return lines.select((F.col("i") + 1).alias("page"), "label")


_BOXES = T.ArrayType(T.StructType([T.StructField("page", T.IntegerType()), T.StructField("box_width", T.DoubleType()), T.StructField("box_height", T.DoubleType())]))


def _drawn(folder: str):
    """By Arrow batches, for paths of PDF files: the boxes of their pages, the page map beside them, and why there are none."""
    kind = T.StructType([T.StructField("boxes", _BOXES), T.StructField("map", T.StringType()), T.StructField("error", T.StringType())])

    @F.pandas_udf(kind)
    def drawn(paths: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from ..functions.binary import Pdf

        files, _ = file_system(folder)

        def one(path: str) -> tuple:
            try:
                with files.open_input_file(path) as f:
                    boxes = [[float(x) for x in leaf.box] for leaf in Pdf(f.read()).leaves()]
            except Exception as e:
                return [], None, f"{type(e).__name__}: {e}"
            try:
                with files.open_input_file(f"{path.rpartition('/')[0]}/{PAGE_MAP}") as f:
                    listed = f.read().decode()
            except (OSError, ValueError):
                listed = None
            return [{"page": i, "box_width": abs(b[2] - b[0]), "box_height": abs(b[3] - b[1])} for i, b in enumerate(boxes, 1)], listed, None

        for some in paths:
            yield pd.DataFrame([one(p) for p in some], columns=["boxes", "map", "error"])

    return drawn


def images_wanted(pdfs: DataFrame, folder: str, edge: int = 1920, image_format: str = "png", page: int | None = None, labels: DataFrame | None = None) -> DataFrame:
    """``path, page, file, width, height, error`` of every image that ``pdfs(path, stem)`` of an archive below ``folder`` want, by path and page.

    Files are named after the slide and build that a page shows, by the page map beside the PDF or by ``labels(page, label)``; else after the page. A PDF
    that can't be read has a row without a page, with its ``error``. PDFs are opened where their rows are; only boxes and maps are kept of them.
    """
    if image_format not in IMAGE_EXTENSION or edge <= 0:
        raise ValueError("images are png or jpeg, with a positive edge")
    found = settled(pdfs.select(F.col("path").alias("deck"), "stem", _drawn(folder)(F.col("path")).alias("x")))
    boxes = found.select("deck", "stem", F.explode("x.boxes").alias("b")).select("deck", "stem", "b.*")
    if labels is None:
        mapped = found.select("deck", F.from_json("x.map", PAGES).alias("m")).select("deck", F.explode("m.pages").alias("p")).select("deck", "p.*")
        named = pages.labels(mapped)
    else:
        named = boxes.select("deck", "page").join(labels, "page")
    sized = pages.image_names(boxes, named, "", edge, IMAGE_EXTENSION[image_format])
    wanted = only_page(sized, page).join(found.select("deck", "stem"), "deck").select(F.col("deck").alias("path"), "page", F.concat("stem", "file").alias("file"), "width", "height", F.lit(None).cast("string").alias("error"))
    none = F.lit(None)
    broken = found.where("x.error is not null").select("deck", none.cast("int"), none.cast("string"), none.cast("int"), none.cast("int"), "x.error")
    return wanted.union(broken).orderBy("path", "page")


def within(renderer: Renderer, data: bytes, deadline: float | None) -> bytes | None:
    """What ``renderer`` makes of a deck; with a ``deadline`` (seconds) in a process of its own, which is killed when that has passed. Its errors are
    raised here as RuntimeError, and so is its silence."""
    if deadline is None:
        return renderer(data)
    here, there = multiprocessing.get_context("fork").Pipe(duplex=False)

    def work() -> None:
        try:
            there.send((renderer(data), None))
        except BaseException as e:
            there.send((None, f"{type(e).__name__}: {e}"))

    child = multiprocessing.get_context("fork").Process(target=work, daemon=True)
    child.start()
    there.close()
    try:
        if not here.poll(deadline):
            raise TimeoutError(f"nothing after {deadline:g} s")
        pdf, error = here.recv()
    except EOFError:
        raise RuntimeError("the renderer's process died") from None
    finally:
        child.kill()
        child.join()
        here.close()
    if error:
        raise RuntimeError(error)
    return pdf


def export_decks(decks: DataFrame, renderer: Renderer, states: bool = True, deadline: float | None = None, most_failures: int | None = None) -> DataFrame:
    """TV16, K17, W8: ``path, status, recovery, attempts, feed, pdf, expanded, reason`` of ``decks(path, content)``.

    A deck is rendered expanded (if ``states`` and the expansion has no faults), once more if that fails, then
    without its embedded fonts, then unexpanded. ``recovery`` says what was given up. A deck whose attempts
    all fail has its row, with what the last one said as ``reason``; it stops nothing else. An attempt that takes longer than ``deadline`` seconds has
    failed. After ``most_failures`` decks that fail one after the other a task tries no more: what is left of its decks
    is ``stopped`` (the renderer itself is broken then, and each further deck would cost its deadlines).
    """

    def attempts(data: bytes) -> Iterator[tuple[str, bytes, list]]:
        from ..functions.package import expand, faults, strip_fonts

        feed, expanded = data, []
        if states:
            try:
                feed, expanded = expand(data)
                if faults(feed):
                    feed, expanded = data, []
            except Exception:
                feed, expanded = data, []
        yield "deck", feed, expanded
        yield "deck", feed, expanded
        stripped, _ = strip_fonts(feed)
        if stripped is not None:
            yield "nofonts", stripped, expanded
        if feed != data:
            yield "flat", data, []

    def one(path: str, data: bytes | None) -> tuple:
        n, reason = 0, None
        try:
            for n, (kind, feed, expanded) in enumerate(attempts(data or b""), 1):
                try:
                    pdf = within(renderer, feed, deadline)
                    reason = None if pdf else "the renderer made nothing"
                except Exception as e:
                    pdf, reason = None, f"{type(e).__name__}: {e}"
                if pdf:
                    gave_up = {"nofonts": "fonts stripped", "flat": "build states flattened"}.get(kind, "retried" if n > 1 else None)
                    return path, "ok", gave_up, n, kind, pdf, [{"slide": s, "pages": k} for s, k in expanded], None
        except Exception as e:  # no package at all: what the renderer said of it comes first
            reason = reason or f"{type(e).__name__}: {e}"
        return path, "fail", None, n, None, None, [], reason

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = pa.list_(pa.struct([("slide", pa.int32()), ("pages", pa.int32())]))
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.binary(), pages, pa.string()]
        names = ["path", "status", "recovery", "attempts", "feed", "pdf", "expanded", "reason"]
        failures = 0
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if most_failures is not None and failures >= most_failures:
                    row = path, "stopped", None, 0, None, None, [], f"not tried after {failures} failures in a row"
                else:
                    row = one(path, data)
                    failures = 0 if row[1] == "ok" else failures + 1
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

    return decks.select("path", "content").mapInArrow(run, EXPORTED)
