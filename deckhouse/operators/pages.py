"""Slides, pages, notes on pages and page labels.

Three keys are never mixed (Q6): ``slide_file_no`` (the N of slideN.xml), ``slide_no`` (the position
in the presentation) and ``page`` (of the exported PDF). All windows are per deck, so their groups
are as large as a deck.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RUNNING = (Window.unboundedPreceding, 0)


def slide_positions(entries: DataFrame, deck: str = "deck", order: str = "ordinal") -> DataFrame:
    """Adds ``slide_no``, from 1, in the given order."""
    return entries.withColumn("slide_no", F.row_number().over(Window.partitionBy(deck).orderBy(order)))


def page_map(slides: DataFrame, expanded: DataFrame) -> DataFrame:
    """TV4 (J5, F6, W2): ``deck, page, slide, state, of`` from ``slides(deck, slide_no, hidden)`` and
    ``expanded(deck, slide_no, n_states)``. Hidden slides have no page; state and of are null where a slide
    has one page."""
    counted = slides.where(~F.col("hidden")).join(expanded, ["deck", "slide_no"], "left").withColumn("of", F.greatest(F.coalesce("n_states", F.lit(1)), F.lit(1)).cast("int"))
    states = counted.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    page = F.row_number().over(Window.partitionBy("deck").orderBy("slide_no", "k"))
    several = F.col("of") > 1
    return states.select("deck", page.alias("page"), F.col("slide_no").alias("slide"), F.when(several, F.col("k")).alias("state"), F.when(several, F.col("of")).alias("of"))


def page_of(slides: DataFrame) -> DataFrame:
    """``deck, slide_no, page`` of the visible slides of an unexpanded deck."""
    running = F.sum((~F.col("hidden")).cast("int")).over(Window.partitionBy("deck").orderBy("slide_no").rowsBetween(*_RUNNING))
    return slides.withColumn("page", running.cast("int")).where(~F.col("hidden")).select("deck", "slide_no", "page")


def build_note(text: Column, state: Column, of: Column) -> Column:
    """The note with its place among the builds, if the page has a state (0 included)."""
    prefix = F.concat(F.lit("[build "), state.cast("string"), F.lit(" of "), (of - 1).cast("string"), F.lit("]\n"))
    return F.when(state.isNotNull(), F.concat(prefix, text)).otherwise(text)


def page_notes(pages: DataFrame, notes: DataFrame) -> DataFrame:
    """J6, TV7 with a page map: ``deck, page, text`` from a page map and ``notes(deck, slide_no, text)``; a note
    is on all pages of its slide. Empty notes are none."""
    mine = notes.where("text <> ''").select("deck", F.col("slide_no").alias("slide"), "text")
    return pages.join(mine, ["deck", "slide"]).select("deck", "page", build_note(F.col("text"), F.col("state"), F.col("of")).alias("text"))


def notes_without_map(notes: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """TV7 without a page map: by ``page_of`` if given, else the slide number is the page."""
    if pages is None:
        return notes.select("deck", F.col("slide_no").alias("page"), "text")
    return notes.join(pages, ["deck", "slide_no"]).select("deck", "page", "text")


def labels(pages: DataFrame) -> DataFrame:
    """``deck, page, label``; slide and build numbers are padded to the deck's widest, 2 at least."""
    deck = Window.partitionBy("deck")
    width = F.greatest(F.lit(2), F.length(F.max("slide").over(deck).cast("string")))
    state_width = F.greatest(F.lit(2), F.length(F.max(F.coalesce("of", F.lit(1))).over(deck).cast("string")))
    sized = pages.withColumn("w", width).withColumn("sw", state_width)
    slide = F.lpad(F.col("slide").cast("string"), F.col("w"), F.lit("0"))
    state = F.lpad((F.col("state") + 1).cast("string"), F.col("sw"), F.lit("0"))
    return sized.select("deck", "page", F.when(F.col("state").isNull(), slide).otherwise(F.concat(slide, F.lit("."), state)).alias("label"))


def image_names(pages: DataFrame, named: DataFrame, prefix: str, edge: int, extension: str = "png") -> DataFrame:
    """J18, P37, K11 (naming and sizing): ``deck, page, file, width, height`` from ``pages(deck, page, box_width,
    box_height)`` and labels; the longer side becomes ``edge``; unlabelled pages are numbered. Boxes without
    an extent have no image."""
    scale = F.lit(float(edge)) / F.greatest("box_width", "box_height")
    pad = F.greatest(F.lit(2), F.length(F.count("*").over(Window.partitionBy("deck")).cast("string")))
    numbered = pages.withColumn("number", F.lpad(F.col("page").cast("string"), pad, F.lit("0"))).where("box_width > 0 and box_height > 0")
    joined = numbered.join(named, ["deck", "page"], "left")
    label = F.coalesce(F.nullif("label", F.lit("")), "number")
    sized = joined.select("deck", "page", F.concat(F.lit(prefix + "-"), label, F.lit("." + extension)).alias("file"), F.round(F.col("box_width") * scale).cast("int").alias("width"), F.round(F.col("box_height") * scale).cast("int").alias("height"))
    return sized.where("width > 0 and height > 0")
