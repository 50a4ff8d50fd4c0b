"""Speaker notes by presentation position (export's rule: entities decoded, hidden slides left out)."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import xml
from .pages import notes_without_map, page_notes, page_of


def presentation_slides(parts: DataFrame) -> DataFrame:
    """``deck, slide_no, part, hidden`` in presentation order, from parts with content.

    Entries without a relationship to a slide, or to a part that isn't there, are left out (Q12).
    """
    p = parts.withColumn("kind", xml.part_kind(F.col("part"))).withColumn("xml", F.decode("content", "UTF-8"))
    listed = p.where("kind = 'presentation'").select(F.col("path").alias("deck"), F.posexplode(xml.slide_entries(F.col("xml"))).alias("ordinal", "entry")).select("deck", "ordinal", "entry.rid")
    rels = p.where("kind = 'presentation_rels'").select(F.col("path").alias("deck"), F.explode(xml.relationships(F.col("xml"))).alias("r")).select("deck", "r.rid", xml.slide_target(F.col("r.target")).alias("part"))
    rels = rels.where("part is not null").groupBy("deck", "rid").agg(F.last("part").alias("part"))
    slides = p.where(F.col("part").startswith("ppt/slides/slide")).select(F.col("path").alias("deck"), "part", xml.hidden_in_root(F.col("xml")).alias("hidden"))
    return slide_numbers(listed.join(rels, ["deck", "rid"])).join(slides, ["deck", "part"]).select("deck", "slide_no", "part", "hidden")


def slide_numbers(entries: DataFrame) -> DataFrame:
    from .pages import slide_positions

    return slide_positions(entries)


def slide_notes(parts: DataFrame) -> DataFrame:
    """TV6 (J2, J3, P12): ``deck, slide_no, text`` of visible slides with notes.

    Entities are decoded before lines are trimmed and joined, so the rule of the audit (P11) runs on decoded
    text; markup signs that decoding brings are no markup.
    """
    p = parts.withColumn("kind", xml.part_kind(F.col("part"))).withColumn("xml", F.decode("content", "UTF-8"))
    slides = presentation_slides(parts).where(~F.col("hidden"))
    rels = p.where("kind = 'slide_rels'").select(F.col("path").alias("deck"), F.regexp_replace(F.regexp_replace("part", "/_rels/", "/"), r"\.rels$", "").alias("part"), xml.notes_target(F.col("xml")).alias("target"))
    notes = p.where("kind = 'notes'").select(F.col("path").alias("deck"), F.col("part").alias("target"), first_note(xml.body_runs(F.col("xml"))).alias("text"))
    return slides.join(rels, ["deck", "part"]).join(notes, ["deck", "target"]).where("text <> ''").select("deck", "slide_no", "text")


@F.pandas_udf(T.StringType())
def first_note(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """P12 of ``xml.body_runs``, by Arrow batches: html entities have thousands of names, which only a library knows.

    The first body whose lines, decoded and trimmed, hold more than digits; empty if none does or the column is null.
    """
    for some in bodies:
        yield some.map(lambda found: next(filter(_says_something, map(_lines, found if found is not None else ())), ""))


def _lines(paragraphs) -> str:
    decoded = ("".join(map(html.unescape, runs)).strip() for runs in paragraphs)
    return "\n".join(line for line in decoded if line)


def _says_something(text: str) -> bool:
    return any(not sign.isdecimal() for sign in "".join(text.split()))


def notes_on_pages(parts: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """TV7: ``deck, page, text``; with a page map on every build page, else on the slide's page."""
    notes = slide_notes(parts)
    return page_notes(pages, notes) if pages is not None else notes_without_map(notes, page_of(presentation_slides(parts)))


def notes_total(notes: DataFrame) -> DataFrame:
    """``deck, notes, chars`` of notes on pages, their build prefixes included."""
    return notes.groupBy("deck").agg(F.count("*").alias("notes"), F.sum(F.length("text")).cast("long").alias("chars"))


def notes_json(notes: DataFrame) -> DataFrame:
    """K6: ``deck, json`` with pages as keys, for decks that have notes."""
    pairs = F.array_sort(F.collect_list(F.struct("page", "text")))
    entries = F.transform(pairs, lambda p: F.struct(p["page"].cast("string").alias("key"), p["text"].alias("value")))
    return notes.groupBy("deck").agg(F.to_json(F.map_from_entries(entries)).alias("json"))
