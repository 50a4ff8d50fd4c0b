"""Facts of package parts by regular expression, JVM-side; whole trees are left to ``slides.py``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SYMBOL_FACES

SLIDE_PART = r"^ppt/slides/slide(\d+)\.xml$"
SLIDE_RELS = r"^ppt/slides/_rels/slide(\d+)\.xml\.rels$"


def part_kind(part: Column) -> Column:
    """What a package member is, by name."""
    return (
        F.when(part.rlike(SLIDE_PART), "slide")
        .when(part.rlike(SLIDE_RELS), "slide_rels")
        .when(part == "ppt/presentation.xml", "presentation")
        .when(part == "ppt/_rels/presentation.xml.rels", "presentation_rels")
        .when(part.startswith("ppt/slides/slide"), "slide_like")
        .when(part.startswith("ppt/slideLayouts/"), "layout")
        .when(part.startswith("ppt/slideMasters/"), "master")
        .when(part.startswith("ppt/theme/"), "theme")
        .when(part.startswith("ppt/media/"), "media")
        .when(part.startswith("ppt/notesSlides/"), "notes")
        .when(part.rlike(r"(?i)^ppt/fonts/.+\.fntdata$"), "font")
        .when(part == "[Content_Types].xml", "content_types")
        .otherwise("other")
    )


def number_in(part: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(part, pattern, 1), F.lit("")).cast("int")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in a tag; null if it isn't there."""
    return F.nullif(F.regexp_extract(tag, rf'{name}="([^"]+)"', 1), F.lit(""))


def size_attribute(presentation: Column, name: str) -> Column:
    tag = F.regexp_extract(presentation, r"<p:sldSz\b[^>]*>", 0)
    return F.try_to_number(F.nullif(F.regexp_extract(tag, rf'{name}="(\d+)"', 1), F.lit("")), F.lit("999999999999")).cast("long")


def embedded_faces(presentation: Column) -> Column:
    """Face names of embedded fonts, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(presentation, F.lit(r'<p:embeddedFont>\s*<p:font[^>]*typeface="([^"]+)"'), F.lit(1))))


def latin_faces(xml: Column) -> Column:
    """Latin faces of a slide, layout or master, without theme references and symbol faces."""
    found = F.regexp_extract_all(xml, F.lit(r'<a:latin[^>]*typeface="([^"]+)"'), F.lit(1))
    return F.filter(F.array_distinct(found), lambda f: ~f.startswith("+") & ~f.isin(SYMBOL_FACES))


def theme_faces(xml: Column) -> Column:
    """P5: the same, inside the major and minor font blocks of a theme."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?s)<a:(?:major|minor)Font>.*?</a:(?:major|minor)Font>"), F.lit(0))
    return latin_faces(F.array_join(blocks, "\n"))


def hidden_in_root(xml: Column) -> Column:
    """The first slide tag says show="0" (export's test)."""
    return F.contains(F.regexp_extract(xml, r"<p:sld\b[^>]*>", 0), F.lit('show="0"'))


def hidden_anywhere(xml: Column) -> Column:
    """A slide tag says show="0" (audit's test)."""
    return F.rlike(xml, F.lit(r'<p:sld\b[^>]*\sshow="0"'))


def notes_target(rels: Column) -> Column:
    """The notes part that a slide's relationships name; null if none."""
    found = F.regexp_extract(rels, r'Target="\.\./(notesSlides/notesSlide\d+\.xml)"', 1)
    return F.when(found != "", F.concat(F.lit("ppt/"), found))


def external_targets(rels: Column) -> Column:
    """Targets of external relationships, in order, with ``&amp;`` decoded."""
    tags = F.regexp_extract_all(rels, F.lit(r'<Relationship\b[^>]*TargetMode="External"[^>]*/>'), F.lit(0))
    found = F.filter(F.transform(tags, lambda t: attribute(t, "Target")), lambda t: t.isNotNull())
    return F.transform(found, lambda t: F.replace(t, F.lit("&amp;"), F.lit("&")))


def media_targets(rels: Column) -> Column:
    """Base names of the media that a slide's relationships name."""
    return F.array_distinct(F.regexp_extract_all(rels, F.lit(r'Target="\.\./media/([^"]+)"'), F.lit(1)))


def relationships(rels: Column) -> Column:
    """``array<struct<rid, target, mode>>`` of a relationships part (M3)."""
    tags = F.regexp_extract_all(rels, F.lit(r"<Relationship\b[^>]*>"), F.lit(0))
    return F.transform(tags, lambda t: F.struct(attribute(t, "Id").alias("rid"), attribute(t, "Target").alias("target"), attribute(t, "TargetMode").alias("mode")))


def slide_target(target: Column) -> Column:
    """The slide part that a presentation relationship names; null for any other target (Q12)."""
    bare = F.regexp_replace(target, "^/+", "")
    return F.when(bare.startswith("slides/slide"), F.concat(F.lit("ppt/"), bare))


def slide_entries(presentation: Column) -> Column:
    """``array<struct<sld_id, rid>>`` of the slide list, in order (self-closing entries only, Q12)."""
    listed = F.regexp_extract(presentation, r"(?s)<p:sldIdLst>(.*?)</p:sldIdLst>", 1)
    tags = F.regexp_extract_all(listed, F.lit(r"<p:sldId\b[^>]*/>"), F.lit(0))
    return F.transform(tags, lambda t: F.struct(F.nullif(F.regexp_extract(t, r'\bid="(\d+)"', 1), F.lit("")).alias("sld_id"), attribute(t, "r:id").alias("rid")))


def body_runs(xml: Column) -> Column:
    """``array<array<array<string>>>``: the text runs of each paragraph of each body placeholder of a notes part, as written."""
    shapes = F.regexp_extract_all(xml, F.lit(r"(?s)<p:sp\b.*?</p:sp>"), F.lit(0))
    bodies = F.filter(shapes, lambda s: s.rlike(r'<p:ph\b[^>]*type="body"'))
    paragraphs = lambda s: F.regexp_extract_all(s, F.lit(r"(?s)<a:p\b.*?</a:p>"), F.lit(0))
    return F.transform(bodies, lambda s: F.transform(paragraphs(s), lambda p: F.regexp_extract_all(p, F.lit(r"(?s)<a:t>(.*?)</a:t>"), F.lit(1))))


def note_lines(xml: Column) -> Column:
    """Text of the first body placeholder with any; paragraphs by line feed, no entity decoding; empty if none.

    Digits and white space alone are no text.
    """
    from .text import strip

    lines = lambda body: F.transform(body, lambda runs: strip(F.array_join(runs, "")))
    texts = F.transform(body_runs(xml), lambda body: strip(F.array_join(F.filter(lines(body), lambda x: x != ""), "\n")))
    return F.coalesce(F.try_element_at(F.filter(texts, lambda t: ~t.rlike(r"(?U)^[\d\s]*$")), F.lit(1)), F.lit(""))
