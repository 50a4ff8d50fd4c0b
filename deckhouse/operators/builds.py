"""Animation builds: click steps, hide sets and states, relationally and per package."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rows import by_rows


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


EFFECTS = T.ArrayType(_struct(step=T.IntegerType(), kind=T.StringType(), spid=T.StringType(), paragraph=T.IntegerType()))


@by_rows(EFFECTS)
def click_effects(xml: bytes | None) -> list[dict]:
    """TV1 by Arrow batches; put a cheap ``contains(content, '<p:timing')`` before it."""
    from ..functions.slides import click_effects as of

    return [dict(zip(("step", "kind", "spid", "paragraph"), e, strict=True)) for e in of(xml)] if xml is not None else []


@by_rows(T.ArrayType(T.BinaryType()))
def slide_states(xml: bytes | None) -> list[bytes]:
    """TV2 (P29-P33, W5) by Arrow batches: the distinct states of a slide that parses."""
    from xml.parsers.expat import ExpatError

    from ..functions.slides import states_of

    try:
        return states_of(xml) if xml is not None else []
    except ExpatError:
        return [xml]


def hide_sets(effects: DataFrame) -> DataFrame:
    """W4, U1, U2, relationally: ``deck, state, shape`` for every shape that is hidden after ``state`` clicks.

    From ``effects(deck, step, kind, shape, paragraph)``. Hidden means: the last entrance is still to come or
    the first exit is past (Q10). A shape with a hidden paragraph is not hidden whole (Q11).
    """
    steps = effects.groupBy("deck").agg(F.max("step").alias("last"))
    keyed = effects.groupBy("deck", "shape", "paragraph").agg(F.max(F.when(F.col("kind") == "entr", F.col("step"))).alias("enters"), F.min(F.when(F.col("kind") == "exit", F.col("step"))).alias("leaves"))
    hidden = keyed.join(steps, "deck").withColumn("state", F.explode(F.sequence(F.lit(0), F.col("last")))).where((F.col("enters") > F.col("state")) | (F.col("leaves") <= F.col("state")))
    return hidden.groupBy("deck", "state", "shape").agg(F.max(F.col("paragraph").isNotNull()).alias("partly")).where("not partly").select("deck", "state", "shape")


def distinct_states(states: DataFrame, keys: list[str], order: str = "k", body: str = "xml") -> DataFrame:
    """States that differ from the one before, renumbered from 0."""
    within = Window.partitionBy(*keys).orderBy(order)
    kept = states.withColumn("_before", F.lag(body).over(within)).withColumn("_first", F.row_number().over(within) == 1)
    kept = kept.where(F.col("_first") | ~F.col(body).eqNullSafe(F.col("_before"))).drop("_before", "_first")
    return kept.withColumn(order, F.row_number().over(within) - 1)


EXPANSION = _struct(deck=T.BinaryType(), expanded=T.ArrayType(_struct(slide=T.IntegerType(), pages=T.IntegerType())), faults=T.ArrayType(T.StringType()), error=T.StringType())


@by_rows(EXPANSION)
def expansion(data: bytes | None) -> dict:
    """TV3 and TV5 by Arrow batches: the expanded deck, which slides were, and what would keep it from opening.

    A deck with faults should be exported unexpanded. Errors are a column, so one bad deck costs only itself.
    """
    from ..functions.package import expand, faults

    if data is None:
        return {"deck": None, "expanded": [], "faults": [], "error": "no content"}
    try:
        out, slides = expand(data)
        return {"deck": out, "expanded": [{"slide": s, "pages": n} for s, n in slides], "faults": [m for _, m in faults(out)], "error": None}
    except Exception as e:
        return {"deck": None, "expanded": [], "faults": [], "error": f"{type(e).__name__}: {e}"}


@by_rows(T.ArrayType(T.BinaryType()))
def slide_variants(data: bytes | None, slide: int) -> list[bytes]:
    """K4 by Arrow batches: a deck for each build state of one slide, by its place in the presentation; none of a deck that has no such
    slide or can't be read."""
    from ..functions.package import Package, variants

    try:
        listed = Package(data or b"").slides()
        return variants(data, listed[slide - 1][0]) if 1 <= slide <= len(listed) else []
    except Exception:
        return []


@by_rows(T.ArrayType(_struct(rule=T.StringType(), message=T.StringType())))
def deck_faults(data: bytes | None) -> list[dict]:
    """TV5 by Arrow batches."""
    from ..functions.package import faults

    return [{"rule": r, "message": m} for r, m in faults(data if data is not None else b"")]


@by_rows(_struct(deck=T.BinaryType(), removed=T.IntegerType()))
def without_fonts(data: bytes | None) -> dict:
    """K9 by Arrow batches; null where a deck embeds no font."""
    from ..functions.package import strip_fonts

    deck, removed = strip_fonts(data) if data is not None else (None, 0)
    return {"deck": deck, "removed": removed}


@by_rows(_struct(pdf=T.BinaryType(), added=T.IntegerType(), error=T.StringType()))
def annotated(pdf: bytes | None, notes: list[tuple[int, str]] | None) -> dict:
    """K8 by Arrow batches, of a PDF column and a map of page to note; a file that can't be annotated has its reason."""
    from ..functions.binary import annotate_pdf

    try:
        out, added = annotate_pdf(pdf or b"", {int(k): v for k, v in notes or []})
        return {"pdf": out, "added": added, "error": None}
    except Exception as e:
        return {"pdf": None, "added": 0, "error": f"{type(e).__name__}: {e}"}


def structural_faults(parts: DataFrame, entries: DataFrame) -> DataFrame:
    """V4, V5, V7, V9-V11, relationally (J16, J17): ``deck, rule, subject``.

    From ``parts(deck, part, text)`` and ``entries(deck, ordinal, sld_id, rid, target)``, the slide list joined to the
    relationships (target null where there is none).
    """
    slides = parts.where(F.rlike("part", F.lit(r"^ppt/slides/slide\d+\.xml$"))).select("deck", "part", F.concat(F.regexp_replace("part", "ppt/slides/", "ppt/slides/_rels/"), F.lit(".rels")).alias("rels"))
    texts = parts.select("deck", F.col("part").alias("rels"), F.col("text").alias("rels_text"))
    types = parts.where("part = '[Content_Types].xml'").select("deck", F.col("text").alias("types"))
    related = slides.join(texts, ["deck", "rels"], "left").join(types, "deck", "left")
    rules = F.array(
        F.when(F.col("rels_text").isNull(), "V4"),
        F.when(~F.contains("rels_text", F.lit("slideLayout")), "V5"),
        F.when(~F.contains("types", F.concat(F.lit('PartName="/'), F.col("part"), F.lit('"'))), "V7"),
    )
    of_slides = related.select("deck", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"), F.col("part").alias("subject"))
    again = entries.groupBy("deck", "sld_id").count().where("count > 1").select("deck", F.lit("V9").alias("rule"), F.col("sld_id").alias("subject"))
    twice = entries.groupBy("deck", "rid").count().where("count > 1").select("deck", F.lit("V9").alias("rule"), F.col("rid").alias("subject"))
    names = parts.select("deck", F.col("part").alias("found"))
    aimed = entries.withColumn("aim", F.concat(F.lit("ppt/"), F.regexp_replace("target", "^/+", "")))
    missed = aimed.alias("e").join(names.alias("n"), (F.col("e.deck") == F.col("n.deck")) & (F.col("e.aim") == F.col("n.found")), "left_anti")
    missed = missed.select("deck", F.when(F.col("target").isNull(), "V10").otherwise("V11").alias("rule"), F.col("rid").alias("subject"))
    return of_slides.union(again).union(twice).union(missed.distinct())
