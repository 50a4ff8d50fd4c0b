"""What the slide list of a deck drops, and where a forecast of build states goes (Q1, Q12).

Export follows the slide list and leaves out, without a word, entries that name no slide; the audit's forecast counts every slide part.
Here each entry and each forecast state has its fate, so the two can be reconciled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import xml
from .builds import click_effects, slide_states

FATES = ("kept", "unclosed", "unrelated", "elsewhere", "missing")


def list_entries(presentation: Column) -> Column:
    """``array<struct<rid, closed>>`` of all entries of the slide list, self-closing (which alone count) or not."""
    listed = F.regexp_extract(presentation, r"(?s)<p:sldIdLst>(.*?)</p:sldIdLst>", 1)
    tags = F.regexp_extract_all(listed, F.lit(r"<p:sldId\b[^>]*>"), F.lit(0))
    return F.transform(tags, lambda t: F.struct(xml.attribute(t, "r:id").alias("rid"), t.endswith("/>").alias("closed")))


def slide_lineage(parts: DataFrame) -> DataFrame:
    """``deck``, ``entries`` of its slide list by fate, ``unlisted`` slides, and its forecast of build states by what becomes of them.

    An entry is ``kept``, or it is ``unclosed`` (not self-closing), ``unrelated`` (no such relationship), points ``elsewhere`` (at no
    relative slide target, e.g. an absolute one) or at a ``missing`` part. ``forecast`` (the clicks of all slides, U3) is ``extra_pages`` (what an
    expansion adds) + ``on_hidden`` + ``on_unlisted`` (slides that have no page) + ``collapsed`` (clicks that change nothing to be seen).

    From ``parts(path, part, content)``; parts without content count as missing. A deck without a presentation has no entries; rows without a deck are left out.
    Slides are cut into states where they lie, and a deck's parts meet in one aggregation, as small facts.
    """
    p = parts.where("path is not null and content is not null").withColumn("kind", xml.part_kind(F.col("part")))
    body = F.decode("content", "UTF-8")
    slide = F.col("part").startswith("ppt/slides/slide")
    timed = slide & F.contains(body, F.lit("<p:timing"))
    of = lambda kind: F.when(F.col("kind") == kind, body)
    p = p.withColumns({"steps": F.when(timed, F.coalesce(F.array_max(F.transform(click_effects(F.when(timed, F.col("content"))), lambda e: e["step"])), F.lit(0))), "states": F.when(timed, F.size(slide_states(F.when(timed, F.col("content")))))})
    fact = F.struct("part", F.coalesce("steps", F.lit(0)).alias("steps"), F.greatest(F.coalesce("states", F.lit(1)) - 1, F.lit(0)).alias("more"), F.coalesce(xml.hidden_in_root(body), F.lit(False)).alias("hidden"))
    targets = F.transform(xml.relationships(of("presentation_rels")), lambda r: F.struct(r["rid"].alias("rid"), xml.slide_target(r["target"]).alias("part")))
    decks = p.groupBy(F.col("path").alias("deck")).agg(
        F.first(F.when(F.col("kind") == "presentation", list_entries(of("presentation"))), ignorenulls=True).alias("listed"), F.first(F.when(F.col("kind") == "presentation_rels", targets), ignorenulls=True).alias("targets"),
        F.collect_list(F.when(slide, fact)).alias("slides"),
    )
    decks = decks.withColumn("names", F.col("slides")["part"])
    mine = lambda e: F.filter(F.coalesce("targets", F.array().cast("array<struct<rid:string,part:string>>")), lambda t: t["rid"] == e["rid"])
    aim = lambda e: F.try_element_at(F.filter(mine(e), lambda t: t["part"].isNotNull()), F.lit(-1))["part"]
    fate = lambda e, part: F.when(~e["closed"], "unclosed").when(F.size(mine(e)) == 0, "unrelated").when(part.isNull(), "elsewhere").when(~F.array_contains("names", part), "missing").otherwise("kept")
    traced = F.transform(F.coalesce("listed", F.array().cast("array<struct<rid:string,closed:boolean>>")), lambda e: F.struct(fate(e, aim(e)).alias("fate"), aim(e).alias("part")))
    decks = decks.withColumn("traced", traced).withColumn("shown", F.filter("traced", lambda e: e["fate"] == "kept")["part"])
    count = lambda name: F.size(F.filter("traced", lambda e: e["fate"] == name)).cast("long").alias(name)
    total = lambda rows, what: F.aggregate(rows, F.lit(0).cast("long"), lambda n, s: n + what(s))
    which = lambda test: F.filter("slides", test)
    listed = lambda s: F.array_contains("shown", s["part"])
    steps = lambda s: s["steps"]
    out = decks.select(
        "deck", F.size("traced").cast("long").alias("entries"), *map(count, FATES), F.size(which(lambda s: ~listed(s))).cast("long").alias("unlisted"), total(F.col("slides"), steps).alias("forecast"),
        total(which(lambda s: listed(s) & ~s["hidden"]), lambda s: s["more"]).alias("extra_pages"), total(which(lambda s: listed(s) & s["hidden"]), steps).alias("on_hidden"), total(which(lambda s: ~listed(s)), steps).alias("on_unlisted"),
    )
    return out.withColumn("collapsed", F.col("forecast") - F.col("extra_pages") - F.col("on_hidden") - F.col("on_unlisted"))
