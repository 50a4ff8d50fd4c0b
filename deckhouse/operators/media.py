"""Playable media and external links of slides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, xml
from ..functions.binary import gif_frame_count


def media_kind(extension: Column, frames: Column, all_gifs: bool = False, svg: bool = False) -> Column:
    """Null for what is not extracted. A GIF without a header counts as animated (Q4), unknown kinds as other."""
    still = F.lit(False) if all_gifs else F.coalesce(frames <= 1, F.lit(False))
    return (
        F.when(extension.isin(text.STILLS), None)
        .when(extension.isin(text.VIDEO), "video")
        .when(extension.isin(text.AUDIO), "audio")
        .when(extension == ".gif", F.when(~still, "animated-gif"))
        .when(extension == ".svg", "svg" if svg else None)
        .otherwise("other")
    )


def media_usage(files: DataFrame, uses: DataFrame) -> DataFrame:
    """``files(deck, file, ...)`` with ``slides``, the sorted distinct slides of ``uses(deck, file, slide)``;
    unused files stay, with none."""
    used = uses.groupBy("deck", "file").agg(F.array_sort(F.collect_set("slide")).alias("slides"))
    return files.join(used, ["deck", "file"], "left").withColumn("slides", F.coalesce("slides", F.array().cast("array<int>")))


def media_name(stem: Column, slides: Column, file: Column) -> Column:
    """The deck's stem, the first slide or ``unplaced``, the file."""
    first = F.when(F.size(slides) > 0, F.concat(F.lit("slide"), F.lpad(F.array_min(slides).cast("string"), F.greatest(F.lit(3), F.length(F.array_min(slides).cast("string"))), F.lit("0")))).otherwise("unplaced")
    return F.concat_ws("-", stem, first, file)


def extract_media(parts: DataFrame, all_gifs: bool = False, svg: bool = False) -> DataFrame:
    """TV8: ``deck, file, kind, source, slides, bytes, frames, content`` by part name (O8). Read the parts with media
    content. Slides are file numbers, as the audit's (Q6)."""
    media = parts.where(F.col("part").startswith("ppt/media/")).select(F.col("path").alias("deck"), "part", text.base_name(F.col("part")).alias("file"), text.extension(F.col("part")).alias("ext"), F.col("part_bytes").alias("bytes"), "content")
    media = media.withColumn("frames", F.when(F.col("ext") == ".gif", gif_frame_count(F.when(F.col("ext") == ".gif", F.col("content")))))
    media = media.withColumn("kind", media_kind(F.col("ext"), F.col("frames"), all_gifs, svg)).where("kind is not null")
    rels = parts.where(F.rlike("part", F.lit(xml.SLIDE_RELS)))
    uses = rels.select(F.col("path").alias("deck"), xml.number_in(F.col("part"), xml.SLIDE_RELS).alias("slide"), F.explode(xml.media_targets(F.decode("content", "UTF-8"))).alias("file"))
    out = media_usage(media, uses).withColumn("source", F.col("file"))
    return out.select("deck", media_name(text.stem(F.col("deck")), F.col("slides"), F.col("source")).alias("file"), "kind", "source", "slides", "bytes", "frames", "content")


def external_links(rels: DataFrame, patterns: str = text.MEDIA_HOSTS, quotes: bool = True) -> DataFrame:
    """P14 (``AUDIT_HOSTS``, quotes False) or P15: ``deck, slide, url`` of playable external targets of
    ``rels(deck, slide, xml)``, in order."""
    url = F.replace(F.col("target"), F.lit("&quot;"), F.lit('"')) if quotes else F.col("target")
    targets = rels.select("deck", "slide", F.explode(xml.external_targets(F.col("xml"))).alias("target"))
    return targets.select("deck", "slide", url.alias("url")).where(text.is_playable(F.col("url"), patterns))


def kind_summary(items: DataFrame) -> DataFrame:
    """``kind, items``."""
    return items.groupBy("kind").agg(F.count("*").alias("items"))


def media_json(items: DataFrame, links: DataFrame) -> DataFrame:
    """K7: ``deck, json`` for decks with items or links."""
    listed = items.groupBy("deck").agg(F.array_sort(F.collect_list(F.struct("file", "kind", "source", "slides", "bytes", "frames"))).alias("items"))
    linked = links.groupBy("deck").agg(F.array_sort(F.collect_list(F.struct("slide", "url"))).alias("external"))
    return listed.join(linked, "deck", "full").select("deck", F.to_json(F.struct(text.base_name(F.col("deck")).alias("deck"), F.coalesce("items", F.array().cast(listed.schema["items"].dataType)).alias("items"), F.coalesce("external", F.array().cast(linked.schema["external"].dataType)).alias("external"))).alias("json"))
