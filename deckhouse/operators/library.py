"""Library inventory: deck records, duplicates, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, xml
from ..functions.binary import gif_frames
from ..functions.rows import by_rows
from ..functions.slides import click_effects
from .settle import settled


def with_duplicates(decks: DataFrame) -> DataFrame:
    """A8, W7 (Q15): ``duplicate_of`` and ``duplicate_group_size`` by (bytes, slides). The first deck by path is the
    original.

    Only groups of several come back to the decks, and a group is only a minimum and a count, so a group of any
    size is harmless. ``decks`` is evaluated twice: settle what is dear.
    """
    groups = decks.groupBy("bytes", "slides").agg(F.min("path").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = decks.join(groups, ["bytes", "slides"], "left")
    return met.withColumn("duplicate_of", F.when(F.col("first") != F.col("path"), F.col("first"))).withColumn("duplicate_group_size", F.coalesce("n", F.lit(1)).cast("long")).drop("first", "n")


def redundant_copies(decks: DataFrame) -> DataFrame:
    """``redundant_copies``, one row."""
    groups = decks.groupBy("bytes", "slides").agg((F.count("*") - 1).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("redundant_copies"))


def oversized(decks: DataFrame, threshold: int = text.OVERSIZED_BYTES, top: int = 5) -> DataFrame:
    """The largest decks from the threshold on, largest first, then by path."""
    return decks.where(F.col("bytes") >= threshold).orderBy(F.desc("bytes"), "path").limit(top)


def unreadable(decks: DataFrame, top: int = 5) -> DataFrame:
    """O3: the first unreadable decks by path."""
    return decks.where("error is not null").orderBy("path").limit(top)


def missing_faces(decks: DataFrame) -> DataFrame:
    """A10: ``face, decks`` by frequency, then by the first deck and place (Q19), from ``decks(path, fonts_missing)``."""
    faces = decks.select("path", F.posexplode("fonts_missing").alias("place", "face"))
    counted = faces.groupBy("face").agg(F.count("*").alias("decks"), F.min(F.struct("path", "place")).alias("first"))
    return counted.orderBy(F.desc("decks"), "first").select("face", "decks")


def face_misses(faces: DataFrame, available: DataFrame, embedded: DataFrame | None = None) -> DataFrame:
    """``deck, face`` of the faces of ``faces(deck, face)`` that neither ``available(key)`` nor the deck's own
    ``embedded(deck, key)`` holds under either spelling. Both spellings are tried by one anti-join each."""
    keyed = faces.withColumn("k1", text.face_key(F.col("face"))).withColumn("k2", text.plain_key(F.col("face")))
    for key in ("k1", "k2"):
        keyed = keyed.join(available.select(F.col("key").alias(key)).distinct(), key, "left_anti")
        if embedded is not None:
            keyed = keyed.join(embedded.select("deck", F.col("key").alias(key)).distinct(), ["deck", key], "left_anti")
    return keyed.select("deck", "face")


def font_keys(names: DataFrame, column: str = "name") -> DataFrame:
    """Both spellings of font files or names, as ``key``."""
    bare = F.regexp_replace(column, r"\.[^.]*$", "")
    return names.select(F.explode(F.array(text.face_key(F.col(column)), text.plain_key(bare))).alias("key")).distinct()


@by_rows(T.StringType())
def _plain_ratio(ratio: float | None) -> str | None:
    """T5: two decimals of the very double, which Spark rounds from its shortest form."""
    return None if ratio is None or ratio != ratio else f"{ratio:.2f}:1"


@by_rows(T.StructType([T.StructField("steps", T.IntegerType()), T.StructField("frames", T.IntegerType())]))
def _opened(content: bytes | None, gif: bool | None) -> dict:
    """Click steps of a slide, or frames of a GIF: one function, so that a task has one Python worker for both, and only numbers come back."""
    if content is None:
        return {"steps": 0, "frames": None}
    if gif:
        return {"steps": 0, "frames": gif_frames(content)}
    return {"steps": max((step for step, *_ in click_effects(content)), default=0), "frames": None}


def aspect(ratio: Column) -> Column:
    """The named ratio, or two decimals."""
    return F.coalesce(text.named_ratio(ratio), _plain_ratio(ratio))


def deck_records(parts: DataFrame, available: DataFrame) -> DataFrame:
    """TV9 (A1-A7, F2, F4, U3, U4): a record for each deck, from parts with content and a catalogue ``available(key)`` of font keys.

    One pass: all features of a part are computed on its row, and a deck's rows meet once (they come from one
    task, so partial aggregation has merged them by then). Faces are looked up with the record beside them, which
    keeps the partitioning by deck. Members that can't be read give the deck an ``error`` and keep what was
    gathered (Q18).
    """
    kind, body = xml.part_kind(F.col("part")), F.decode("content", "UTF-8")
    p = parts.withColumn("kind", kind).withColumn("xml", F.when(~F.col("kind").isin("media", "font"), body))
    slide, rels = F.col("kind") == "slide", F.col("kind") == "slide_rels"
    timed = slide & F.contains("xml", F.lit("<p:timing"))
    extension = text.extension(F.col("part"))
    gif = (F.col("kind") == "media") & (extension == ".gif")
    file_no = xml.number_in(F.col("part"), xml.SLIDE_RELS)
    external = F.transform(F.filter(xml.external_targets(F.col("xml")), lambda u: text.is_playable(u, text.AUDIT_HOSTS)), lambda u: F.struct(file_no.alias("slide"), u.alias("url")))
    none = F.array().cast("array<string>")
    faces = F.when(F.col("kind").isin("slide", "slide_like", "layout", "master"), xml.latin_faces(F.col("xml"))).when(F.col("kind") == "theme", xml.theme_faces(F.col("xml")))
    p = p.withColumn("opened", _opened(F.when(timed | gif, F.col("content")), gif)).withColumns({"steps": F.col("opened.steps"), "ext": extension, "frames": F.col("opened.frames")})
    p = p.withColumn("media", F.when(F.col("kind") != "media", None).when(F.col("ext").isin(text.VIDEO), "video").when(F.col("ext").isin(text.AUDIO), "audio").when(F.col("frames") > 1, "gif"))
    presentation = F.when(F.col("kind") == "presentation", F.col("xml"))
    decks = p.groupBy("path").agg(
        F.first("name").alias("name"), F.first("bytes").alias("bytes"), F.count_if(slide).cast("int").alias("slides"),
        F.max(xml.size_attribute(presentation, "cx")).alias("cx"), F.max(xml.size_attribute(presentation, "cy")).alias("cy"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(faces)))).alias("fonts"),
        F.coalesce(F.max(xml.embedded_faces(presentation)), none).alias("fonts_embedded"),
        F.count_if(slide & (F.col("steps") > 0)).cast("int").alias("animated_slides"), F.sum(F.when(slide, F.col("steps")).otherwise(0)).cast("int").alias("build_states"),
        F.count_if(slide & xml.hidden_anywhere(F.col("xml"))).cast("int").alias("hidden_slides"),
        *(F.count_if(F.col("media") == m).cast("int").alias(n) for m, n in (("gif", "gifs"), ("video", "videos"), ("audio", "audio"))),
        F.array_sort(F.collect_list(F.when(rels & (F.size(external) > 0), F.struct("ordinal", external.alias("links"))))).alias("links"),
        F.sum(F.when(F.col("media").isNotNull(), F.col("part_bytes")).otherwise(0)).alias("media_bytes"),
        F.collect_list(F.when(rels, xml.notes_target(F.col("xml")))).alias("targets"),
        F.map_from_entries(F.collect_list(F.when(F.col("kind") == "notes", F.struct("part", F.length(xml.note_lines(F.col("xml"))).alias("chars"))))).alias("noted"),
        F.max("error").alias("error"),
    )
    chars = F.filter(F.transform("targets", lambda t: F.try_element_at("noted", t)), lambda n: n > 0)
    decks = decks.withColumns({"noted_slides": F.size(chars), "notes_chars": F.aggregate(chars, F.lit(0), lambda n, c: n + c), "external_media": F.flatten(F.transform("links", lambda x: x["links"]))}).drop("targets", "noted", "links")
    record = [c for c in decks.columns if c != "path"]
    own = F.flatten(F.transform("fonts_embedded", lambda e: F.array(text.face_key(e), text.plain_key(e))))
    one = decks.select("path", F.struct(*record).alias("r"), own.alias("own"), F.explode_outer("fonts").alias("face"))
    known = available.select("key").distinct()
    for k, key in (("k1", text.face_key(F.col("face"))), ("k2", text.plain_key(F.col("face")))):
        one = one.withColumn(k, key).join(known.select(F.col("key").alias(k), F.lit(True).alias(f"has_{k}")), k, "left")
    held = F.col("has_k1").isNotNull() | F.col("has_k2").isNotNull() | F.array_contains("own", F.col("k1")) | F.array_contains("own", F.col("k2"))
    missing = F.when(F.col("face").isNotNull() & ~F.coalesce(held, F.lit(False)), F.col("face"))
    out = one.groupBy("path").agg(F.first("r").alias("r"), F.array_sort(F.collect_list(missing)).alias("fonts_missing")).select("path", "r.*", "fonts_missing")
    both = F.col("cx").isNotNull() & F.col("cy").isNotNull()
    return out.select(
        "path", "name", "bytes", "slides", F.when(both, text.pixels(F.col("cx"))).alias("width_px"), F.when(both, text.pixels(F.col("cy"))).alias("height_px"),
        aspect(F.try_divide(F.col("cx").cast("double"), F.col("cy").cast("double"))).alias("aspect"), "fonts", "fonts_embedded", "fonts_missing", "animated_slides", "build_states", "hidden_slides",
        "gifs", "videos", "audio", "external_media", "media_bytes", "noted_slides", "notes_chars", "error",
    )


def audit(parts: DataFrame, available: DataFrame) -> DataFrame:
    """TV10: deck records with their duplicates, by path. Records are settled, so packages are opened once, whatever is asked of them."""
    return with_duplicates(settled(deck_records(parts, available))).orderBy("path")


def summary(decks: DataFrame) -> DataFrame:
    """One row over deck records. Missing faces are a table of their own (``missing_faces``), as long as there are faces."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    with_media = (F.col("gifs") > 0) | (F.col("videos") > 0) | (F.col("audio") > 0) | (F.size("external_media") > 0)
    numbers = decks.agg(
        F.count("*").alias("decks"), total("slides").alias("slides"), total("bytes").alias("bytes"), F.count_if(F.col("error").isNotNull()).alias("unreadable"),
        F.count_if(F.size("fonts_missing") > 0).alias("font_risk_decks"), F.count_if(F.size("fonts_embedded") > 0).alias("decks_embedding_fonts"),
        F.count_if(F.col("animated_slides") > 0).alias("animated_decks"), total("animated_slides").alias("animated_slides"), total("hidden_slides").alias("hidden_slides"),
        F.count_if(F.col("hidden_slides") > 0).alias("decks_with_hidden"), total("build_states").alias("build_states"), F.count_if(with_media).alias("decks_with_media"),
        total("gifs").alias("animated_gifs"), total("videos").alias("videos"), total(F.size("external_media")).alias("external_media"), total("noted_slides").alias("noted_slides"),
        total("notes_chars").alias("notes_chars"), F.count_if(F.col("bytes") >= text.OVERSIZED_BYTES).alias("oversized_decks"), F.lit(text.OVERSIZED_BYTES).cast("long").alias("oversized_bytes_threshold"),
    )
    # Two results of one row each.
    return numbers.join(F.broadcast(redundant_copies(decks)), F.lit(True))


def inventory(slides: DataFrame) -> DataFrame:
    """A1, A4, A6 over ``slides(deck, hidden, note)``: ``deck, slides, hidden_slides, noted_slides, notes_chars``."""
    chars = F.length(F.coalesce("note", F.lit("")))
    return slides.groupBy("deck").agg(F.count("*").alias("slides"), F.count_if("hidden").alias("hidden_slides"), F.count_if(chars > 0).alias("noted_slides"), F.sum(chars).cast("long").alias("notes_chars"))


def with_position(slides: DataFrame, order: str) -> DataFrame:
    return slides.withColumn("slide_no", F.row_number().over(Window.partitionBy("deck").orderBy(order)))
