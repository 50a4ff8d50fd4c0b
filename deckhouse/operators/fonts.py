"""What to do about missing faces: noise, aliases, substitutes, groups and ranking.

Installed faces, Office faces and earlier substitutes are catalogues that come as tables. They are
joined by key; Spark broadcasts them while they are as small as such catalogues are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.faces import CANDIDATES, face_parts, genre_of, noise_reason, successor_of, weight_of
from ..functions.text import plain_key

#: A block of a listing has the lines whose numbers agree but for these bits.
BLOCK_BITS = 16


def installed_faces(lines: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """``key, family, face`` from ``lines(number, line)`` of a font listing; the first of a key counts.

    A family line names the faces after it. Families and faces in ``exclude(key)`` are left out. Lines are read in blocks of numbers; a block
    begins with the family that the blocks before it end with, so only those ends are ordered in one task.
    """
    said = F.trim(F.col("line"))
    family = F.when(said.startswith("Family: "), F.trim(F.substring(said, 9, 1 << 20)))
    full = F.when(said.startswith("Full Name: "), F.trim(F.substring(said, 12, 1 << 20)))
    rows = lines.withColumn("named", family).withColumn("full", full).where("named is not null or full is not null")
    rows = rows.withColumn("block", F.shiftright(F.col("number").cast("long"), BLOCK_BITS))
    ends = rows.groupBy("block").agg(F.max_by("named", F.when(F.col("named").isNotNull(), F.col("number"))).alias("end"))
    before = F.last("end", ignorenulls=True).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(ends.select("block", before.alias("before")), "block")
    rows = rows.withColumn("family", F.coalesce(F.last("named", ignorenulls=True).over(Window.partitionBy("block").orderBy("number")), "before"))
    rows = rows.select("number", "family", F.coalesce("named", "full").alias("face")).where("family <> '' and face <> ''")
    rows = rows.withColumn("key", plain_key(F.col("face"))).withColumn("family_key", plain_key(F.col("family")))
    if exclude is not None:
        for key in ("key", "family_key"):
            rows = rows.join(exclude.select(F.col("key").alias(key)).distinct(), key, "left_anti")
    return rows.groupBy("key").agg(F.min_by(F.struct("family", "face"), "number").alias("f")).select("key", "f.family", "f.face")


def office_faces(files: DataFrame) -> DataFrame:
    """``key, path`` of ``files(ordinal, path)``, the first file of a key."""
    fonts = files.where(F.rlike(F.lower("path"), F.lit(r"\.(ttf|otf|ttc)$")))
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "")
    return fonts.groupBy(plain_key(stem).alias("key")).agg(F.min_by("path", "ordinal").alias("path"))


def alias_candidates(faces: DataFrame) -> DataFrame:
    """``face, tier, ord, key`` of the names under which a face may be installed, most specific first.

    Tier 1 is the very name, 2 the parsed one, 3 the plain cut of an optical size, 4 the files of an office suite.
    """
    named = faces.select("face", face_parts(F.col("face")).alias("p")).select("face", "p.*")
    family, style, width = F.col("family"), F.coalesce("style", F.lit("Regular")), F.col("width")
    wanted = F.trim(F.concat_ws(" ", width, style))
    base = F.concat_ws(" ", family, width)
    spaced = lambda *c: F.concat_ws(" ", *c)
    dashed = lambda *c: F.concat_ws("-", *c)
    none = F.array().cast("array<string>")
    known = family != ""
    tiers = [
        F.array("face"),
        F.when(known, F.array(spaced(base, style), base, spaced(family, wanted), spaced(family, style))).otherwise(none),
        F.when(known & F.col("optical").isNotNull(), F.array(spaced(family, wanted), family)).otherwise(none),
        F.when(known, F.array(dashed(base, style), spaced(base, style), base, dashed(family, wanted), dashed(family, style), spaced(family, wanted), family)).otherwise(none),
    ]

    def keyed(tier: int):
        return lambda name, i: F.struct(F.lit(tier).alias("tier"), i.alias("ord"), plain_key(name).alias("key"))

    every = F.flatten(F.array(*(F.transform(names, keyed(n)) for n, names in enumerate(tiers, 1))))
    return named.select("face", F.explode(every).alias("c")).select("face", "c.tier", "c.ord", "c.key")


def first_match(candidates: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Of ``candidates(face, tier, ord, key)`` those in ``catalogue(tier, key, target, kind)``, the first by (tier, ord), then by target."""
    met = candidates.join(catalogue, ["tier", "key"])
    return met.groupBy("face").agg(F.min(F.struct("tier", "ord", "target", "kind")).alias("m")).select("face", F.col("m.target").alias("target"), F.col("m.kind").alias("kind"))


def face_plan(missing: DataFrame, system: DataFrame, office: DataFrame, ours: DataFrame) -> DataFrame:
    """TV11 (A12, J9, O10): ``face, verdict, detail, kind, family, style, weight, decks, paths`` from ``missing(path, face)``.

    The order is noise, an earlier substitute, an alias, a substitute.
    """
    faces = missing.groupBy("face").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    faces = faces.withColumn("decks", F.size("paths")).withColumn("noise", noise_reason(F.col("face"))).withColumn("key", plain_key(F.col("face")))
    mine = ours.groupBy("key").agg(F.min("source").alias("mine"))
    system_rows = system.select(F.explode(F.array(*(F.lit(t) for t in (1, 2, 3)))).alias("tier"), "key", F.col("face").alias("target"), F.lit("system").alias("kind"))
    office_rows = office.select(F.lit(4).alias("tier"), "key", F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "").alias("target"), F.lit("office").alias("kind"))
    wanted = faces.where("noise is null")
    hits = first_match(alias_candidates(wanted), system_rows.union(office_rows))
    parts = face_parts(F.col("face"))
    out = faces.join(mine, "key", "left").join(hits, "face", "left").withColumn("p", parts)
    substitute = F.col("noise").isNull() & F.col("mine").isNull() & F.col("target").isNull()
    style = F.when(substitute, F.coalesce(F.col("p.style"), F.lit("Regular")))
    return out.select(
        "face",
        F.when(F.col("noise").isNotNull(), "noise").when(substitute, "substitute").otherwise("alias").alias("verdict"),
        F.coalesce("noise", "mine", "target").alias("detail"),
        F.when(F.col("noise").isNotNull(), None).when(F.col("mine").isNotNull(), "installed").otherwise(F.col("kind")).alias("kind"),
        F.when(substitute, F.coalesce(F.nullif(F.col("p.family"), F.lit("")), F.col("face"))).alias("family"),
        style.alias("style"), F.when(substitute, weight_of(style)).alias("weight"), "decks", "paths",
    ).orderBy("face")


def fold_families(families: DataFrame) -> DataFrame:
    """``family, root``: the shortest family that is the family itself or a whole-word prefix of it.

    A prefix of whole words is one of a family's own few heads, so heads are exploded and met by key: an equi-join,
    not a comparison of all families with all.
    """
    words = F.split(F.lower("family"), " ")
    heads = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(words, 1, n), " ").alias("head")))
    known = families.groupBy(F.lower("family").alias("head")).agg(F.min("family").alias("root"))
    met = families.select("family", F.explode(heads).alias("h")).select("family", "h.n", "h.head").join(known, "head")
    return met.groupBy("family").agg(F.min_by("root", "n").alias("root"))


def group_substitutes(substitutes: DataFrame) -> DataFrame:
    """TV12 (A14, J12, O6, U6): ``family, faces, decks, deck_count`` from ``(face, family, style, weight, paths)``, most decks first.

    Spellings of one family are one group, under the shortest (then first by face); a named cut joins the family
    whose name is its prefix.
    """
    keyed = substitutes.withColumn("key", plain_key(F.col("family")))
    spelt = keyed.groupBy("key").agg(F.min_by("family", F.struct(F.length("family"), F.col("face"))).alias("shortest"), F.min("face").alias("first_face"))
    folded = fold_families(spelt.select(F.col("shortest").alias("family")))
    rows = keyed.join(spelt, "key").join(folded.withColumnRenamed("family", "shortest"), "shortest")
    groups = rows.groupBy("root").agg(
        F.array_sort(F.collect_list(F.struct("face", "style", "weight"))).alias("faces"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("paths")))).alias("decks"),
        F.min("first_face").alias("first_face"),
    )
    return groups.withColumn("deck_count", F.size("decks")).orderBy(F.desc("deck_count"), "first_face").select(F.col("root").alias("family"), "faces", "decks", "deck_count")


def mean_width(texts: DataFrame, glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean advance in thousandths of an em by ``keys``, of ``texts(..., text)`` by
    ``glyphs(family, codepoint, advance, upm)``; characters without a glyph count for nothing.

    Characters are counted before they meet the glyphs, so the join sees an alphabet, not a text.
    """
    char = F.explode(F.split("text", "")).alias("c")
    counted = texts.select(*keys, char).where("c <> ''").groupBy(*keys, F.expr("ascii(c)").alias("codepoint")).agg(F.count("*").alias("n"))
    met = counted.join(glyphs, "codepoint")
    return met.groupBy(*keys, "family").agg((F.sum(F.col("n") * F.col("advance")) / F.sum("n") * F.lit(1000.0) / F.max("upm")).alias("width"))


def rank_candidates(rows: DataFrame, partition: list[str]) -> DataFrame:
    """TV13, O4, O5: adds ``rank`` to ``rows(..., ratio, in_genre, pool)``. Whatever is wider than the face comes last,
    narrowest first; the rest by genre, then widest first; ties by place in the pool (the genre's own first)."""
    ratio, own = F.col("ratio"), F.col("in_genre")
    order = [ratio > 1, ~own, F.when(ratio <= 1, -ratio).otherwise(ratio), ~own, F.col("pool")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def recommend(groups: DataFrame, widths: DataFrame, anchor: float, chars: int = 0) -> DataFrame:
    """TV13, J10, K15: ``family, deck_count, pick, delta_pct, why, ranked``: a known successor, else the best of
    ``widths(candidate, width)`` against the anchor's width, measured on ``chars`` characters; ``ranked`` has the best five."""
    spark = groups.sparkSession
    pool = spark.createDataFrame([(n, g, i) for i, (n, g) in enumerate(CANDIDATES.items())], "candidate string, genre string, pool int")
    usable = pool.where("genre not in ('display', 'mono')").join(widths.where("width > 0").groupBy("candidate").agg(F.min("width").alias("width")), "candidate")  # F9; at most a row for each of CANDIDATES
    rows = groups.select("family", "deck_count", successor_of(F.col("family")).alias("successor"), genre_of(F.col("family")).alias("wanted"))
    measured = rows.where("successor is null").join(F.broadcast(usable), F.lit(True)).withColumn("ratio", F.col("width") / F.lit(anchor)).withColumn("in_genre", F.coalesce(F.col("genre") == F.col("wanted"), F.lit(False)))
    best = rank_candidates(measured, ["family"]).where("rank <= 5").groupBy("family").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate", "ratio", ((F.col("ratio") - 1) * 100).alias("delta_pct")))).alias("ranked"))
    joined = rows.join(best, "family", "left")
    top = F.try_element_at("ranked", F.lit(1))
    why = F.when(F.col("successor").isNotNull(), "the same design, free").when(F.col("ranked").isNotNull(), f"measured on {chars} characters from these decks").otherwise("no candidate could be measured")
    return joined.select("family", "deck_count", F.coalesce("successor", top["candidate"]).alias("pick"), F.when(F.col("successor").isNull(), top["delta_pct"]).alias("delta_pct"), why.alias("why"), "ranked").orderBy(F.desc("deck_count"), "family")


#: Text to measure where the decks have next to none of their own (fixed value).
SAMPLE_TEXT = (
    "The quick brown fox jumps over the lazy dog. Research Findings and Recommendations. Customer Journey Mapping. "
    "Key Takeaways for the Board. 0123456789 How might we improve onboarding conversion this quarter?"
)


def deck_texts(parts: DataFrame) -> DataFrame:
    """``path, text, chars`` of the text runs of each deck's slides, in part order, joined by a space."""
    slides = parts.where(F.col("part").startswith("ppt/slides/slide") & F.col("part").endswith(".xml"))
    runs = F.regexp_extract_all(F.decode("content", "UTF-8"), F.lit(r"(?s)<a:t>(.*?)</a:t>"), F.lit(1))
    found = slides.groupBy("path").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", runs.alias("runs")))), lambda s: s["runs"])).alias("runs"))
    chars = F.aggregate("runs", F.lit(0).cast("long"), lambda n, t: n + F.length(t))
    return found.select("path", F.array_join("runs", " ").alias("text"), chars.alias("chars"))


def sample_text(texts: DataFrame, limit: int = 200_000, by: list[str] | None = None) -> DataFrame:
    """One row with ``text`` (or one for each value of the columns ``by``): that of the decks within the budget, and SAMPLE_TEXT if it has
    200 characters or less. It is as long as the limit and the last deck, whatever the library's size."""
    by = by or []
    chosen = texts.join(text_budget(texts.select(*by, "path", "chars"), limit, by).select(*by, "path"), [*by, "path"])
    whole = chosen.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda d: d["text"]), " ").alias("t"))
    return whole.select(*by, F.when(F.length("t") > 200, F.col("t")).otherwise(F.concat_ws(" ", "t", F.lit(SAMPLE_TEXT))).alias("text"))


def recommend_measured(groups: DataFrame, texts: DataFrame, glyphs: DataFrame, anchor: str) -> DataFrame:
    """TV13, K15, P24, J11: as ``recommend``, with every group of ``groups(family, decks, deck_count)`` measured on the text of its own decks
    (``texts(path, text, chars)``, within the budget), by ``glyphs(family, codepoint, advance, upm)`` of the candidates and of the family ``anchor``.

    A group whose decks say nothing is measured on SAMPLE_TEXT; without widths of the anchor or of any candidate there is no pick.
    """
    rows = groups.select("family", "deck_count", successor_of(F.col("family")).alias("successor"), genre_of(F.col("family")).alias("wanted"))
    open_ = rows.where("successor IS NULL").select("family")
    of_groups = groups.join(open_, "family", "left_semi").select("family", F.explode("decks").alias("path")).join(texts, "path")
    said = open_.join(sample_text(of_groups, by=["family"]), "family", "left").select(F.col("family").alias("group"), F.coalesce("text", F.lit(" " + SAMPLE_TEXT)).alias("text"))
    widths = mean_width(said, glyphs, ["group"])
    by_anchor = widths.where(plain_key(F.col("family")) == plain_key(F.lit(anchor))).groupBy("group").agg(F.min("width").alias("anchor"))
    known = {plain: n for n in CANDIDATES for plain in ["".join(c for c in n.lower() if c.isalnum())]}
    pool = groups.sparkSession.createDataFrame([(plain, n, CANDIDATES[n], i) for i, (plain, n) in enumerate(known.items())], "key string, candidate string, genre string, pool int")
    usable = pool.where("genre NOT IN ('display', 'mono')")  # F9; at most a row for each of CANDIDATES
    found = widths.where("width > 0").withColumn("key", plain_key(F.col("family"))).groupBy("group", "key").agg(F.min("width").alias("width")).join(usable, "key")
    measured = found.join(by_anchor, "group").where("anchor > 0").join(rows.select(F.col("family").alias("group"), "wanted"), "group")
    measured = measured.withColumn("ratio", F.col("width") / F.col("anchor")).withColumn("in_genre", F.coalesce(F.col("genre") == F.col("wanted"), F.lit(False)))
    entry = F.struct("rank", "candidate", "ratio", ((F.col("ratio") - 1) * 100).alias("delta_pct"))
    best = rank_candidates(measured, ["group"]).where("rank <= 5").groupBy("group").agg(F.array_sort(F.collect_list(entry)).alias("ranked"))
    joined = rows.join(best, F.col("family") == F.col("group"), "left").drop("group").join(said.select("group", F.length("text").alias("chars")), F.col("family") == F.col("group"), "left")
    top = F.try_element_at("ranked", F.lit(1))
    why = F.when(F.col("successor").isNotNull(), "the same design, free").when(F.col("ranked").isNull(), "no candidate could be measured").otherwise(F.concat(F.lit("measured on "), F.col("chars").cast("string"), F.lit(" characters from these decks")))
    return joined.select("family", "deck_count", F.coalesce("successor", top["candidate"]).alias("pick"), F.when(F.col("successor").isNull(), top["delta_pct"]).alias("delta_pct"), why.alias("why"), "ranked").orderBy(F.desc("deck_count"), "family")


def group_label(family: Column, faces: Column, delta_pct: Column) -> Column:
    """A family with its number of further weights, and the width of its substitute in per cent."""
    more = F.size(faces) - 1
    weights = F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.when(more == 1, " weight").otherwise(" weights"))).otherwise("")
    width = F.when(delta_pct.isNotNull(), F.concat(F.lit("  "), F.format_string("%+.1f%% width", delta_pct))).otherwise("")
    return F.concat(family, weights, width)


#: Slices of the path order, and paths that their bounds are drawn from.
SLICES, DRAWN = 256, 4096


def text_budget(texts: DataFrame, limit: int = 200_000, by: list[str] | None = None) -> DataFrame:
    """Decks of ``texts(path, chars)`` in path order until the sum passes the limit, that deck included; with columns
    ``by`` for each of their values. An empty table gives none, a null number of characters counts as none.

    The path order is cut into slices of about as many decks each, at paths drawn by hash (so the slices are the same in every run, and even
    whatever the paths have in common). Slices are summed first: a task sees slice totals, or the rows of one slice, and slices past the limit are never sorted.
    """
    by = by or []
    drawn = texts.select("path").where("path IS NOT NULL").orderBy(F.xxhash64("path"), "path").limit(DRAWN).agg(F.array_sort(F.collect_list("path")).alias("drawn"))
    step = F.greatest(F.lit(1), F.floor(F.size("drawn") / SLICES).cast("int"))
    bounds = drawn.select(F.filter("drawn", lambda _, i: i % step == 0).alias("bounds"))  # one row, 2 * SLICES bounds at most
    cut = texts.select(*by, "path", F.coalesce("chars", F.lit(0)).alias("chars")).join(F.broadcast(bounds), F.lit(True))
    cut = cut.withColumn("slice", F.size(F.filter("bounds", lambda b: b <= F.col("path")))).drop("bounds")
    totals = cut.groupBy(*by, "slice").agg(F.sum("chars").alias("n"))
    before = totals.select(*by, "slice", (F.sum("n").over(Window.partitionBy(*by).orderBy("slice")) - F.col("n")).alias("offset")).where(F.col("offset") <= limit)
    inside = F.sum("chars").over(Window.partitionBy(*by, "slice").orderBy("path")) - F.col("chars")
    running: Column = inside + F.col("offset")
    return cut.join(before, [*by, "slice"]).withColumn("before", running).where(F.col("before") <= limit).select(*by, "path", "chars", F.col("before").cast("long").alias("before"))
