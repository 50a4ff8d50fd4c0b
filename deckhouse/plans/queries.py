"""Queries d01 to d35: the operators over a virtual library built from the driver's tables, with DuckDB SQL.

The tables hold no decks, so decks, slides, effects, faces and files are derived from their values, in the same way
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import glyphs, text, xml
from ..functions.binary import gif_frame_count
from ..functions.faces import noise_reason
from ..functions.rows import by_rows
from ..operators import builds, export, fonts, library, media, notes, pages
from . import synthetic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# ---------------------------------------------------------------- slides

VSLIDE = """
WITH vslide AS (
  SELECT conv_id AS deck, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS slide_no, role, text, turn,
    role = 'system' AS hidden, len(string_split(text, chr(10))) AS n_lines,
    CASE WHEN role = 'assistant' THEN len(string_split(text, chr(10))) ELSE 0 END AS n_steps
  FROM conversations)"""

VPAGES = (
    VSLIDE
    + """,
states AS (SELECT deck, slide_no, n_steps + 1 AS n, unnest(range(n_steps + 1)) AS k FROM vslide WHERE NOT hidden),
vpages AS (
  SELECT deck, row_number() OVER (PARTITION BY deck ORDER BY slide_no, k)::BIGINT AS page, slide_no::BIGINT AS slide,
    CASE WHEN n > 1 THEN k END::BIGINT AS state, CASE WHEN n > 1 THEN n END::BIGINT AS "of"
  FROM states)"""
)


def vslide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").withColumnRenamed("conv_id", "deck")
    lines = F.size(F.split("text", "\n"))
    numbered = pages.slide_positions(rows, order="turn")
    return numbered.withColumns({"hidden": F.col("role") == "system", "n_lines": lines, "n_steps": F.when(F.col("role") == "assistant", lines).otherwise(0)})


def vpages(spark: SparkSession, sf_dir: str) -> DataFrame:
    slides = vslide(spark, sf_dir)
    expanded = slides.where("n_steps > 0").select("deck", "slide_no", (F.col("n_steps") + 1).alias("n_states"))
    return pages.page_map(slides.select("deck", "slide_no", "hidden"), expanded)


@query("d01_page_map", VPAGES + " SELECT * FROM vpages")
def d01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(vpages(spark, sf_dir), "page", "slide", "state", "of")


@query("d02_page_of", VSLIDE + " SELECT deck, slide_no::BIGINT AS slide_no, row_number() OVER (PARTITION BY deck ORDER BY slide_no)::BIGINT AS page FROM vslide WHERE NOT hidden")
def d02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(pages.page_of(vslide(spark, sf_dir)), "slide_no", "page")


@query("d03_page_notes", VPAGES + """
SELECT p.deck, p.page, CASE WHEN p.state IS NULL THEN v.text ELSE '[build ' || p.state || ' of ' || (p."of" - 1) || ']' || chr(10) || v.text END AS text
FROM vpages p JOIN vslide v ON v.deck = p.deck AND v.slide_no = p.slide WHERE v.text <> ''""")  # fmt: skip
def d03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(pages.page_notes(vpages(spark, sf_dir), vslide(spark, sf_dir).select("deck", "slide_no", "text")), "page")


@query("d04_labels", VPAGES + """,
wide AS (SELECT *, greatest(2, length(max(slide) OVER (PARTITION BY deck)::VARCHAR)) AS w, greatest(2, length(max(coalesce("of", 1)) OVER (PARTITION BY deck)::VARCHAR)) AS sw FROM vpages)
SELECT deck, page, lpad(slide::VARCHAR, w::INT, '0') || CASE WHEN state IS NULL THEN '' ELSE '.' || lpad((state + 1)::VARCHAR, sw::INT, '0') END AS label FROM wide""")  # fmt: skip
def d04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(pages.labels(vpages(spark, sf_dir)), "page")


@query("d05_library_inventory", """
SELECT conv_id AS deck, count(*) AS slides, count(*) FILTER (role = 'system') AS hidden_slides,
  count(*) FILTER (role = 'user' AND length(text) > 0) AS noted_slides, sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END)::BIGINT AS notes_chars
FROM conversations GROUP BY conv_id""")  # fmt: skip
def d05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.inventory(vslide(spark, sf_dir).withColumn("note", F.when(F.col("role") == "user", F.col("text"))))


# ---------------------------------------------------------------- decks

VDECK = """
WITH vdeck AS (
  SELECT doc_id, source || '/' || lpad(doc_id::VARCHAR, 8, '0') AS path, strlen(text)::BIGINT AS bytes, len(string_split(text, chr(10)))::INT AS slides
  FROM documents)"""


def vdeck(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "source", "text")
    path = F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    return docs.select("doc_id", path.alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.size(F.split("text", "\n")).alias("slides"))


@query("d06_library_summary", VDECK + f""",
records AS (
  SELECT *, doc_id % 3 AS hidden, CASE WHEN doc_id % 5 = 0 THEN doc_id % 7 ELSE 0 END AS animated, doc_id % 4 = 0 AS missing, doc_id % 6 = 0 AS embeds,
    doc_id % 11 = 0 AS bad, doc_id % 2 AS gifs, doc_id % 9 = 0 AS linked FROM vdeck),
copies AS (SELECT coalesce(sum(n - 1), 0)::BIGINT AS n FROM (SELECT count(*) AS n FROM vdeck GROUP BY bytes, slides))
SELECT count(*) AS decks, sum(slides)::BIGINT AS slides, sum(bytes)::BIGINT AS bytes, count(*) FILTER (bad) AS unreadable, count(*) FILTER (missing) AS font_risk_decks,
  count(*) FILTER (embeds) AS decks_embedding_fonts, count(*) FILTER (animated > 0) AS animated_decks, sum(animated)::BIGINT AS animated_slides, sum(hidden)::BIGINT AS hidden_slides,
  count(*) FILTER (hidden > 0) AS decks_with_hidden, sum(2 * animated)::BIGINT AS build_states, count(*) FILTER (gifs > 0 OR linked) AS decks_with_media, sum(gifs)::BIGINT AS animated_gifs,
  0::BIGINT AS videos, count(*) FILTER (linked) AS external_media, 0::BIGINT AS noted_slides, 0::BIGINT AS notes_chars, count(*) FILTER (bytes >= {text.OVERSIZED_BYTES}) AS oversized_decks,
  {text.OVERSIZED_BYTES}::BIGINT AS oversized_bytes_threshold, max((SELECT n FROM copies)) AS redundant_copies
FROM records""")  # fmt: skip
def d06(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    some = lambda c, kind, *values: F.when(c, F.array(*values)).otherwise(F.array().cast(kind))
    records = vdeck(spark, sf_dir).withColumns({
        "hidden_slides": i % 3, "animated_slides": F.when(i % 5 == 0, i % 7).otherwise(0), "fonts_missing": some(i % 4 == 0, "array<string>", F.lit("Graphik")),
        "fonts_embedded": some(i % 6 == 0, "array<string>", F.lit("Inter")), "error": F.when(i % 11 == 0, "BadZipFile"), "gifs": i % 2, "videos": F.lit(0), "audio": F.lit(0),
        "external_media": some(i % 9 == 0, "array<struct<slide:int,url:string>>", F.struct(F.lit(1).alias("slide"), F.lit("u").alias("url"))), "noted_slides": F.lit(0), "notes_chars": F.lit(0),
    }).withColumn("build_states", 2 * F.col("animated_slides"))
    return library.summary(records)


@query("d07_duplicates", VDECK + """,
g AS (SELECT bytes, slides, min(path) AS first, count(*) AS n FROM vdeck GROUP BY bytes, slides)
SELECT v.path, v.bytes, v.slides, CASE WHEN n > 1 AND first <> v.path THEN first END AS duplicate_of, n AS duplicate_group_size FROM vdeck v JOIN g ON g.bytes = v.bytes AND g.slides = v.slides""")  # fmt: skip
def d07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.with_duplicates(vdeck(spark, sf_dir).drop("doc_id"))


@query("d08_oversized_topk", VDECK + " SELECT path, bytes FROM vdeck WHERE bytes >= 10000 ORDER BY bytes DESC, path LIMIT 5")
def d08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.oversized(vdeck(spark, sf_dir).select("path", "bytes"), 10_000)


# ---------------------------------------------------------------- links and media

_VREL = """
WITH vrel AS (
  SELECT page_id % 20 AS deck, page_id AS slide,
    '<Relationship Id="rId1" TargetMode="External" Target="' || replace(CASE page_id % 5 WHEN 0 THEN 'https://www.youtube.com/watch?v=' || page_id WHEN 1 THEN url || '/clip.mp4' ELSE url END, '&', '&amp;') || '"/>' AS xml
  FROM pages),
targets AS (SELECT deck, slide, replace(regexp_extract(xml, 'Target="([^"]+)"', 1), '&amp;', '&') AS url FROM vrel),
ext AS (SELECT *, regexp_extract(lower(url), '^(?:.*/)?\\.*[^/.][^/]*?(\\.[^./]*)$', 1) AS e FROM targets)"""


def vrel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "pages", "page_id", "url")
    i = F.col("page_id")
    url = F.when(i % 5 == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), i.cast("string"))).when(i % 5 == 1, F.concat("url", F.lit("/clip.mp4"))).otherwise(F.col("url"))
    tag = F.concat(F.lit('<Relationship Id="rId1" TargetMode="External" Target="'), F.replace(url, F.lit("&"), F.lit("&amp;")), F.lit('"/>'))
    return rows.select((i % 20).alias("deck"), i.alias("slide"), tag.alias("xml"))


_EXTENSIONS = ", ".join(f"'{e}'" for e in text.VIDEO + text.AUDIO)


@query("d09_external_links", _VREL + f" SELECT deck, slide, url FROM ext WHERE e IN ({_EXTENSIONS}) OR regexp_matches(lower(url), 'youtube|youtu\\.be|vimeo|wistia|loom|\\.mp4|\\.mov')")
def d09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.external_links(vrel(spark, sf_dir))


@query("d10_link_kinds", _VREL + f"""
SELECT CASE WHEN e IN ({", ".join(f"'{x}'" for x in text.STILLS)}) THEN NULL WHEN e IN ({", ".join(f"'{x}'" for x in text.VIDEO)}) THEN 'video' WHEN e IN ({", ".join(f"'{x}'" for x in text.AUDIO)}) THEN 'audio'
  WHEN e = '.gif' THEN 'animated-gif' WHEN e = '.svg' THEN NULL ELSE 'other' END AS kind, count(*) AS items FROM ext GROUP BY 1""")  # fmt: skip
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = vrel(spark, sf_dir).select(F.explode(xml.external_targets(F.col("xml"))).alias("url"))
    return media.kind_summary(links.select(media.media_kind(text.extension(F.col("url")), F.lit(None).cast("int")).alias("kind")))


@query("d11_media_usage", """
WITH vmedia AS (SELECT DISTINCT conv_id % 10 AS deck, 'm' || ((conv_id * 7 + turn) % 40) AS file, turn::INT AS slide FROM conversations),
files AS (SELECT unnest(range(10)) AS deck, i AS n FROM (SELECT unnest(range(50)) AS i)),
used AS (SELECT deck, file, count(*) AS n_slides, min(slide) AS first, max(slide) AS last FROM vmedia GROUP BY 1, 2)
SELECT f.deck::BIGINT AS deck, 'm' || f.n AS file, coalesce(n_slides, 0)::BIGINT AS n_slides, first::INT AS first, last::INT AS last,
  'deck-' || CASE WHEN first IS NULL THEN 'unplaced' ELSE 'slide' || lpad(first::VARCHAR, 3, '0') END || '-m' || f.n AS name
FROM files f LEFT JOIN used u ON u.deck = f.deck AND u.file = 'm' || f.n""")  # fmt: skip
def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations", "conv_id", "turn")
    uses = rows.select((F.col("conv_id") % 10).alias("deck"), F.concat(F.lit("m"), ((F.col("conv_id") * 7 + F.col("turn")) % 40).cast("string")).alias("file"), F.col("turn").cast("int").alias("slide"))
    files = spark.range(10).select(F.col("id").alias("deck"), F.explode(F.sequence(F.lit(0), F.lit(49))).alias("n")).select("deck", F.concat(F.lit("m"), F.col("n").cast("string")).alias("file"))
    used = media.media_usage(files, uses)
    edge = lambda f: F.when(F.size("slides") > 0, f("slides"))
    return used.select("deck", "file", F.size("slides").cast("long").alias("n_slides"), edge(F.array_min).alias("first"), edge(F.array_max).alias("last"), media.media_name(F.lit("deck"), F.col("slides"), F.col("file")).alias("name"))


# ---------------------------------------------------------------- packages

@query("d12_slide_order", VSLIDE + """
SELECT deck, row_number() OVER (PARTITION BY deck ORDER BY slide_no DESC)::BIGINT AS slide_no, 'ppt/slides/slide' || slide_no || '.xml' AS part
FROM vslide WHERE slide_no % 4 <> 0""")  # fmt: skip
def d12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list runs backwards; every fourth slide has an absolute target, which names no slide (Q12)."""
    n = F.col("slide_no").cast("string")
    entry = F.concat(F.lit('<p:sldId id="'), (F.col("slide_no") + 255).cast("string"), F.lit('" r:id="rId'), n, F.lit('"/>'))
    target = F.concat(F.when(F.col("slide_no") % 4 == 0, "/ppt/slides/slide").otherwise("slides/slide"), n, F.lit(".xml"))
    tag = F.concat(F.lit('<Relationship Id="rId'), n, F.lit('" Target="'), target, F.lit('"/>'))
    backwards = lambda c: F.array_join(F.reverse(F.array_sort(F.collect_list(F.struct("slide_no", c.alias("x"))))["x"]), "")
    decks = vslide(spark, sf_dir).groupBy("deck").agg(F.concat(F.lit("<p:sldIdLst>"), backwards(entry), F.lit("</p:sldIdLst>")).alias("presentation"), backwards(tag).alias("rels"))
    listed = F.array(*(F.struct(F.lit(name).alias("part"), F.col(column).alias("x")) for name, column in (("ppt/presentation.xml", "presentation"), ("ppt/_rels/presentation.xml.rels", "rels"))))
    parts = decks.select("deck", F.explode(listed).alias("p")).select("deck", "p.*")
    slides = vslide(spark, sf_dir).select("deck", F.concat(F.lit("ppt/slides/slide"), n, F.lit(".xml")).alias("part"), F.lit("<p:sld/>").alias("x"))
    parts = parts.union(slides).select(F.col("deck").alias("path"), "part", F.col("x").cast("binary").alias("content"))
    return _long(notes.presentation_slides(parts).select("deck", "slide_no", "part"), "slide_no")


def _sld(c: Column) -> Column:
    return F.concat(F.lit("<p:sld a='1'"), F.when(c == "system", ' show="0">').when(c == "user", '><p:sld b="2" show="0"/>').otherwise(' show="false">'), F.lit("</p:sld>"))


@query("d13_hidden", """
WITH x AS (SELECT conv_id, turn, '<p:sld a=''1''' || CASE role WHEN 'system' THEN ' show="0">' WHEN 'user' THEN '><p:sld b="2" show="0"/>' ELSE ' show="false">' END || '</p:sld>' AS x FROM conversations)
SELECT conv_id, turn, contains(regexp_extract(x, '<p:sld\\b[^>]*>'), 'show="0"') AS in_root, regexp_matches(x, '<p:sld\\b[^>]*\\sshow="0"') AS anywhere FROM x""")  # fmt: skip
def d13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations", "conv_id", "turn", "role").withColumn("x", _sld(F.col("role")))
    return rows.select("conv_id", "turn", xml.hidden_in_root(F.col("x")).alias("in_root"), xml.hidden_anywhere(F.col("x")).alias("anywhere"))


_VEFFECT = """
WITH veffect AS (
  SELECT user_id AS deck, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, CASE WHEN event_type = 'error' THEN 'exit' ELSE 'entr' END AS kind,
    event_id % 7 AS shape, CASE WHEN event_id % 5 = 0 THEN event_id % 3 END AS paragraph
  FROM events WHERE event_type IN ('signup', 'view', 'error'))"""


@query("d14_hide_sets", _VEFFECT + """,
last AS (SELECT deck, max(step) AS last FROM veffect GROUP BY deck),
keyed AS (SELECT deck, shape, paragraph, max(step) FILTER (kind = 'entr') AS enters, min(step) FILTER (kind = 'exit') AS leaves FROM veffect GROUP BY ALL),
hidden AS (
  SELECT k.deck, s.state, k.shape, k.paragraph FROM keyed k JOIN (SELECT deck, unnest(range(last + 1)) AS state FROM last) s ON s.deck = k.deck
  WHERE k.enters > s.state OR k.leaves <= s.state)
SELECT deck, state::BIGINT AS state, shape FROM hidden GROUP BY deck, state, shape HAVING count(paragraph) = 0""")  # fmt: skip
def d14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type").where("event_type in ('signup', 'view', 'error')")
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    effects = rows.select(F.col("user_id").alias("deck"), step.alias("step"), F.when(F.col("event_type") == "error", "exit").otherwise("entr").alias("kind"), (F.col("event_id") % 7).alias("shape"), F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 3).alias("paragraph"))
    return _long(builds.hide_sets(effects), "state")


@query("d15_distinct_states", """
WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY k) AS before FROM s)
SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY k)::BIGINT - 1 AS k FROM l WHERE k = 1 OR event_type IS DISTINCT FROM before""")  # fmt: skip
def d15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    states = rows.select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("k"))
    return _long(builds.distinct_states(states, ["user_id"], body="event_type"), "k")


# ---------------------------------------------------------------- fonts

_SUFFIX = "|".join(text.STYLE_SUFFIXES)
VFACE = f"""
WITH vface AS (
  SELECT p_partkey, p_partkey % 50 AS deck, p_name, CASE WHEN p_partkey % 11 = 0 THEN CASE (p_partkey // 11) % 4 WHEN 0 THEN 'serif' WHEN 1 THEN 'a\\b' WHEN 2 THEN 'ab' ELSE '12345' END
    ELSE p_name || CASE p_size % 4 WHEN 1 THEN ' Bold' WHEN 2 THEN ' Light' WHEN 3 THEN ' Std' ELSE '' END END AS face FROM part),
keyed AS (SELECT *, regexp_replace(lower(regexp_replace(regexp_replace(face, '\\.(ttf|otf|ttc|dfont)$', '', 'i'), '[-_ ]?({_SUFFIX})$', '')), '[^a-z0-9]', '', 'g') AS face_key, regexp_replace(lower(face), '[^a-z0-9]', '', 'g') AS plain_key FROM vface)"""


def vface(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    noise = F.element_at(F.array(*(F.lit(x) for x in ("serif", "a\\b", "ab", "12345"))), (F.floor(F.col("p_partkey") / 11) % 4 + 1).cast("int"))
    suffix = F.element_at(F.array(*(F.lit(x) for x in ("", " Bold", " Light", " Std"))), F.col("p_size") % 4 + 1)
    return rows.select("p_partkey", (F.col("p_partkey") % 50).alias("deck"), "p_name", F.when(F.col("p_partkey") % 11 == 0, noise).otherwise(F.concat("p_name", suffix)).alias("face"))


@query("d16_norm_names", VFACE + " SELECT p_partkey, face_key, plain_key FROM keyed")
def d16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vface(spark, sf_dir).select("p_partkey", text.face_key(F.col("face")).alias("face_key"), text.plain_key(F.col("face")).alias("plain_key"))


@query("d17_missing_faces", VFACE + """,
have AS (SELECT face_key AS k FROM keyed WHERE p_partkey % 16 = 0 UNION SELECT plain_key FROM keyed WHERE p_partkey % 16 = 0),
missed AS (SELECT DISTINCT deck, face FROM keyed WHERE face_key NOT IN (SELECT k FROM have) AND plain_key NOT IN (SELECT k FROM have))
SELECT face, count(*) AS decks FROM missed GROUP BY face""")  # fmt: skip
def d17(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = vface(spark, sf_dir)
    some = faces.where("p_partkey % 16 = 0")
    have = some.select(F.explode(F.array(text.face_key(F.col("face")), text.plain_key(F.col("face")))).alias("key"))
    missed = library.face_misses(faces.select("deck", "face").distinct(), have)
    return library.missing_faces(missed.groupBy(F.col("deck").alias("path")).agg(F.array_sort(F.collect_list("face")).alias("fonts_missing")))


@query("d18_alias_first_match", VFACE + """,
names AS (SELECT DISTINCT face, p_name FROM vface),
candidates AS (
  SELECT face, 1 AS tier, 0 AS ord, face AS name FROM names UNION ALL SELECT face, 2, 0, p_name FROM names
  UNION ALL SELECT face, 2, 1, split_part(p_name, ' ', 1) FROM names UNION ALL SELECT face, 4, 0, split_part(p_name, ' ', 2) FROM names),
catalogue AS (
  SELECT 1 AS tier, face AS name, 'system' AS kind FROM vface WHERE p_partkey % 29 = 0 UNION SELECT 2, p_name, 'system' FROM vface WHERE p_partkey % 31 = 0
  UNION SELECT 2, split_part(p_name, ' ', 1), 'system' FROM vface WHERE p_partkey % 97 = 0 UNION SELECT 4, split_part(p_name, ' ', 2), 'office' FROM vface WHERE p_partkey % 23 = 0),
keyed_c AS (SELECT tier, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key, min(name) AS target, min(kind) AS kind FROM catalogue GROUP BY 1, 2),
met AS (
  SELECT c.face, k.target, k.kind, row_number() OVER (PARTITION BY c.face ORDER BY c.tier, c.ord, k.target) AS r
  FROM candidates c JOIN keyed_c k ON k.tier = c.tier AND k.key = regexp_replace(lower(c.name), '[^a-z0-9]', '', 'g'))
SELECT face, target, kind FROM met WHERE r = 1""")  # fmt: skip
def d18(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = vface(spark, sf_dir)
    word = lambda n: F.split_part(F.col("p_name"), F.lit(" "), F.lit(n))
    named = lambda tier, order, name: F.struct(F.lit(tier).alias("tier"), F.lit(order).alias("ord"), text.plain_key(name).alias("key"))
    # Noise faces belong to many parts, so a face can have several names to try.
    candidates = faces.select("face", "p_name").distinct().select("face", F.explode(F.array(named(1, 0, F.col("face")), named(2, 0, F.col("p_name")), named(2, 1, word(1)), named(4, 0, word(2)))).alias("c")).select("face", "c.*")
    rows = [(1, F.col("face"), "system", 29), (2, F.col("p_name"), "system", 31), (2, word(1), "system", 97), (4, word(2), "office", 23)]
    some = [faces.where(F.col("p_partkey") % m == 0).select(F.lit(t).alias("tier"), n.alias("name"), F.lit(k).alias("kind")) for t, n, k, m in rows]
    catalogue = some[0].union(some[1]).union(some[2]).union(some[3]).groupBy("tier", text.plain_key(F.col("name")).alias("key")).agg(F.min("name").alias("target"), F.min("kind").alias("kind"))
    return fonts.first_match(candidates, catalogue)


@query("d19_group_families", """
WITH names AS (SELECT p_name AS family, p_partkey % 50 AS d FROM part UNION SELECT split_part(p_name, ' ', 1), p_partkey % 50 FROM part),
families AS (SELECT DISTINCT family FROM names),
roots AS (
  SELECT f.family, arg_min(r.family, length(r.family)) AS root FROM families f JOIN families r ON lower(f.family) = lower(r.family) OR starts_with(lower(f.family), lower(r.family) || ' ')
  GROUP BY f.family)
SELECT root AS family, count(DISTINCT n.family) AS n_faces, count(DISTINCT n.d) AS deck_count FROM names n JOIN roots r ON r.family = n.family GROUP BY root""")  # fmt: skip
def d19(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part", "p_partkey", "p_name")
    names = rows.select(F.explode(F.array(F.col("p_name"), F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("family"), (F.col("p_partkey") % 50).cast("string").alias("d"))
    substitutes = names.groupBy("family").agg(F.collect_set("d").alias("paths")).select(F.col("family").alias("face"), "family", F.lit("Regular").alias("style"), F.lit(400).alias("weight"), "paths")
    return _long(fonts.group_substitutes(substitutes).select("family", F.size("faces").alias("n_faces"), "deck_count"), "n_faces", "deck_count")


@query("d20_rank_candidates", """
WITH r AS (SELECT p_type, p_partkey, p_retailprice / (SELECT avg(p_retailprice) FROM part) AS ratio, p_brand LIKE '%1' AS in_genre FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY ratio > 1, NOT in_genre, CASE WHEN ratio <= 1 THEN -ratio ELSE ratio END, p_partkey) AS rank FROM r)
SELECT p_type, p_partkey, in_genre, rank FROM k WHERE rank <= 5""")  # fmt: skip
def d20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part", "p_partkey", "p_type", "p_brand", "p_retailprice")
    anchor = rows.agg(F.avg("p_retailprice").alias("anchor"))  # one row
    ranked = rows.join(F.broadcast(anchor), F.lit(True)).select("p_type", "p_partkey", (F.col("p_retailprice") / F.col("anchor")).alias("ratio"), F.col("p_brand").endswith("1").alias("in_genre"), F.col("p_partkey").alias("pool"))
    return _long(fonts.rank_candidates(ranked, ["p_type"]).where("rank <= 5").select("p_type", "p_partkey", "in_genre", "rank"), "rank")


@query("d21_char_width", """
WITH chars AS (SELECT item_id, unicode(unnest(string_split(text, ''))) AS c FROM benchmark)
SELECT item_id, (sum(200 + (c * 37) % 700)::DOUBLE / count(*)) * 1000.0 / 1000 AS width FROM chars WHERE c BETWEEN 32 AND 126 GROUP BY item_id""")  # fmt: skip
def d21(spark: SparkSession, sf_dir: str) -> DataFrame:
    glyphs = spark.range(32, 127).select(F.lit("virtual").alias("family"), F.col("id").cast("int").alias("codepoint"), (200 + (F.col("id") * 37) % 700).alias("advance"), F.lit(1000).alias("upm"))
    return fonts.mean_width(_read(spark, sf_dir, "benchmark", "item_id", "text"), glyphs, ["item_id"]).select("item_id", "width")


@query("d55_glyph_widths", """
WITH chars AS (SELECT unnest(range(32, 127)) AS codepoint)
SELECT 'Face ' || p_partkey AS family, codepoint::INT AS codepoint, (200 + (codepoint * p_partkey) % 700)::INT AS advance, (CASE p_partkey % 3 WHEN 1 THEN 2048 ELSE 1000 END)::INT AS upm
FROM part, chars WHERE (codepoint + p_partkey) % 7 <> 0""")  # fmt: skip
def d55(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths read from a font file for every part, in three formats of character map."""
    made = lambda key: synthetic.font(f"Face {key}", {c: 200 + c * key % 700 for c in range(32, 127) if (c + key) % 7}, 2048 if key % 3 == 1 else 1000, (4, 6, 12)[key % 3])

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["p_partkey"].astype(str), "content": batch["p_partkey"].map(made)})

    # A few bytes of keys become files of many rows, so keys are dealt to tasks first, whatever file of the table they lie in.
    keys = _read(spark, sf_dir, "part", "p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return glyphs.glyph_widths(keys.mapInPandas(files, "path string, content binary")).select("family", "codepoint", "advance", "upm")


@query("d22_text_budget", """
WITH t AS (SELECT source || '/' || lpad(doc_id::VARCHAR, 8, '0') AS path, length(text)::BIGINT AS chars FROM documents),
r AS (SELECT *, sum(chars) OVER (ORDER BY path) - chars AS before FROM t)
SELECT path, chars, before::BIGINT AS before FROM r WHERE before <= 200000""")  # fmt: skip
def d22(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "source", "text")
    return fonts.text_budget(docs.select(F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("path"), F.length("text").cast("long").alias("chars")))


@query("d23_noise", VFACE + """
SELECT p_partkey, face, CASE WHEN lower(trim(face)) = 'serif' THEN 'CSS keyword, not a font - pasted in from a web page' WHEN regexp_matches(face, '[\\\\/<>{}|]') THEN 'corrupted name - not a real face'
  WHEN length(trim(face)) < 3 THEN 'too short to be a face name' WHEN NOT regexp_matches(lower(face), '[a-z]') THEN 'no letters - not a face name' END AS reason FROM vface""")  # fmt: skip
def d23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vface(spark, sf_dir).select("p_partkey", "face", noise_reason(F.col("face")).alias("reason"))


# ---------------------------------------------------------------- export

VNAME = """
WITH vname AS (
  SELECT doc_id, 'deck' || (doc_id % 700) AS stem, (doc_id // 700)::VARCHAR AS folder, '/lib/' || source || '/' || (doc_id // 700) || '/deck' || (doc_id % 700) || '.pptx' AS path FROM documents),
planned AS (
  SELECT *, count(*) OVER (PARTITION BY stem) > 1 AS clash, '/out/' || stem || CASE WHEN count(*) OVER (PARTITION BY stem) > 1 THEN ' (' || folder || ')' ELSE '' END || ' (export)' AS dest FROM vname)"""


def vname(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "source")
    path = F.concat(F.lit("/lib/"), "source", F.lit("/"), F.floor(F.col("doc_id") / 700).cast("string"), F.lit("/deck"), (F.col("doc_id") % 700).cast("string"), F.lit(".pptx"))
    return docs.select("doc_id", path.alias("path"))


def vplan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.destinations(vname(spark, sf_dir).select("path"), "flat", "/lib", "/out/")


@query("d24_export_plan", VNAME + " SELECT path, dest, clash FROM planned")
def d24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vplan(spark, sf_dir).select("path", "dest", "clash")


@query("d25_keep_both", VNAME + """
SELECT path, dest || CASE WHEN doc_id % 3 <> 0 THEN '' WHEN doc_id % 6 = 0 THEN ' (3)' ELSE ' (2)' END AS dest, 'export' AS action FROM planned""")  # fmt: skip
def d25(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vplan(spark, sf_dir).join(vname(spark, sf_dir), "path")
    existing = rows.where("doc_id % 3 = 0").select("dest").union(rows.where("doc_id % 6 = 0").select(F.concat("dest", F.lit(" (2)"))))
    return export.resolve_conflicts(rows, existing, "new").select("path", "dest", "action")


@query("d26_resume", VNAME + """,
manifest AS (SELECT p.dest, CASE WHEN l.toxic = 1 THEN NULL WHEN l.quality = 1 THEN p.path ELSE '/elsewhere.pptx' END AS path FROM planned p JOIN labels l ON l.doc_id = p.doc_id)
SELECT path, dest FROM planned p WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.dest = p.dest AND (m.path IS NULL OR m.path = p.path))""")  # fmt: skip
def d26(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    planned = vplan(spark, sf_dir)
    writer = F.when(F.col("toxic") == 1, None).when(F.col("quality") == 1, F.col("path")).otherwise("/elsewhere.pptx")
    manifest = planned.join(vname(spark, sf_dir), "path").join(labels, "doc_id").select("dest", writer.alias("path"))
    return export.remaining(planned, manifest).select("path", "dest")


@query("d54_conflicts", VNAME + """,
store AS (
  SELECT p.*, d.source, l.doc_id IS NOT NULL AS there, l.doc_id IS NOT NULL AND l.toxic <> 1 AND l.quality <> 1 AS foreign_deck
  FROM planned p JOIN documents d ON d.doc_id = p.doc_id LEFT JOIN labels l ON l.doc_id = p.doc_id)
SELECT path, CASE WHEN NOT foreign_deck THEN dest ELSE '/out/' || stem || ' (' || CASE WHEN clash THEN source || '-' ELSE '' END || folder || ') (export)' END AS dest,
  CASE WHEN there AND NOT foreign_deck THEN 'skip' ELSE 'export' END AS action,
  CASE WHEN there AND NOT foreign_deck THEN 'already exported' WHEN clash OR foreign_deck THEN 'name clash' END AS reason FROM store""")  # fmt: skip
def d54(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dry run against a store in which labelled decks have folders: their own, ones that don't say whose they are, and ones of other decks."""
    labels = _read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    writer = F.when(F.col("toxic") == 1, None).when(F.col("quality") == 1, F.col("path")).otherwise("/elsewhere.pptx")
    decks = vname(spark, sf_dir)
    there = vplan(spark, sf_dir).join(decks, "path").join(labels, "doc_id").select("dest", writer.alias("path"))
    return export.export_plan(decks.select("path", F.lit("ok").alias("status")), "flat", "/lib", "/out/", "skip", there)


@query("d27_run_outcomes", """
WITH o AS (
  SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 'fail' WHEN 'click' THEN 'fail' WHEN 'view' THEN 'skip' ELSE 'ok' END AS status FROM events),
r AS (SELECT *, sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) OVER w AS run FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, CASE WHEN status = 'fail' THEN sum(CASE WHEN status = 'fail' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS n FROM r),
s AS (SELECT *, coalesce(max(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 3 AS stopped FROM f)
SELECT user_id, count(*) FILTER (status = 'ok') AS exported, count(*) FILTER (status = 'skip') AS skipped, count(*) FILTER (status = 'fail') AS failed, count(*) AS processed FROM s WHERE NOT stopped GROUP BY user_id""")  # fmt: skip
def d27(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    kind = F.col("event_type")
    outcomes = rows.withColumn("status", F.when(kind.isin("error", "click"), "fail").when(kind == "view", "skip").otherwise("ok"))
    return export.run_totals(export.reached(outcomes, ["user_id"], ["ts", "event_id"]), ["user_id"])


# ---------------------------------------------------------------- scalar functions

@query("d28_emu_aspect", """
WITH s AS (SELECT p_partkey, p_size * 12700 * CASE p_partkey % 3 WHEN 0 THEN 160 WHEN 1 THEN 40 ELSE 141 END AS cx, p_size * 12700 * CASE p_partkey % 3 WHEN 0 THEN 90 WHEN 1 THEN 30 ELSE 100 END AS cy FROM part)
SELECT p_partkey, round_even(cx / 9525, 0)::INT AS width_px, round_even(cy / 9525, 0)::INT AS height_px, CASE p_partkey % 3 WHEN 0 THEN '16:9' WHEN 1 THEN '4:3' ELSE 'A4' END AS aspect FROM s""")  # fmt: skip
def d28(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part", "p_partkey", "p_size")
    pick = lambda *n: F.element_at(F.array(*map(F.lit, n)), (F.col("p_partkey") % 3 + 1).cast("int"))
    side = lambda n: (F.col("p_size") * 12700 * n).cast("string")
    sized = rows.withColumn("xml", F.concat(F.lit('<p:sldSz cx="'), side(pick(160, 40, 141)), F.lit('" cy="'), side(pick(90, 30, 100)), F.lit('"/>')))
    sized = sized.withColumn("cx", xml.size_attribute(F.col("xml"), "cx")).withColumn("cy", xml.size_attribute(F.col("xml"), "cy"))
    return sized.select("p_partkey", text.pixels(F.col("cx")).alias("width_px"), text.pixels(F.col("cy")).alias("height_px"), text.named_ratio(F.col("cx") / F.col("cy")).alias("aspect"))


@query("d29_pdf_text", "SELECT n_nationkey, '<FEFF' || regexp_replace(hex(n_name), '(..)', '00\\1', 'g') || '>' AS pdf_text FROM nation")
def d29(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation", "n_nationkey", "n_name").select("n_nationkey", text.pdf_string(F.col("n_name")).alias("pdf_text"))


@query("d30_validator_sql", VSLIDE + """,
s AS (SELECT deck, slide_no AS n, 'ppt/slides/slide' || slide_no || '.xml' AS part FROM vslide),
e AS (SELECT deck, n, (256 + CASE WHEN n % 7 = 0 THEN n - 1 ELSE n END)::VARCHAR AS sld_id, 'rId' || n AS rid, CASE WHEN n % 6 = 0 THEN NULL ELSE 'slides/slide' || (CASE WHEN n % 8 = 5 THEN n + 100 ELSE n END) || '.xml' END AS target FROM s)
SELECT deck, 'V4' AS rule, part AS subject FROM s WHERE n % 5 = 0 UNION ALL SELECT deck, 'V5', part FROM s WHERE n % 5 <> 0 AND n % 3 = 0 UNION ALL SELECT deck, 'V7', part FROM s WHERE n % 4 = 0
UNION ALL SELECT deck, 'V9', sld_id FROM e GROUP BY deck, sld_id HAVING count(*) > 1 UNION ALL SELECT deck, 'V10', rid FROM e WHERE target IS NULL
UNION ALL SELECT e.deck, 'V11', rid FROM e WHERE target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.deck = e.deck AND s.part = 'ppt/' || e.target)""")  # fmt: skip
def d30(spark: SparkSession, sf_dir: str) -> DataFrame:
    slides = vslide(spark, sf_dir).select("deck", F.col("slide_no").alias("n"), F.concat(F.lit("ppt/slides/slide"), F.col("slide_no").cast("string"), F.lit(".xml")).alias("part"))
    n = F.col("n")
    bodies = slides.select("deck", "part", F.lit("<p:sld/>").alias("text"))
    rels = slides.where(n % 5 != 0).select("deck", F.concat(F.lit("ppt/slides/_rels/slide"), n.cast("string"), F.lit(".xml.rels")).alias("part"), F.when(n % 3 == 0, "<Relationships/>").otherwise('<Relationship Type="slideLayout"/>').alias("text"))
    listed = slides.groupBy("deck").agg(F.array_join(F.collect_list(F.when(n % 4 != 0, F.concat(F.lit('<Override PartName="/'), F.col("part"), F.lit('"/>')))), "").alias("text"))
    parts = bodies.union(rels).union(listed.select("deck", F.lit("[Content_Types].xml").alias("part"), "text"))
    target = F.when(n % 6 != 0, F.concat(F.lit("slides/slide"), F.when(n % 8 == 5, n + 100).otherwise(n).cast("string"), F.lit(".xml")))
    entries = slides.select("deck", n.alias("ordinal"), (256 + F.when(n % 7 == 0, n - 1).otherwise(n)).cast("string").alias("sld_id"), F.concat(F.lit("rId"), n.cast("string")).alias("rid"), target.alias("target"))
    return builds.structural_faults(parts, entries)


# ---------------------------------------------------------------- trees and bytes


@by_rows(T.BinaryType())
def _slide_xml(n: int) -> bytes:
    """A slide with a title and a shape for each line, which a click brings in."""
    return synthetic.slide([synthetic.shape(2, "Title", "t"), *(synthetic.shape(3 + i, f"s{i}", f"line {i}") for i in range(n))], [synthetic.click(3 + i) for i in range(n)]).encode()


@by_rows(T.BinaryType())
def _deck_bytes(counts: list[int]) -> bytes:
    """A deck with a slide for each number of clicks in a list."""
    return synthetic.deck([synthetic.slide([synthetic.shape(2, "Title", "t"), *(synthetic.shape(3 + i, "s", "x") for i in range(n))], [synthetic.click(3 + i) for i in range(n)]) for n in counts], extra={"ppt/fonts/font1.fntdata": b"font"})


_gif_bytes = by_rows(T.BinaryType())(synthetic.gif)
_pdf_bytes = by_rows(T.BinaryType())(synthetic.pdf)


@query("d31_click_steps", VSLIDE + """,
steps AS (SELECT deck, slide_no, unnest(range(1, n_steps + 1)) AS step FROM vslide)
SELECT deck, slide_no::BIGINT AS slide_no, step::BIGINT AS step, 'entr' AS kind, (step + 2)::VARCHAR AS spid, NULL::INT AS paragraph FROM steps""")  # fmt: skip
def d31(spark: SparkSession, sf_dir: str) -> DataFrame:
    slides = vslide(spark, sf_dir).select("deck", "slide_no", builds.click_effects(_slide_xml(F.col("n_steps"))).alias("effects"))
    return slides.select("deck", F.col("slide_no").cast("long"), F.explode("effects").alias("e")).select("deck", "slide_no", F.col("e.step").cast("long").alias("step"), "e.kind", "e.spid", "e.paragraph")


@query("d32_state_xml", VSLIDE + """,
s AS (SELECT deck, slide_no, unnest(range(n_steps + 1)) AS state FROM vslide WHERE n_steps > 0)
SELECT deck, slide_no::BIGINT AS slide_no, state::BIGINT AS state, (state + 1)::BIGINT AS shapes, false AS timed FROM s""")  # fmt: skip
def d32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state shows the title and the shapes that have come in, and has no timing."""
    slides = vslide(spark, sf_dir).where("n_steps > 0").select("deck", "slide_no", builds.slide_states(_slide_xml(F.col("n_steps"))).alias("states"))
    states = slides.select("deck", F.col("slide_no").cast("long"), F.posexplode("states").alias("state", "body")).withColumn("body", F.decode("body", "UTF-8"))
    return states.select("deck", "slide_no", F.col("state").cast("long").alias("state"), F.regexp_count("body", F.lit("<p:sp>")).cast("long").alias("shapes"), F.contains("body", F.lit("p:timing")).alias("timed"))


@query("d33_gif_frames", VSLIDE + " SELECT deck, slide_no::BIGINT AS slide_no, n_lines::INT AS frames FROM vslide")
def d33(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vslide(spark, sf_dir).select("deck", F.col("slide_no").cast("long"), gif_frame_count(_gif_bytes(F.col("n_lines"))).cast("int").alias("frames"))


@query("d34_package_roundtrip", VSLIDE + """
SELECT deck, (count(*) FILTER (n_steps > 0))::INT AS expanded, coalesce(sum(n_steps + 1) FILTER (n_steps > 0), 0)::INT AS pages, 0::INT AS faults, 1::INT AS fonts_removed FROM vslide GROUP BY deck""")  # fmt: skip
def d34(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.transform(F.array_sort(F.collect_list(F.struct("slide_no", "n_steps"))), lambda s: s["n_steps"])
    decks = vslide(spark, sf_dir).groupBy("deck").agg(steps.alias("steps")).select("deck", _deck_bytes(F.col("steps")).alias("content"))
    out = decks.select("deck", builds.expansion(F.col("content")).alias("x"), builds.without_fonts(F.col("content")).alias("f"))
    return out.select("deck", F.size("x.expanded").alias("expanded"), F.aggregate("x.expanded", F.lit(0), lambda n, s: n + s["pages"]).alias("pages"), F.size("x.faults").alias("faults"), F.col("f.removed").alias("fonts_removed"))


@query("d35_pdf_notes", VSLIDE + """
SELECT deck, max(slide_no)::INT AS pages, count(*)::INT AS added, true AS kept, NULL::VARCHAR AS error FROM vslide WHERE role = 'user' AND text IS NOT NULL GROUP BY deck""")  # fmt: skip
def d35(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = pages.notes_without_map(vslide(spark, sf_dir).where("role = 'user'").select("deck", "slide_no", "text"))
    by_deck = notes.groupBy("deck").agg(F.map_from_entries(F.collect_list(F.struct("page", "text"))).alias("notes"), F.max("page").alias("pages"))
    out = by_deck.select("deck", "pages", _pdf_bytes(F.col("pages")).alias("pdf"), "notes").select("deck", "pages", "pdf", builds.annotated(F.col("pdf"), F.col("notes")).alias("x"))
    kept = F.substring(F.col("x.pdf"), F.lit(1), F.octet_length("pdf")) == F.col("pdf")
    return out.select("deck", F.col("pages").cast("int").alias("pages"), F.col("x.added").cast("int").alias("added"), kept.alias("kept"), F.col("x.error").alias("error"))
