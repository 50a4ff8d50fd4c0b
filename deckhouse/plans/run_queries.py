"""Queries d62 to d66: reports of runs and of archives, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import export, fonts, library, render, sinks
from .package_queries import d50
from .queries import SQL, VDECK, VPAGES, _long, _read, query, vdeck, vpages


@query("d62_run_report", f"""
WITH t AS ({SQL["d27_run_outcomes"]}),
n AS (SELECT user_id, count(*) AS decks FROM events GROUP BY user_id)
SELECT t.user_id, exported, skipped, failed, processed, decks - processed AS shortfall, CASE WHEN failed > 0 OR decks > processed THEN 1 ELSE 0 END::INT AS exit_code
FROM t JOIN n ON n.user_id = t.user_id""")  # fmt: skip
def d62(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18, A22, section 2.15: each user's events are a run, which three failures in a row stop; what it never reached, and its exit code."""
    rows = _read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type").where("user_id is not null")
    kind = F.col("event_type")
    outcomes = rows.withColumn("status", F.when(kind.isin("error", "click"), "fail").when(kind == "view", "skip").otherwise("ok"))
    totals = export.run_totals(export.reached(outcomes, ["user_id"], ["ts", "event_id"]), ["user_id"], outcomes.groupBy("user_id").agg(F.count("*").alias("decks")))
    return export.exit_code(totals)


@query("d63_stripped_decks", f"SELECT path FROM ({SQL['d50_recovery']}) WHERE recovery = 'fonts stripped'")
def d63(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decks of d50's attempts that went out without their embedded fonts."""
    return sinks.substitution_report(d50(spark, sf_dir))


@query("d64_own_faces_excluded", """
WITH l AS (SELECT p_partkey AS number, CASE WHEN p_partkey % 5 = 1 THEN 'Fam' || chr((97 + p_partkey % 26)::INT) END AS named, CASE WHEN p_partkey % 5 > 1 THEN 'Face ' || (p_partkey % 300) END AS full_name FROM part),
f AS (SELECT number, last_value(named IGNORE NULLS) OVER (ORDER BY number ROWS UNBOUNDED PRECEDING) AS family, coalesce(named, full_name) AS face FROM l WHERE named IS NOT NULL OR full_name IS NOT NULL),
k AS (SELECT *, regexp_replace(lower(face), '[^a-z0-9]', '', 'g') AS key FROM f WHERE family IS NOT NULL),
mine AS (SELECT 'face' || (p_partkey % 300) AS key FROM part WHERE p_partkey % 9 = 2 UNION SELECT 'fam' || chr((97 + p_partkey % 26)::INT) FROM part WHERE p_partkey % 13 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY number) AS r FROM k WHERE key NOT IN (SELECT key FROM mine) AND lower(family) NOT IN (SELECT key FROM mine))
SELECT key, family, face FROM r WHERE r = 1""")  # fmt: skip
def d64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """d49's listing without our own substitutes, by face or family; a key's next face counts where its first one is ours."""
    parts, key = _read(spark, sf_dir, "part", "p_partkey"), F.col("p_partkey")
    family, face = F.concat(F.lit("Fam"), F.char(97 + key % 26)), F.concat(F.lit("Face "), (key % 300).cast("string"))
    line = F.when(key % 5 == 1, F.concat(F.lit("Family: "), family)).when(key % 5 == 0, "Version: 1").otherwise(F.concat(F.lit("  Full Name: "), face))
    mine = parts.where("p_partkey % 9 = 2").select(text.plain_key(face).alias("key")).union(parts.where("p_partkey % 13 = 1").select(text.plain_key(family)))
    return fonts.installed_faces(parts.select(key.alias("number"), line.alias("line")), mine)


@query("d65_unreadable_first", VDECK + " SELECT path, 'BadZipFile: deck ' || doc_id AS error FROM vdeck WHERE doc_id % 11 = 0 ORDER BY path LIMIT 5")
def d65(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: the first decks that can't be read."""
    error = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("BadZipFile: deck "), F.col("doc_id").cast("string")))
    return library.unreadable(vdeck(spark, sf_dir).withColumn("error", error)).select("path", "error")


@query("d66_deck_yields", VPAGES + """,
media AS (SELECT conv_id AS deck, count(DISTINCT turn % 4) FILTER (turn % 4 <> 0) AS media FROM conversations GROUP BY conv_id)
SELECT m.deck, coalesce(p.pages, 0)::BIGINT AS pages, coalesce(p.images, 0)::BIGINT AS images, m.media::BIGINT AS media
FROM media m LEFT JOIN (SELECT deck, count(*) AS pages, count(*) FILTER (deck % 3 <> 0 AND page = 2) AS images FROM vpages GROUP BY deck) p ON p.deck = m.deck
WHERE p.pages > 0 OR m.media > 0""")  # fmt: skip
def d66(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, images and media files of every deck. Every third deck has its images, and of the others the second page is asked for."""
    found = vpages(spark, sf_dir)
    folder = F.concat(F.lit("/out/"), F.col("deck").cast("string"), F.lit(" (export)"))
    pdfs = found.select("deck").distinct().select("deck", folder.alias("dir"))
    there = pdfs.select(F.concat("dir", F.lit("/images/01."), F.when(F.col("deck") % 3 == 0, "png").otherwise("jpg")).alias("path"))
    images = render.only_page(found.join(render.render_plan(pdfs, there), "deck"), 2)
    place = F.col("turn") % 4
    media = _read(spark, sf_dir, "conversations", "conv_id", "turn").select(F.col("conv_id").alias("deck"), F.when(place == 0, "media.json").otherwise(F.concat(F.lit("m"), place.cast("string"))).alias("file")).distinct()
    return _long(export.deck_yields(found, images, media), "pages", "images", "media")
