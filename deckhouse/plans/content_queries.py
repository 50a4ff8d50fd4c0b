"""Queries d56 to d58: decks by content, over packages made from the documents (a slide for each line), with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import content
from .queries import _read, query

_BEFORE, _AFTER, _FRAME = "<p:sld><p:cSld><a:t>", "</a:t></p:cSld></p:sld>", "<p:presentation/>"


def vpackages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a package for every document: a slide for each line of its text (none without a text) and a presentation."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text").where("doc_id is not null").select(F.concat(F.lit("/lib/"), F.col("doc_id").cast("string"), F.lit(".pptx")).alias("path"), F.split("text", "\n").alias("lines"))
    slide = lambda line, i: F.struct(F.concat(F.lit("ppt/slides/slide"), (i + 1).cast("string"), F.lit(".xml")).alias("part"), F.concat(F.lit(_BEFORE), line, F.lit(_AFTER)).cast("binary").alias("content"))
    frame = F.array(F.struct(F.lit("ppt/presentation.xml").alias("part"), F.lit(_FRAME).cast("binary").alias("content")))
    return docs.select("path", F.explode(F.concat(frame, F.coalesce(F.transform("lines", slide), F.array().cast("array<struct<part:string,content:binary>>")))).alias("p")).select("path", "p.*")


VSLIDES = """
WITH doc AS (SELECT '/lib/' || doc_id || '.pptx' AS path, text FROM documents WHERE doc_id IS NOT NULL),
line AS (SELECT path, text, i, string_split(text, chr(10))[i] AS line FROM (SELECT path, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM doc)),
slide AS (SELECT DISTINCT path AS deck, line FROM line)"""


@query("d56_content_duplicates", VSLIDES + f""",
member AS (
  SELECT path, sha256(sha256('ppt/slides/slide' || i || '.xml') || sha256('{_BEFORE}' || line || '{_AFTER}')) AS m FROM line
  UNION ALL SELECT path, sha256(sha256('ppt/presentation.xml') || sha256('{_FRAME}')) FROM doc),
package AS (SELECT path, sha256(string_agg(m, chr(10) ORDER BY m)) AS digest, count(*) AS parts FROM member GROUP BY path)
SELECT path, digest, parts, CASE WHEN path <> min(path) OVER (PARTITION BY digest) THEN min(path) OVER (PARTITION BY digest) END AS same_as, count(*) OVER (PARTITION BY digest) AS copies FROM package""")  # fmt: skip
def d56(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q15: equal packages by content."""
    return content.duplicates_by_content(content.package_digests(vpackages(spark, sf_dir)))


@query("d57_slide_origins", VSLIDES + """
SELECT s.deck, f.first AS origin, count(*) AS shared FROM slide s JOIN (SELECT line, min(deck) AS first FROM slide GROUP BY line) f ON f.line = s.line WHERE f.first <> s.deck GROUP BY ALL""")  # fmt: skip
def d57(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which decks slides were taken from."""
    return content.slide_origins(content.slide_digests(vpackages(spark, sf_dir)))


@query("d58_contained_decks", VSLIDES + """,
deck AS (SELECT deck, list_sort(list(line)) AS lines FROM slide GROUP BY deck),
class AS (SELECT lines, min(deck) AS first, count(*) AS alike FROM deck GROUP BY lines),
posting AS (SELECT first, unnest(lines) AS line FROM class),
rarest AS (SELECT p.first, min({'n': f.n, 'line': p.line}) AS r FROM posting p JOIN (SELECT line, count(*) AS n FROM posting GROUP BY line) f ON f.line = p.line GROUP BY p.first),
held AS (
  SELECT a.first, count(*) AS containers, min(b.first) AS container
  FROM rarest JOIN posting p ON p.line = rarest.r.line JOIN class a ON a.first = rarest.first JOIN class b ON b.first = p.first
  WHERE len(b.lines) > len(a.lines) AND list_has_all(b.lines, a.lines) GROUP BY a.first)
SELECT d.deck, len(d.lines)::BIGINT AS slides, c.alike, coalesce(h.containers, 0)::BIGINT AS containers, h.container FROM deck d JOIN class c ON c.lines = d.lines LEFT JOIN held h ON h.first = c.first""")  # fmt: skip
def d58(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decks whose slides are all in another one."""
    return content.contained_decks(content.slide_digests(vpackages(spark, sf_dir)))
