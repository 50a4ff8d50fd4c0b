"""Queries d59 and d60: slide lists that drop entries, and builds by paragraph, over the virtual library, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import builds, lineage
from . import synthetic
from .queries import VSLIDE, query, vslide


def _joined(*c: str | Column) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in c))


def _paragraph(text: str | Column) -> Column:
    return _joined("<a:p><a:r><a:t>", text, "</a:t></a:r></a:p>")


def _each(n: Column, body) -> Column:
    """``body(i)`` for every i from 0 to n - 1, one after the other."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: body(i.cast("string"))), "")).otherwise("")


_HEAD, _TAIL = synthetic.slide([synthetic.shape(3, "Body", "@")]).split("<a:p><a:r><a:t>@</a:t></a:r></a:p>")
_SHUT = synthetic.slide([synthetic.shape(3, "Body", "@")], hidden=True).split("<a:p>")[0]


def built_slide(n: Column, hidden: Column, shape: Column) -> Column:
    """A slide whose body (shape 3) has n paragraphs p0, p1, ..., each with a click that lets it enter in ``shape``."""
    click = lambda i: F.replace(F.replace(F.lit(synthetic.click("@", paragraphs=("#", "#"))), F.lit("@"), shape), F.lit("#"), i)
    timing = F.when(n > 0, _joined("<p:timing>", _each(n, click), "</p:timing>")).otherwise("")
    return _joined(F.when(hidden, _SHUT).otherwise(_HEAD), _each(n, lambda i: _paragraph(_joined("p", i))), _TAIL.replace("</p:sld>", ""), timing, "</p:sld>")


def vlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deck for each conversation whose list names every slide: of slide numbers, those = 5 (mod 6) not self-closing, = 8 (mod 9) without a relationship, = 0
    (mod 4) by an absolute target, = 3 (mod 7) without a part. Clicks of slides with an even number of lines aim at a shape that isn't there."""
    slides = vslide(spark, sf_dir)
    i, n = F.col("slide_no"), F.col("slide_no").cast("string")
    entry = _joined('<p:sldId id="', (i + 255).cast("string"), '" r:id="rId', n, F.when(i % 6 == 5, '"></p:sldId>').otherwise('"/>'))
    rel = F.when(i % 9 == 8, "").otherwise(_joined('<Relationship Id="rId', n, '" Target="', F.when(i % 4 == 0, "/ppt/slides/slide").otherwise("slides/slide"), n, '.xml"/>'))
    in_order = lambda c: F.array_join(F.array_sort(F.collect_list(F.struct("slide_no", c.alias("x"))))["x"], "")
    decks = slides.groupBy("deck").agg(_joined("<p:presentation><p:sldIdLst>", in_order(entry), "</p:sldIdLst></p:presentation>").alias("list"), _joined("<Relationships>", in_order(rel), "</Relationships>").alias("rels"))
    frame = F.array(*(F.struct(F.lit(name).alias("part"), F.col(c).alias("x")) for name, c in (("ppt/presentation.xml", "list"), ("ppt/_rels/presentation.xml.rels", "rels"))))
    markup = built_slide(F.col("n_steps"), F.col("hidden"), F.when(F.col("n_lines") % 2 == 0, "4").otherwise("3"))
    parts = decks.select("deck", F.explode(frame).alias("p")).select("deck", "p.*").union(slides.where(i % 7 != 3).select("deck", _joined("ppt/slides/slide", n, ".xml"), markup))
    return parts.select(F.col("deck").cast("string").alias("path"), "part", F.col("x").cast("binary").alias("content"))


@query("d59_slide_lineage", VSLIDE + """,
fate AS (
  SELECT *, CASE WHEN slide_no % 6 = 5 THEN 'unclosed' WHEN slide_no % 9 = 8 THEN 'unrelated' WHEN slide_no % 4 = 0 THEN 'elsewhere' WHEN slide_no % 7 = 3 THEN 'missing' ELSE 'kept' END AS fate,
    CASE WHEN slide_no % 7 = 3 THEN 0 ELSE n_steps END AS clicks FROM vslide)
SELECT deck::VARCHAR AS deck, count(*) AS entries, count(*) FILTER (fate = 'kept') AS kept, count(*) FILTER (fate = 'unclosed') AS unclosed, count(*) FILTER (fate = 'unrelated') AS unrelated,
  count(*) FILTER (fate = 'elsewhere') AS elsewhere, count(*) FILTER (fate = 'missing') AS missing, count(*) FILTER (fate <> 'kept' AND slide_no % 7 <> 3) AS unlisted, sum(clicks)::BIGINT AS forecast,
  coalesce(sum(clicks) FILTER (fate = 'kept' AND NOT hidden AND n_lines % 2 = 1), 0)::BIGINT AS extra_pages, coalesce(sum(clicks) FILTER (fate = 'kept' AND hidden), 0)::BIGINT AS on_hidden,
  coalesce(sum(clicks) FILTER (fate <> 'kept'), 0)::BIGINT AS on_unlisted, coalesce(sum(clicks) FILTER (fate = 'kept' AND NOT hidden AND n_lines % 2 = 0), 0)::BIGINT AS collapsed
FROM fate GROUP BY deck""")  # fmt: skip
def d59(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1, Q12: why there are fewer pages than the forecast says."""
    return lineage.slide_lineage(vlisted(spark, sf_dir))


@query("d60_paragraph_states", VSLIDE + f""",
states AS (SELECT deck, slide_no, unnest(range(n_steps + 1)) AS state FROM vslide WHERE n_steps > 0)
SELECT deck, slide_no::BIGINT AS slide_no, state::BIGINT AS state, sha256('{_HEAD}' ||
  CASE WHEN state = 0 THEN '<a:p/>' ELSE array_to_string(list_transform(range(state), lambda i: '<a:p><a:r><a:t>p' || i || '</a:t></a:r></a:p>'), '') END || '{_TAIL}') AS xml_sha256 FROM states""")  # fmt: skip
def d60(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that enter one by one; a body that has none left keeps an empty one."""
    slides = vslide(spark, sf_dir).where("n_steps > 0")
    markup = built_slide(F.col("n_steps"), F.lit(False), F.lit("3")).cast("binary")
    cut = slides.select("deck", F.col("slide_no").cast("long").alias("slide_no"), F.posexplode(builds.slide_states(markup)).alias("state", "xml"))
    return cut.select("deck", "slide_no", F.col("state").cast("long").alias("state"), F.sha2("xml", 256).alias("xml_sha256"))
