"""Mixing sources to target weights by weighted fair queueing.

Every document gets a virtual finish time: the words its source has handed out up to and
including it, in shuffled order, divided by the source's target. All copies are then sorted
by finish time and cut at the total budget. A source whose target exceeds its size is
handed out again, up to ``most`` times.

Both running sums are taken over range-sorted rows so that no task sees a whole source or the whole
mix: rows are partitioned by ranges of the whole order (ties included, so no value makes a range large), the sums of ranges
are a small table, and each range adds its offset to a window of its own rows. There are as many ranges as shuffle partitions. The mix is
cut where the total comes nearest to the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import store, table, word_count


def running_sum(rows: DataFrame, size: str, order: list[str | Column], name: str, within: str | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``size`` over all rows up to this one in ``order``, or over those with one value of the column ``within``,
    by which ``order`` must begin. The range-sorted rows are stored, as ranges are drawn from a sample and would differ from run to run."""
    ranged = store(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), f"{name}-ranges")
    keys = [within] if within else []
    sums = ranged.groupBy(*keys, "range").agg(F.sum(size).alias("words"))
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = sums.select(F.col("range").alias("of_range"), *(F.col(k).alias("of") for k in keys), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    same = F.col("range") == F.col("of_range")
    met = ranged.join(offsets, same & F.col(within).eqNullSafe(F.col("of")) if within else same).drop("of_range", "of")
    inside = Window.partitionBy(*keys, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumn(name, F.sum(size).over(inside) + F.col("offset")).drop("range", "offset")


def shuffle_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")))


def source_targets(sizes: DataFrame, most: int, share: float = 1.0) -> DataFrame:
    """``source, source_size, target``: weights 1, 2, 3, repeating over the sources by code point (null last).

    Targets share the total by weight; none exceeds ``most`` times its source's size, and what
    is over goes to the others by weight. That fixed point is the water level L at which
    sum(min(weight * L, cap)) is the total: sources reach their caps in order of cap / weight,
    so the level follows from two running sums over one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    filled = Window.orderBy("full_at", "position")
    everything = Window.partitionBy()
    t = by_source.withColumn("position", F.row_number().over(order) - 1).withColumn("weight", (F.col("position") % 3 + 1).cast("double"))
    t = t.withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("full_at", F.col("cap") / F.col("weight"))
    t = t.withColumn("total", F.sum("source_size").over(everything) * F.lit(share)).withColumn("weights", F.sum("weight").over(everything))
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("weights_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The level if exactly the sources before this one were full; it falls once the first source isn't.
    t = t.withColumn("level", (F.col("total") - F.col("caps_before")) / (F.col("weights") - F.col("weights_before")))
    t = t.withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("weight") * F.col("level"), F.col("cap")))
    return t.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, most: int = 3, share: float = 1.0) -> DataFrame:
    """``doc_id, size, source, source_size, target, copies, taken`` for every row of ``docs``.

    Null texts have size 0 and are taken 0 words; a null source is a source of its own, last in
    order; rows with a null or repeated doc_id are rows like any other (they tie, so the shuffle
    orders them by size; equal rows are interchangeable). An empty table gives no rows, a source
    without words the target 0. ``copies`` counts how often the mix takes the document.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"))
    rows = store(rows.withColumn("key", shuffle_key(F.col("doc_id"), seed)), "mix-sizes")
    targets = store(source_targets(rows, most, share), "mix-targets")
    placed = running_sum(rows, "size", [F.col("source").isNull(), "source", "key", "doc_id", "size"], "given", "source").drop("key")
    placed = store(placed.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of"), "mix-placed")

    # Copy e of a document has finished when its source has served e * source_size + given words.
    copies = placed.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    copies = copies.select("source", "doc_id", "size", "target", (F.col("copy") * F.col("source_size") + F.col("given")).alias("served"))
    copies = copies.select("source", "doc_id", "size", "served", F.try_divide(F.col("served").cast("double"), F.col("target")).alias("finish"))
    budget = int(targets.agg(F.sum("source_size")).first()[0] or 0) * share
    ordered = running_sum(copies, "size", ["finish", F.col("source").isNull(), "source", "doc_id", "size", "served"], "used")
    # The copy that crosses the budget stays if that brings the total nearer to it.
    upto = ordered.where(F.col("used") * 2 - F.col("size") <= F.lit(2 * budget)).groupBy("source").agg(F.max("served").alias("upto"))
    # Within a source copies are taken in the order in which it serves them, so one number a source tells them all.
    upto = upto.withColumnRenamed("source", "of")
    out = placed.join(upto, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    taken = sum((F.when(F.lit(e) * F.col("source_size") + F.col("given") <= F.col("upto"), 1).otherwise(0) for e in range(1, most)), F.when(F.col("given") <= F.col("upto"), 1).otherwise(0))
    out = out.withColumn("copies", F.when(F.col("size") > 0, taken).otherwise(0).cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", "taken")


def apply_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, most: int = 3, share: float = 1.0) -> DataFrame:
    """The mix itself: every row of ``docs``, all columns, as often as ``mix`` takes it.

    Rows that tie in id, source and size are told apart by their order: equal rows are
    interchangeable, and so are equal sizes for the sums.
    """
    own = ["id", "source", "size"]
    place = F.row_number().over(Window.partitionBy(*own).orderBy("copies"))
    counts = mix(docs, doc_id, text, source, seed, most, share).where("copies > 0").select(F.col("doc_id").alias("id"), "source", "size", "copies").withColumn("place", place)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(doc_id).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"))
    whole = whole.withColumn("place", F.row_number().over(Window.partitionBy(*own).orderBy(F.col(f"row.`{text}`"))))
    a, b = whole.alias("a"), counts.alias("b")
    met = a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")) & F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size")) & (F.col("a.place") == F.col("b.place")))
    return met.select("a.row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("b.copies")))).select("row.*")


def op7_wfq_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def oracle_sql(docs: str = "documents", seed: int = 7, most: int = 3) -> str:
    """DuckDB SQL for ``mix``: the same sums by plain windows over whole sources and the whole mix."""
    return rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':{seed}') AS key FROM {docs}),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight,
    (source_size * {most})::DOUBLE AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS position FROM sources),
filled AS (
  SELECT *, cap / weight AS full_at, (sum(source_size) OVER ())::DOUBLE AS total, sum(weight) OVER () AS weights,
    coalesce(sum(cap) OVER before, 0) AS caps_before, coalesce(sum(weight) OVER before, 0) AS weights_before
  FROM weighed WINDOW before AS (ORDER BY cap / weight, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (total - caps_before) / (weights - weights_before) AS own FROM filled),
targets AS (
  SELECT source, source_size, cap, weight, (SELECT max(own) FROM levels WHERE own <= full_at) AS level FROM levels),
placed AS (
  SELECT s.doc_id, s.size, s.source, t.source_size, CASE WHEN level IS NULL THEN cap ELSE least(weight * level, cap) END AS target,
    (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS FIRST, s.size ROWS UNBOUNDED PRECEDING))::BIGINT AS given
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, (copy * source_size + given)::DOUBLE / target AS finish
  FROM placed, (SELECT unnest(range({most})) AS copy) WHERE size > 0),
running AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, doc_id NULLS FIRST, size, copy ROWS UNBOUNDED PRECEDING) AS used
  FROM copies),
taken AS (
  SELECT doc_id, source, size, given, sum(size)::BIGINT AS taken FROM running
  WHERE 2 * used - size <= 2 * (SELECT sum(size) FROM sized) GROUP BY ALL)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM placed p LEFT JOIN taken t ON p.doc_id IS NOT DISTINCT FROM t.doc_id AND p.source IS NOT DISTINCT FROM t.source
  AND p.size = t.size AND p.given = t.given
"""


OP7_SQL = oracle_sql()
