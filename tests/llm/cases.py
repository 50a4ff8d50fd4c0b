"""Rows that every operator must take: nulls, empty, blank and very long texts, ties, repeats, clashing columns."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

A = "the quick brown fox jumps over the lazy dog and runs away from the old red barn before noon today"
B = "a completely different text about shipping containers that cross the northern sea each winter with heavy loads of timber"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))

ROWS = [
    (1, A, "web"), (2, A, "web"), (3, A + " again", "news"), (4, B, None), (5, None, "news"), (6, "", "web"), (7, " \t\n ", "web"),
    (8, LONG, "books"), (9, LONG + " tail", "books"), (10, "one", "web"), (11, "One", "web"), (12, "Ünïcödé Ωmega straße 你好 🙂", "news"),
    (None, A, "web"), (None, None, None), (4, B, None), (13, "x\x00y\x1fz\u00a0w", "web"),
]
#: Names that operators use inside or return.
CLASHING = ["key", "rep", "size", "label", "node", "digest", "keys", "copies", "target", "source_size", "sequence_id", "offset", "piece", "length", "of", "a", "b", "u", "v", "row", "place", "given", "gone_id", "again_id", "p_toxic", "part", "block"]
SCHEMA = "doc_id long, text string, source string"


def docs(spark: SparkSession, rows=ROWS) -> DataFrame:
    df = spark.createDataFrame(rows, SCHEMA) if rows else spark.createDataFrame([], SCHEMA)
    return df.withColumns({c: F.lit(c) for c in CLASHING})
