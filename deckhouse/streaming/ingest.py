"""Incremental ingest of a growing library: each run takes what has come since the last and then stops.

An extra of this engine: file-source Structured Streaming with ``Trigger.AvailableNow`` and a checkpoint, so a
rerun resumes where the last one ended. (The file source leaves out names starting ``_`` or ``.``; the batch
source ``sources.decks`` doesn't.)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

BINARY_FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def new_decks(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """``path, modificationTime, length, content`` of decks as a stream; lock files are left out."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][pP][tT][xX]").option("maxFilesPerTrigger", str(files_per_batch)).load(folder)
    return files.where(~F.regexp_extract("path", "([^/]*)$", 1).startswith("~$"))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df.drop("content")) -> StreamingQuery:
    """Append ``transform`` of the decks that have come to parquet files in ``out``; ends when all are in."""
    return transform(new_decks(spark, folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deck_status(decks: DataFrame) -> DataFrame:
    """S7 on a stream of whole decks: ``path, length, status, faults``."""
    from ..operators.builds import deck_faults

    faults = deck_faults("content")
    return decks.select("path", "length", faults.alias("faults")).withColumn("status", F.when(F.exists("faults", lambda f: f["rule"].isin("V1", "V8")), "unreadable").otherwise("ok"))
