"""Query d61: the virtual library written as package files and audited from there. It writes files, so it has no SQL; tests hold it against d36."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators import library, sinks
from ..sources import decks
from .package_queries import vparts
from .queries import query


@F.pandas_udf(T.BinaryType())
def _zipped(packages: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def one(names: list[str], contents: list[bytes]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in zip(names, contents, strict=True):
                z.writestr(zipfile.ZipInfo(name), bytes(data), zipfile.ZIP_DEFLATED)
        return out.getvalue()

    for names, contents in packages:
        yield pd.Series([one(n, c) for n, c in zip(names, contents, strict=True)], dtype=object)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below spark.checkpoint.dir, which all executors share; only a local master may do without the setting."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="deckhouse-")
    return f"{re.sub('^file:/+', '/', where).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_library(spark: SparkSession, sf_dir: str) -> str:
    """The packages of ``vparts`` as files in sixteen folders; returns the library's folder. Of deck numbers, those = 9 (mod 10) are cut short; those = 7 are there
    once more under names that no library has: in a hidden folder, as a lock file, with another extension."""
    parts = vparts(spark, sf_dir).withColumn("content", F.coalesce("content", F.repeat(F.lit("v"), F.col("part_bytes").cast("int")).cast("binary")))
    members = F.array_sort(F.collect_list(F.struct("part", "content")))
    packages = parts.groupBy("name").agg(members.alias("m")).select("name", _zipped(F.col("m")["part"], F.col("m")["content"]).alias("content"))
    number = F.regexp_extract("name", r"(\d+)", 1).cast("long")
    packages = packages.withColumn("content", F.when(number % 10 == 9, F.substring(F.col("content"), F.lit(1), (F.octet_length("content") / 2).cast("int"))).otherwise(F.col("content")))
    under = lambda before, after="": F.concat(F.lit("g"), (number % 16).cast("string"), F.lit(f"/{before}"), "name", F.lit(after))
    places = F.when(number % 10 == 7, F.array(under(""), under(".hidden/"), under("~$"), under("", ".bak"))).otherwise(F.array(under("")))
    folder = new_folder(spark, "library")
    sinks.write_files(packages.select(F.explode(places).alias("file"), "content"), folder)
    return folder


@query("d61_source_audit")
def d61(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed, opened and audited from files."""
    parts = decks.read_parts(spark, write_library(spark, sf_dir), content=r"\.(xml|rels|gif)$")
    records = library.deck_records(parts, spark.createDataFrame([("helvetica",)], "key string"))
    flat = records.withColumn("links", F.size("external_media")).withColumns({c: F.array_join(c, ",") for c in ("fonts", "fonts_embedded", "fonts_missing")})
    below = F.concat(text.base_name(text.folder_name(F.col("path"))), F.lit("/"), "name")
    return flat.select(below.alias("path"), F.col("error").isNull().alias("readable"), *(c for c in flat.columns if c not in ("path", "name", "bytes", "media_bytes", "external_media", "error")))
