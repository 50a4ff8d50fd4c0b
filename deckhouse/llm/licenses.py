"""Canonical licence digests: whole texts, normalised, hash-joined to known licences.

DataFrame functions only. The same column expression normalises both sides.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_texts import LICENSE_DIGESTS, LICENSES

#: Spellings taken as equal, anywhere in a word (fixed values).
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authoris", "authoriz"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalis", "capitaliz"),
    ("catalogue", "catalog"), ("categoris", "categoriz"), ("centre", "center"), ("emphasis", "emphasiz"),
    ("favour", "favor"), ("fulfill", "fulfil"), ("initialis", "initializ"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("maximis", "maximiz"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimis", "optimiz"),
    ("organis", "organiz"), ("practise", "practice"), ("programme", "program"), ("realis", "realiz"),
    ("recognis", "recogniz"), ("signalling", "signaling"), ("sub license", "sublicense"), ("utilis", "utiliz"),
    ("whilst", "while"), ("wilfull", "wilful"), ("non commercial", "noncommercial"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"), ("https", "http"),
]

#: A line that claims a copyright (not one that merely begins with the word, as wrapped text may); goes with its line feed.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright[ \t]+(\(c\)|©|[0-9]{4}|by[ \t])|\(c\)[ \t]+(copyright|[0-9]{4})|©|all rights reserved)[^\n]*"
NO_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Case, copyright lines, punctuation and white space, then spellings; null is empty."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, COPYRIGHT_LINE, ""), NO_WORD, " "))
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, plain)


def known_digests(known: DataFrame, license_id: str = "license_id", text: str = "text", digests: DataFrame | None = None) -> DataFrame:
    """``digest, license_id``, one row a digest (the first id by code point); empty texts name no licence. ``digests(license_id, digest)`` adds licences of
    which only the digest of the canonical text is kept."""
    rows = known.select(F.col(license_id).alias("license_id"), canonical(F.col(text)).alias("canonical")).where("canonical <> '' and license_id is not null")
    rows = rows.select("license_id", F.sha2("canonical", 256).alias("digest"))
    if digests is not None:
        rows = rows.unionByName(digests.select("license_id", "digest").where("digest is not null and license_id is not null"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text", digests: DataFrame | None = None) -> DataFrame:
    """``doc_id, canonical_chars, digest, license_id`` for every document.

    ``license_id`` is null where the whole canonical text is no known licence. Null and empty texts
    have the digest of nothing and no licence; repeated rows and null ids are kept. An empty
    ``known`` leaves every licence null. Only named columns are read. Spark broadcasts the known
    digests if its own size estimate allows and shuffles by digest if not.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), canonical(F.col(text)).alias("canonical"))
    rows = rows.select("doc_id", F.length("canonical").cast("long").alias("canonical_chars"), F.sha2("canonical", 256).alias("digest"))
    return rows.join(known_digests(known, digests=digests), "digest", "left").select("doc_id", "canonical_chars", "digest", "license_id")


class Catalogue(NamedTuple):
    """Known licences: short ones by their texts, long ones by digests."""

    texts: DataFrame
    digests: DataFrame


def catalogue(spark: SparkSession) -> Catalogue:
    texts = spark.createDataFrame(list(LICENSES.items()), "license_id string, text string")
    return Catalogue(texts, spark.createDataFrame([(n, d) for n, all_ in LICENSE_DIGESTS.items() for d in all_], "license_id string, digest string"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = catalogue(spark)
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"), known.texts, digests=known.digests)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql() -> str:
    plain = f"trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), {_quoted(COPYRIGHT_LINE)}, '', 'g'), {_quoted(NO_WORD)}, ' ', 'g'), ' ')"
    spelt = reduce(lambda x, pair: f"replace({x}, {_quoted(pair[0])}, {_quoted(pair[1])})", SPELLINGS, plain)
    known = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in LICENSES.items())
    whole = ", ".join(f"({_quoted(k)}, {_quoted(d)})" for k, all_ in LICENSE_DIGESTS.items() for d in all_)
    return f"""
WITH known AS (SELECT * FROM (VALUES {known}) AS t(license_id, text)),
digests AS (
  SELECT digest, min(license_id) AS license_id
  FROM (SELECT license_id, sha256(c) AS digest FROM (SELECT license_id, {spelt} AS c FROM known) WHERE c <> '' UNION ALL SELECT * FROM (VALUES {whole}) AS w(license_id, digest)) GROUP BY 1),
docs AS (SELECT doc_id, {spelt} AS c FROM documents)
SELECT doc_id, length(c)::BIGINT AS canonical_chars, sha256(c) AS digest, license_id
FROM docs LEFT JOIN digests ON digests.digest = sha256(c)
"""


OP3_SQL = oracle_sql()
