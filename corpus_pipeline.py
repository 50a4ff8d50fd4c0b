"""A corpus pipeline of four operators: toxic documents go, near-duplicates go, sources are mixed to
their target weights, and what is left is packed into sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deckhouse.llm import minmax, mixing, packing, toxicity
from deckhouse.llm.common import store, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones among them, doesn't reject. Null and empty texts stay."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic", "quality")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates. Texts without words, and rows without an id, are in no group and stay."""
    return minmax.drop_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times. Texts without words have size 0 and are taken no time."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document (each copy for itself) in sequences of 4096 tokens. A null or empty text is its end
    token alone; an empty table gives no rows."""
    return packing.pack(packing.tokenize(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't fit the toxicity model or tokenize; tests/llm compares run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next. A null id is packed as such; an empty table gives
    no rows. What the stages stored stays until ``deckhouse.llm.common.release`` (the last stage is read when the caller writes)."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
