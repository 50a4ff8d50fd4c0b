"""Exact Hamming top-k by incremental multi-index hashing.

A 64-bit code is cut into m segments. Radius r is searched in segment 0, then 1, and so on; once
segment a is done at radius r, every code within distance m * r + a has been met, because a code
farther than that in no segment order could differ in that few bits. A query stops as soon as
its k-th verified distance is within that bound, so results are exact, ties included.

The stated query set meets all rows in blocks: codes are cut into shards of bounded size, each
with its own index, query blocks stream past every shard, and the shards' top-k are merged. A query first meets the
shard that its own code falls into; the k-th distance found there bounds what it asks the others for.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import store, table

BITS = 64


def sign_code(embedding: Column) -> Column:
    """64-bit code of a vector: bit i is set where element i is positive. Missing, null and NaN elements count as not positive; a null vector has no code. A vector of more than 64 elements is an error."""
    def bit(i: int) -> Column:
        x = F.try_element_at(embedding, F.lit(i + 1))
        return F.when((x > 0) & ~F.isnan(x), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))

    out = bit(0)
    for i in range(1, BITS):
        out = out.bitwiseOR(bit(i))
    too_long = F.raise_error(F.lit(f"a vector of more than {BITS} elements has no {BITS}-bit code")).cast("long")
    return F.when(F.size(embedding) > BITS, too_long).when(embedding.isNotNull(), out)


@lru_cache(maxsize=None)
def _masks(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with ``radius`` bits set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(width), radius)], np.int64)


class MultiIndex:
    """Index over distinct codes in a fixed order; ties in distance go to the earlier code."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes.astype(np.uint64)
        n = max(2, len(codes))
        self.m = min(16, max(2, round(BITS / log2(n)))) if n > 4 else 16
        edges = [round(i * BITS / self.m) for i in range(self.m + 1)]
        self.segments = [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]
        self.order, self.starts = [], []
        for lo, width in self.segments:
            key = self.part(self.codes, lo, width)
            order = np.argsort(key, kind="stable")
            self.order.append(order)
            self.starts.append(np.searchsorted(key[order], np.arange((1 << width) + 1)))

    @staticmethod
    def part(codes: np.ndarray, lo: int, width: int) -> np.ndarray:
        return ((codes >> np.uint64(lo)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def search(self, code: int, k: int, limit: int = BITS) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of the k nearest codes, by (distance, position); none beyond the distance ``limit``."""
        query = np.array([code], np.int64).view(np.uint64)
        found, dist = np.empty(0, np.int64), np.empty(0, np.int64)
        for radius in range(max(w for _, w in self.segments) + 1):
            for a, (lo, width) in enumerate(self.segments):
                keys = self.part(query, lo, width) ^ _masks(width, radius) if radius <= width else np.empty(0, np.int64)
                begin, end = self.starts[a][keys], self.starts[a][keys + 1]
                size = end - begin
                if size.any():
                    at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
                    near = self.order[a][at]
                    apart = self.codes[near] ^ query
                    # Each code counts in the first step that meets it: no set of codes seen is kept.
                    first = np.full(len(near), 1 << 30, np.int64)
                    for s, (low, wide) in enumerate(self.segments):
                        first = np.minimum(first, np.bitwise_count(self.part(apart, low, wide)).astype(np.int64) * self.m + s)
                    new = first == radius * self.m + a
                    found = np.concatenate([found, near[new]])
                    dist = np.concatenate([dist, np.bitwise_count(apart[new]).astype(np.int64)])
                    if len(found) > k:
                        best = np.lexsort((found, dist))[:k]
                        found, dist = found[best], dist[best]
                covered = self.m * radius + a
                if covered >= limit or len(found) == min(k, len(self.codes)) and (not len(dist) or dist.max() <= covered or len(self.codes) <= k):
                    break
            else:
                continue
            break
        best = np.lexsort((found, dist))
        best = best[dist[best] <= limit]
        return found[best], dist[best]


def hamming_topk(rows: DataFrame, queries: DataFrame, k: int = 10, row_id: str = "id", code: str = "code", shard_codes: int = 1 << 17, block: int = 1 << 14) -> DataFrame:
    """``query_id, rank, neighbor_id, distance``: the k nearest other rows of every query, exactly.

    Both inputs hold an id and a 64-bit ``code``; order is by (distance, id), and a query's own id is
    no neighbour of it. Rows with a null id or code are no neighbours and no queries; repeated rows
    count once. Fewer than k other rows give fewer results, an empty table none. Codes shared by many
    rows are indexed once, with their k + 1 smallest ids: no other row of theirs can be in a top k.
    """
    clean = [df.select(F.col(row_id).cast("long").alias("id"), F.col(code).cast("long").alias("code")).where("id is not null and code is not null").distinct() for df in (rows, queries)]
    smallest = Window.partitionBy("code").orderBy("id")  # a group limit: cut to k + 1 ids a code before the shuffle
    codes = clean[0].withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    codes, queries = store(codes, "codes"), store(clean[1], "queries")
    shards = max(1, -(-codes.count() // shard_codes))
    codes = codes.withColumn("shard", F.pmod(F.xxhash64("code"), F.lit(shards)))
    home = queries.withColumn("shard", F.pmod(F.xxhash64("code"), F.lit(shards)))
    near = _searched(codes, home.withColumn("limit", F.lit(BITS)), k, shards, -(-queries.count() // (shards * block)))
    if shards > 1:
        near = store(near, "near")
        bounds = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("limit"))
        shard = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")), lambda s: s != F.col("shard")))
        away = home.join(bounds, F.col("id") == F.col("query_id"), "left").select("id", "code", shard.alias("shard"), F.coalesce("limit", F.lit(BITS)).cast("int").alias("limit"))
        near = near.union(_searched(codes, away, k, shards, -(-queries.count() // block)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id")).cast("long")
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")


def _searched(codes: DataFrame, queries: DataFrame, k: int, shards: int, groups: int) -> DataFrame:
    """``query_id, neighbor_id, distance``: the k nearest of ``queries(id, code, shard, limit)`` in their shard of ``codes(code, ids, shard)``."""
    groups = max(1, groups, -(-codes.sparkSession.sparkContext.defaultParallelism // shards))
    # Every (shard, query group) is one task: the shard's codes first, then the group's queries in a stream.
    cell = F.col("shard") * groups + F.col("group")
    left = codes.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(cell.alias("cell"), F.lit(True).alias("first"), "code", "ids", F.lit(None).cast("int").alias("limit"))
    right = queries.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).select(cell.alias("cell"), F.lit(False).alias("first"), "code", F.array("id").alias("ids"), "limit")
    both = left.union(right).repartition(shards * groups, "cell").sortWithinPartitions("cell", F.desc("first"), F.col("ids")[0], "code")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell_now, codes_, ids_, index, memo = None, [], [], None, {}
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for cell_, first, c, ids, limit in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if cell_ != cell_now:
                    cell_now, codes_, ids_, index, memo = cell_, [], [], None, {}
                if first:
                    codes_.append(c)
                    ids_.append(ids)
                    continue
                if index is None:
                    index = MultiIndex(np.array(codes_, np.int64).view(np.uint64))
                if (c, limit) not in memo:
                    if len(memo) >= 4096:
                        memo.clear()
                    at, dist = index.search(c, k + 1, limit) if codes_ else ((), ())
                    memo[c, limit] = sorted((int(d), i) for p, d in zip(at, dist, strict=True) for i in ids_[p])[: k + 1]
                query = ids[0]
                out += [(query, i, d) for d, i in memo[c, limit] if i != query][:k]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["query_id", "neighbor_id", "distance"])

    return both.mapInArrow(run, "query_id long, neighbor_id long, distance long")


def op1_mih_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    rows = store(rows, "vector-codes")
    return hamming_topk(rows, rows.where("id % 50 = 0"))


OP1_SQL = """
WITH codes AS (
  SELECT DISTINCT vec_id, list_transform(range(1, 65), lambda i: coalesce(embedding[i] > 0 AND NOT isnan(embedding[i]), false)) AS bits
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
flat AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(bits) AS bit FROM codes),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id, (count(*) FILTER (q.bit <> r.bit))::BIGINT AS distance
  FROM flat q JOIN flat r ON q.i = r.i AND q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
SELECT query_id, rank, neighbor_id, distance FROM ranked WHERE rank <= 10
"""
