"""Near-duplicate documents by min-max hashing of word shingles.

Under each permutation of the hash space both the smallest and the largest value of a document's
shingle set are kept: two unbiased samples for one evaluation. PAIRED permutations make a band of
2 * PAIRED values, and documents that share a band are candidates. A candidate pair is linked only
if its full shingle sets confirm it, and components are the smallest ids reachable over links.

No bucket emits all its pairs. A bucket first links its members to its smallest one. Once
components are known, only members of different components within a bucket are still open, and
those are compared until none is. So a group of copies costs as much as its members, and no link
that the bands offer is lost. A bucket that is large and still holds several components (texts that share
a passage, say) isn't compared: its members meet anew by their rarest shingles, a prefix that linked
sets can't but share, so what many have in common brings none of them together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import low_words, slices, store, table, utf8
from .components import components

#: Words in a shingle, and the similarity from which documents are linked, in hundredths.
WORDS, PERCENT = 5, 75
#: 60 bands of 6 values from 180 permutations: a pair of large sets at similarity 0.75 shares no band
#: with probability (1 - 0.75**6)**60 = 8e-6, one at 0.8 with 1e-8. In small sets the smallest and the
#: largest value depend on each other, so those are joined exactly.
BANDS, PAIRED = 60, 3
#: Pairs whose smaller set has up to SMALL shingles are found by prefix filter and compared in full, so the
#: larger one has up to EXACT.
SMALL = 48
EXACT = SMALL * 100 // PERCENT
#: Most words whose hashes a worker keeps; beyond, it starts anew.
CACHE_WORDS = 300_000
#: Comparisons that one stream of a leader takes.
STREAM = 512

_rng = np.random.default_rng(20_240_601)
_MULTIPLY = (_rng.integers(0, 1 << 32, BANDS * PAIRED, np.uint32) | np.uint32(1))
_XOR = _rng.integers(0, 1 << 32, BANDS * PAIRED, np.uint32)
_PLACE = _rng.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, (BANDS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE = _rng.integers(0, 1 << 63, (1, 2 * PAIRED), np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


_WORDS = WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(words: list[bytes], known: WordHashes = _WORDS, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than a shingle holds are one."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    if n < size:
        return _mixed(np.sum(h * _PLACE[size : size + n], keepdims=True) + np.uint64(n))
    x = h[: n - size + 1] * _PLACE[0]
    for j in range(1, size):
        x += h[j : n - size + 1 + j] * _PLACE[j]
    return np.unique(_mixed(x))


def band_keys(distinct: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, from the smallest and largest values under its permutations."""
    low = (distinct >> np.uint64(16)).astype(np.uint32)
    least = np.full(BANDS * PAIRED, 0xFFFFFFFF, np.uint32)
    most = np.zeros(BANDS * PAIRED, np.uint32)
    for at in range(0, len(low), 512):
        values = low[at : at + 512, None] ^ _XOR
        values *= _MULTIPLY
        np.minimum(least, values.min(0), out=least)
        np.maximum(most, values.max(0), out=most)
    both = np.concatenate([least.reshape(BANDS, PAIRED), most.reshape(BANDS, PAIRED)], 1).astype(np.uint64)
    return _mixed(_mixed((both + np.uint64(1)) * _VALUE).sum(1, keepdims=True) * _BAND).ravel().view(np.int64)


def prefix_keys(distinct: np.ndarray, frequent: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The first shingles of a sorted set, so many that linked sets have one of them in common, whatever the order is, if it is
    one for all sets: that of the hashes, but ``frequent`` (sorted shingles and their counts) last. An empty set has none."""
    n = len(distinct)
    least = -(-n * PERCENT // 100)  # shingles that a linked set shares at least
    if frequent is not None and len(frequent[0]) and n:
        at = np.minimum(np.searchsorted(frequent[0], distinct), len(frequent[0]) - 1)
        distinct = distinct[np.argsort(np.where(frequent[0][at] == distinct, frequent[1][at], 0), kind="stable")]
    return distinct[: n - least + 1 if n else 0].view(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted shingle sets have PERCENT hundredths of their union in common."""
    if min(len(a), len(b)) * 100 < PERCENT * max(len(a), len(b)) or not len(a):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


# ---------------------------------------------------------------- sketches for the second round

#: Values in a sketch, one byte of each, and the share of equal ones from which a pair is compared
#: in full: a pair at 0.75 falls below it with probability 1e-5.
SKETCH, LEAST_EQUAL = 1024, 0.69
_SKETCH_MULTIPLY = _rng.integers(0, 1 << 32, SKETCH // 2, np.uint32) | np.uint32(1)
_SKETCH_XOR = _rng.integers(0, 1 << 32, SKETCH // 2, np.uint32)
#: Members of a bucket that meet in one cell; members of larger buckets meet by their rarest shingles, in cells of so many.
CELL = 512
#: Smallest keys of a prefix that tell in which of the buckets that two members share they are compared.
LOW = 16
#: Texts from which the order of shingles is taken, the share of them that makes a shingle frequent, most frequent ones.
#: (Any order gives the same links; a good one makes less work.)
ORDER_TEXTS, FREQUENT, MOST_FREQUENT = 2000, 0.005, 200_000


def sketch(distinct: np.ndarray) -> np.ndarray:
    """One byte of the smallest and of the largest value under further permutations."""
    low = (distinct >> np.uint64(16)).astype(np.uint32)
    least = np.full(SKETCH // 2, 0xFFFFFFFF, np.uint32)
    most = np.zeros(SKETCH // 2, np.uint32)
    for at in range(0, len(low), 256):
        values = low[at : at + 256, None] ^ _SKETCH_XOR
        values *= _SKETCH_MULTIPLY
        np.minimum(least, values.min(0), out=least)
        np.maximum(most, values.max(0), out=most)
    both = np.concatenate([least, most])
    both = (both ^ (both >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return (both >> np.uint32(24)).astype(np.uint8)


# ---------------------------------------------------------------- the operator


def signatures(docs: DataFrame, exact: bool = False) -> DataFrame:
    """``doc_id, digest, n_shingles, keys`` of ``docs(doc_id, text)``: the digest of the word sequence (null
    without words), the size of the shingle set, its band keys and, of a small set, its prefix; if ``exact``, its prefix alone. Null and empty texts have no
    words, null ids and repeated rows are rows like others, an empty table gives none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            digests, sizes, keys = [], [], []
            for text in utf8(batch.column(1)):
                words = low_words(text)
                distinct = shingles(words)
                sizes.append(len(distinct))
                digests.append(blake2b(b" ".join(words), digest_size=16).digest() if words else None)
                keys.append(None if not words else prefix_keys(distinct) if exact else np.concatenate([band_keys(distinct), prefix_keys(distinct[: EXACT * (len(distinct) <= EXACT)])]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "digest", "n_shingles", "keys"])

    return docs.mapInArrow(run, "doc_id long, digest binary, n_shingles long, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full shingle sets are linked, as ``u, v``.

    The pairs of one ``a`` are dealt to streams of about STREAM; a stream starts with the text of ``a``
    and compares each ``b`` as it comes, so a task holds one set, however many partners it has. Null and empty texts have empty
    sets, which are linked with nothing; pairs whose texts aren't there are dropped; no pairs give no rows.
    """
    streams = pairs.groupBy("a").agg(F.ceil(F.count("*") / STREAM).alias("n"))
    partners = pairs.join(streams.withColumnRenamed("a", "of"), F.col("a") == F.col("of")).select("a", F.pmod(F.xxhash64("b"), F.col("n")).alias("stream"), "b")
    partners = partners.join(texts, F.col("b") == F.col("rep")).select("a", "stream", "b", "text")
    heads = streams.withColumn("stream", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    heads = heads.join(texts, F.col("a") == F.col("rep")).select("a", "stream", F.lit(None).cast("long").alias("b"), "text")
    rows = heads.union(partners).repartition("a", "stream").sortWithinPartitions("a", "stream", F.col("b").asc_nulls_first())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, []
        for batch in slices(batches, 3):
            out = []
            for a, stream, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), utf8(batch.column(3)), strict=True):
                if (a, stream) != now:
                    now, sets = (a, stream), []
                distinct = shingles(low_words(text))
                if b is None:
                    sets.append(distinct)
                elif any(linked(x, distinct) for x in sets):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def _sketches(texts: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = [shingles(low_words(t)) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array([band_keys(s).tobytes() for s in sets], pa.binary()), pa.array([sketch(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() if len(s) <= EXACT else b"" for s in sets], pa.binary())], names=["rep", "size", "keys", "sketch", "small"])

    return texts.mapInArrow(run, "rep long, size long, keys binary, sketch binary, small binary")


def _by_rare_shingles(texts: DataFrame) -> DataFrame:
    """``key, rep, low`` of ``texts(rep, text)``: the prefix of each in an order that has frequent shingles last, and its LOW smallest keys."""

    def shingles_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = np.concatenate([shingles(low_words(t)) for t in utf8(batch.column(1))])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["key"])

    some = texts.orderBy(F.xxhash64("rep"), "rep").limit(ORDER_TEXTS)
    often = some.mapInArrow(shingles_of, "key long").groupBy("key").count().where(F.col("count") > max(2, FREQUENT * ORDER_TEXTS))
    often = often.orderBy(F.desc("count"), "key").limit(MOST_FREQUENT).toPandas()
    names, count = often["key"].to_numpy(np.int64).view(np.uint64), often["count"].to_numpy(np.int64)
    order = np.argsort(names)
    frequent = names[order], count[order]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            keys = [prefix_keys(shingles(low_words(t)), frequent) for t in utf8(batch.column(1))]
            sizes = [len(k) for k in keys]
            low = pa.array([np.sort(k.view(np.uint64))[:LOW].tobytes() for k in keys], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column(0).take(pa.array(np.repeat(np.arange(len(keys)), sizes))), low.take(pa.array(np.repeat(np.arange(len(keys)), sizes)))], names=["key", "rep", "low"])

    return texts.mapInArrow(run, "key long, rep long, low binary")


def _apart(buckets: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``key, rep, label`` (and ``low``) of all members, and ``of, n`` of the keys whose members are in different components."""
    low = F.col("low") if "low" in buckets.columns else F.lit(None).cast("binary").alias("low")
    named = buckets.join(labels, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("label", "rep").alias("label"), low)
    of_key = named.groupBy(F.col("key").alias("of")).agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low < high")
    return named, of_key.select("of", "n")


def meetings(buckets: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """``key, banded, chunks, rep, label, low``: the buckets whose members still have to meet. Those of more than CELL members are
    replaced by the buckets of their members' rarest shingles (``banded`` false), which are cut into chunks of about CELL."""
    named, of_key = _apart(buckets, labels)
    of_key = store(of_key, "open-keys")
    met = named.join(of_key.where(F.col("n") <= CELL), F.col("key") == F.col("of")).select("key", F.lit(True).alias("banded"), F.lit(1).cast("long").alias("chunks"), "rep", "label", "low")
    large = of_key.where(F.col("n") > CELL)
    if large.isEmpty():
        return met
    wanted = named.join(large, F.col("key") == F.col("of")).select(F.col("rep").alias("of")).distinct()
    rare = store(_by_rare_shingles(store(texts.join(wanted, F.col("rep") == F.col("of")).select("rep", "text"), "crowd")), "rare")
    named, of_key = _apart(rare, labels)
    return met.union(named.join(of_key, F.col("key") == F.col("of")).select("key", F.lit(False), F.ceil(F.col("n") / CELL), "rep", "label", "low"))


def open_pairs(buckets: DataFrame, labels: DataFrame, texts: DataFrame, exact: bool = False) -> DataFrame:
    """``a, b``: pairs that share a bucket, are in different components and alike by sketch (if ``exact``, by size alone).

    Every two chunks of a bucket meet in a cell of bounded size; pairs are compared there and only the alike leave,
    each pair in the first bucket that it shares. Small sets are compared in full, so of those a cell gives only links that
    join components. No bucket, no pair: empty inputs give no rows.
    """
    mixed = store(meetings(buckets, labels, texts), "mixed")
    wanted = mixed.select(F.col("rep").alias("of")).distinct()
    known = store(_sketches(texts.join(wanted, F.col("rep") == F.col("of")).select("rep", "text")), "sketches")
    rows = mixed.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rows = rows.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "banded", "chunk", "label", F.col("rep").alias("of"), "low")
    cell = ["key", "i", "j", "banded"]
    rows = rows.join(known, F.col("of") == F.col("rep")).select(*cell, "chunk", "rep", "label", "size", "keys", "sketch", "small", "low")
    rows = rows.repartition(*cell).sortWithinPartitions(*cell, "rep")

    def compare(key: int, i: int, j: int, banded: bool, cell: list[tuple]) -> Iterator[tuple[int, int]]:
        chunk, rep, label, size = (np.array(x, np.int64) for x in list(zip(*cell, strict=True))[:4])
        keys = np.frombuffer(b"".join(x[4] for x in cell), np.int64).reshape(len(cell), -1)
        bytes_ = np.frombuffer(b"".join(x[5] for x in cell), np.uint8).reshape(len(cell), -1)
        # Small sets in rows of EXACT, filled up with what no other set has.
        sets = np.zeros((len(cell), EXACT), np.uint64)
        held = np.arange(EXACT) < np.where(size <= EXACT, size, 0)[:, None]
        sets[held] = np.frombuffer(b"".join(x[6] for x in cell), np.uint64)

        # The smallest keys of a prefix in rows of LOW; what smaller key two members share, both rows have.
        nothing = np.uint64((1 << 64) - 1)
        low = np.full((len(cell), LOW), nothing)
        for x, row in enumerate(cell if not banded else ()):
            some = np.frombuffer(row[7], np.uint64)
            low[x, : len(some)] = some
        here = np.array([key], np.int64).view(np.uint64)[0]

        for x in range(len(cell) - 1):
            later = slice(x + 1, None)
            near = (label[later] != label[x]) & (np.minimum(size[later], size[x]) * 100 >= PERCENT * np.maximum(size[later], size[x])) & (rep[later] != rep[x])
            if i != j:
                near &= chunk[later] != chunk[x]
            at = np.flatnonzero(near) + x + 1
            if not len(at):
                continue
            if size[x] <= EXACT:
                small = at[size[at] <= EXACT]
                common = (np.isin(sets[small], sets[x][held[x]]) & held[small]).sum(1)
                for y in small[100 * common >= PERCENT * (size[small] + size[x] - common)]:
                    if label[y] != label[x]:  # linked for sure, so one link joins the two components for this cell
                        label[label == label[y]] = label[x]
                        yield (int(rep[x]), int(rep[y])) if rep[x] < rep[y] else (int(rep[y]), int(rep[x]))
                at = at[size[at] > EXACT]
            if not exact:
                at = at[np.count_nonzero(bytes_[at] == bytes_[x], axis=1) >= LEAST_EQUAL * SKETCH]
                if banded and len(at):
                    shared = keys[at] == keys[x]
                    first = keys[x][np.argmax(shared, axis=1)]
                    at = at[shared.any(1) & (first == key)]
            if not banded and len(at):  # in the first bucket that they share; where the rows don't tell it, in each
                least = np.where(np.isin(low[at], low[x][low[x] != nothing]), low[at], nothing).min(1)
                at = at[(least == here) | (least == nothing)]
            for y in at:
                yield (int(rep[x]), int(rep[y])) if rep[x] < rep[y] else (int(rep[y]), int(rep[x]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish() -> Iterator[pa.RecordBatch]:
            if len(cell) > 1:
                out = list(compare(*now, cell))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

        now, cell = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(12)), strict=True):
                if row[:4] != now:
                    yield from finish()
                    now, cell = row[:4], []
                cell.append(row[4:])
        yield from finish()

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links, the own one included. Texts without
    words (null, empty, white space) have no shingles and are linked with nothing. Rows that repeat an
    id are one document with several texts and share its component. Rows with a null id can be neither
    named nor reached: their component is null and they are not kept. An empty table gives no rows.
    ``exact``: candidates come from prefixes of the sets alone, without bands and sketches, so no link is missed.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = store(signatures(rows, exact), "signatures")
    named = signed.where("doc_id is not null")
    # Exact copies are one class, named by its smallest id; only classes go on.
    classes = store(named.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "classes")
    members = named.select("doc_id", "n_shingles", F.col("digest").alias("of")).join(classes.select("digest", "rep"), F.col("of") == F.col("digest"), "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    members = store(members, "members")
    same_id = members.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where("u < v")
    same_id = same_id.select("u", "v").union(same_id.select(F.col("doc_id").alias("u"), F.col("u").alias("v")))

    bands = classes.select("rep", F.explode("keys").alias("key"))
    shared = bands.groupBy(F.col("key").alias("of")).agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last")
    buckets = store(bands.join(shared, F.col("key") == F.col("of")).select("key", "rep", "leader"), "buckets")
    wanted = buckets.select(F.col("rep").alias("of")).distinct()
    texts = store(rows.join(wanted, F.col("doc_id") == F.col("of")).select(F.col("doc_id").alias("rep"), "text"), "texts")

    # First round: each class against the smallest member of its buckets.
    pairs = buckets.where("leader <> rep").groupBy("rep").agg(F.min("leader").alias("a")).select("a", F.col("rep").alias("b"))
    links = store(verified(pairs, texts).union(same_id), "links")
    labels = components(links)
    # Second round: what shares a bucket and is still apart.
    more = store(verified(store(open_pairs(buckets, labels, texts, exact), "open"), texts), "links")
    labels = components(labels.select(F.col("node").alias("u"), F.col("label").alias("v")).union(more))

    out = members.join(labels, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    nameless = signed.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.union(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every component of ``near_duplicates``, all columns: that with the smallest id.

    Rows without an id are in no component and stay. If the smallest id is repeated, its first row by
    text (nulls last) stays.
    """
    found = near_duplicates(docs, doc_id, text)
    gone = found.where("doc_id is not null and not kept").select("doc_id").distinct()
    repeated = store(found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    left = rows.join(gone, "doc_id", "left_anti")
    again = left.join(repeated, "doc_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col(f"row.`{text}`").asc_nulls_last()))
    first = again.withColumn("place", place).where("place = 1").select("row")
    return left.join(repeated, "doc_id", "left_anti").select("row").union(first).select("row.*")


def op5_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, found by bands and sketches: a pair of large sets at similarity 0.75 is missed with a probability of 1e-5; ``near_duplicates(exact=True)`` misses none."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


OP5_SQL = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (
  WITH RECURSIVE r(doc_id, seen) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, p.b FROM r JOIN both_ways p ON p.a = r.seen)
  SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, component_id::BIGINT AS component_id, s.doc_id = component_id AS kept
FROM sets s JOIN reach USING (doc_id)
"""
