"""Substring deduplication by level-wise doubling: windows of words that occur twice, at ever greater lengths.

A window is so many consecutive words of one text. What is repeated at one length alone can be repeated at twice that
length, so each level takes only what survived the one before:

* Half the wanted length: of the halves inside a window of the wanted length only the one of the smallest hash (the first
  such) is looked at, its anchor. Equal windows have equal anchors at the same place, so nothing is lost, and a text
  has an anchor for about every sixth of its words.
* The wanted length: windows whose anchor is repeated. Where the same words start earlier (by document, then by place), a
  window is ``later``, and the words it covers go.
* Twice, four times ... the wanted length, until no candidate survives: a window at ``pos`` if those at ``pos`` and
  ``pos + length`` are repeated both. Keys come from the keys of the two halves, so texts aren't read again. The last level that
  a text reaches is the length of its longest repeat.

Exact copies of a text are told by its digest first and never cut into windows. Every level combines its windows in chunks before it
shuffles: what a chunk holds twice is known to be repeated there, and only its first is asked about, so a
passage that a third of all texts share is one row for each chunk and not for each text. A key is 96 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, store, store_kinds, table, unstore, utf8
from .minmax import WordHashes

#: Words in a window that is removed where it is repeated.
LENGTH = 20
#: Windows that are combined before they are shuffled.
CHUNK = 1 << 20

_rng = np.random.default_rng(20_250_712)
#: Odd multipliers by place; a window takes as many as it has words, drawn on when a longer one asks.
_ODD = _rng.integers(0, 1 << 63, (2, 64), np.uint64) * np.uint64(2) + np.uint64(1)
_HASHES = WordHashes()

#: kind: 1 asks whether its key is met elsewhere, 0 is known to be repeated in its chunk (and not the first there), 2 says that a text
#: has repeats of ``pos`` words.
ROWS = "key long, check int, uid long, pos int, kind int, many boolean"
_ROWS = pa.schema([("key", pa.int64()), ("check", pa.int32()), ("uid", pa.int64()), ("pos", pa.int32()), ("kind", pa.int32()), ("many", pa.bool_())])

Windows = tuple[int, np.ndarray, np.ndarray, np.ndarray]  # of one text: its uid, places, keys, checks


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _odd(n: int, which: int) -> np.ndarray:
    return _ODD[which, :n] if n <= _ODD.shape[1] else np.random.default_rng(which).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def window_keys(hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A 64-bit key of every window of ``length`` words, from the hashes of the words; none of a shorter text."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for place, odd in enumerate(_odd(length, which)):
        total += hashes[place : place + n] * odd
    return _mixed(total)


def anchors(keys: np.ndarray, span: int) -> np.ndarray:
    """The place of the smallest of every ``span`` consecutive keys, the first of them if they tie."""
    return np.lib.stride_tricks.sliding_window_view(keys, span).argmin(1) + np.arange(len(keys) - span + 1) if len(keys) >= span else np.empty(0, np.int64)


def _hashed(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _checks(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _flushed(gathered: list[Windows]) -> Iterator[pa.RecordBatch]:
    """The windows of a chunk, each told apart by whether it is the first of its key in the chunk."""
    uid = np.repeat(np.array([w[0] for w in gathered], np.int64), [len(w[1]) for w in gathered])
    pos, key, check = (np.concatenate([w[i] for w in gathered]) for i in (1, 2, 3))
    order = np.lexsort((pos, uid, check, key))
    uid, pos, key, check = uid[order], pos[order], key[order], check[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    many = np.ones(len(key), bool)
    starts = np.flatnonzero(first)
    many[starts] = np.diff(np.append(starts, len(key))) > 1
    rows = [key.view(np.int64), check, uid, pos.astype(np.int32), first.astype(np.int32), many]
    for at in range(0, len(key), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)], t) for c, t in zip(rows, _ROWS.types, strict=True)], schema=_ROWS)


def _combined(windows: Iterable[Windows]) -> Iterator[pa.RecordBatch]:
    gathered: list[Windows] = []
    n = 0
    for w in windows:
        if not len(w[1]):
            continue
        gathered.append(w)
        n += len(w[1])
        if n >= CHUNK:
            yield from _flushed(gathered)
            gathered, n = [], 0
    if gathered:
        yield from _flushed(gathered)


def _half_level(texts: DataFrame, length: int) -> DataFrame:
    half = (length + 1) // 2

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[Windows]:
        for batch in slices(batches, 1):
            for uid, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                keys = window_keys(_hashed(text), half)
                at = np.unique(anchors(keys, length - half + 1))
                yield uid, at, keys[at], _checks(keys[at])

    return texts.select("uid", "text").mapInArrow(lambda batches: _combined(windows(batches)), ROWS)


def _full_level(texts: DataFrame, repeated: DataFrame, length: int) -> DataFrame:
    """Windows of ``length`` words whose anchor is repeated."""
    half = (length + 1) // 2
    at = repeated.groupBy("uid").agg(F.collect_list("pos").alias("at"))

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[Windows]:
        for batch in slices(batches, 1):
            for i, (uid, text) in enumerate(zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True)):
                hashes = _hashed(text)
                known = np.zeros(len(hashes), bool)
                known[batch.column(2)[i].values.to_numpy(zero_copy_only=False)] = True
                pos = np.flatnonzero(known[anchors(window_keys(hashes, half), length - half + 1)])
                if len(pos):
                    yield uid, pos, window_keys(hashes, length)[pos], _checks(window_keys(hashes, length, 1)[pos])

    return texts.select("uid", "text").join(at, "uid").mapInArrow(lambda batches: _combined(windows(batches)), ROWS)


def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``uid, pos, key`` of each text from rows that are sorted by uid and pos, whatever batches they come in."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        uid, pos, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cuts = [0, *(np.flatnonzero(np.diff(uid)) + 1).tolist(), len(uid)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and held[0][0][0] != uid[a]:
                yield int(held[0][0][0]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
                held = []
            held.append((uid[a:b], pos[a:b], key[a:b]))
    if held:
        yield int(held[0][0][0]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])


def doubled(pos: np.ndarray, key: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, keys and checks of the windows of twice ``length`` words both halves of which are among the given ones (sorted by place)."""
    at = np.searchsorted(pos, pos + length)
    there = at < len(pos)
    there[there] = pos[at[there]] == pos[there] + length
    a, b = key[there].view(np.uint64), key[at[there]].view(np.uint64)
    odd = _ODD[:, 62:64]
    return pos[there], _mixed(a * odd[0, 0] + b * odd[0, 1]), _checks(_mixed(a * odd[1, 0] + b * odd[1, 1]))


def _next_level(repeated: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[int] = []

        def windows() -> Iterator[Windows]:
            for uid, pos, key in runs(batches):
                seen.append(uid)
                yield uid, *doubled(pos, key, length)

        yield from _combined(windows())
        if seen:
            n = len(seen)
            same = [pa.array(np.full(n, x), t) for x, t in ((0, pa.int64()), (0, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*same, pa.array(seen, pa.int64()), pa.array(np.full(n, length), pa.int32()), pa.array(np.full(n, 2), pa.int32()), pa.array(np.ones(n, bool))], schema=_ROWS)

    return repeated.select("uid", "pos", "key").repartition("uid").sortWithinPartitions("uid", "pos").mapInArrow(run, ROWS)


def _repeated(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``uid, pos, key, later`` of all windows whose key is met twice; ``later``: it is met earlier, too."""
    same = Window.partitionBy("key", "check").orderBy("uid", "pos")
    ranked = asked.withColumn("rank", F.row_number().over(same)).withColumn("next", F.lead("uid").over(same))
    met = ranked.where(F.col("many") | (F.col("rank") > 1) | F.col("next").isNotNull())
    return met.select("uid", "pos", "key", (F.col("rank") > 1).alias("later")).unionAll(known.select("uid", "pos", "key", F.lit(True).alias("later")))


def distinct_texts(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``ids(doc_id, digest)`` of all rows, ``firsts(digest, first, uid, n)`` of all distinct texts, and ``texts(uid, text)``, stored.

    ``first`` is the smallest doc_id of a text (null last) and ``uid`` a number in the order of those, texts of one id by digest;
    ``n`` counts the documents. Rows that repeat an id and its text are one document.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    ids = store(rows.select("doc_id", "digest"), "repeat-ids")
    each = ids.groupBy("digest", "doc_id").agg(F.count("*").alias("rows"))
    firsts = each.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.max("rows").alias("rows"))
    ranged = firsts.repartitionByRange(F.col("first").asc_nulls_last(), "digest").sortWithinPartitions(F.col("first").asc_nulls_last(), "digest")
    firsts = store(ranged.withColumn("uid", F.monotonically_increasing_id()), "repeat-firsts")
    own = firsts.select(F.col("digest").alias("of"), "first", "uid")
    texts = rows.join(own, (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first"))).select("uid", "text")
    if (firsts.agg(F.max("rows")).first()[0] or 0) > 1:
        texts = texts.dropDuplicates(["uid"])
    return ids, firsts, store(texts, "repeat-texts")


def _level(rows: DataFrame, name: str) -> list[DataFrame]:
    return store_kinds(rows, name, "kind", ["1", "0", "2"])


def repeated_windows(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``uid, pos, key, later`` of every window of ``length`` words of ``texts(uid, text)`` that occurs twice in them, stored. Earlier is what
    has the smaller uid, or in one text the smaller place. Texts without so many words have none; an empty table has none."""
    asked, known, _ = _level(_half_level(texts, length), "repeat-half")
    half = store(_repeated(asked, known).select("uid", "pos"), "repeat-anchors")
    unstore(asked), unstore(known)
    asked, known, _ = _level(_full_level(texts, half, length), "repeat-full")
    out = store(_repeated(asked, known), "repeat-windows")
    unstore(half), unstore(asked), unstore(known)
    return out


def longest_repeats(repeated: DataFrame, length: int = LENGTH) -> DataFrame:
    """``uid, longest``: the greatest of ``length``, twice, four times ... ``length`` of which a text has a window that occurs twice. Levels
    go on until no window survives, so there are as many as doublings of ``length`` up to the longest repeat."""
    levels: list[DataFrame] = []
    rows, seen = _level(_next_level(repeated, length), "repeat-next"), length
    while True:
        asked, known, reached = rows
        levels.append(reached.select("uid", F.col("pos").alias("longest")))
        if asked.isEmpty():
            return _union(levels).groupBy("uid").agg(F.max("longest").alias("longest"))
        seen *= 2
        rows = _level(_next_level(_repeated(asked, known), seen), "repeat-next")
        unstore(asked), unstore(known)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionAll(frame)
    return out


def _by_text(make: Callable[[list[bytes], np.ndarray], tuple], columns: list[tuple[str, pa.DataType]], length: int) -> Callable:
    """For ``uid, text, at``: what ``make`` says of the words and of a mask of those that no window at a place ``at`` covers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out = []
            for i, text in enumerate(utf8(batch.column(1))):
                words = text.split()
                edges = np.zeros(len(words) + 1, np.int64)
                if batch.column(2)[i].is_valid:
                    at = batch.column(2)[i].values.to_numpy(zero_copy_only=False)
                    edges[at] += 1
                    edges[at + length] -= 1
                out.append(make(words, np.cumsum(edges)[:-1] == 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, (_, t) in zip(zip(*out, strict=True), columns, strict=True))], names=["uid", *(n for n, _ in columns)])

    return run


def _kept_words(words: list[bytes], kept: np.ndarray) -> list[bytes]:
    return words if kept.all() else [w for w, k in zip(words, kept.tolist(), strict=True) if k]


def _covered(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    later = repeated.where("later").groupBy("uid").agg(F.collect_list("pos").alias("at"))
    return texts.select("uid", "text").join(later, "uid", "left").select("uid", "text", "at")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, longest`` for every row of ``docs``.

    Words that a window of ``length`` words covers go if the same words start earlier: in a document of smaller id (null ids come
    last), or earlier in the same one. Windows are judged on what is given, not on what is left. ``longest`` is the greatest of ``length``,
    twice, four times ... ``length`` for which a window of the document occurs elsewhere, too (0: none does).

    Null and empty texts have no words; very long ones are read whole. Documents of one id with different texts go by
    the digests of those; rows that repeat an id and its text are one document and get the same values. An empty table gives no rows.
    Other columns are never read.
    """
    ids, firsts, texts = distinct_texts(docs, doc_id, text)
    windows = repeated_windows(texts, length)
    longest = longest_repeats(windows, length)

    def made(words: list[bytes], kept: np.ndarray) -> tuple:
        left = _kept_words(words, kept)
        return len(words), len(words) - len(left), sha256(b" ".join(left)).hexdigest()

    columns = [("n_words", pa.int64()), ("own_removed", pa.int64()), ("own_sha256", pa.string())]
    judged = _covered(texts, windows).mapInArrow(_by_text(made, columns, length), "uid long, n_words long, own_removed long, own_sha256 string")
    judged = firsts.join(judged, "uid").join(longest, "uid", "left")
    met = ids.join(judged.withColumnRenamed("digest", "of"), F.col("digest") == F.col("of"))
    # All windows of a copy start earlier, in the text's first document.
    copy = ~F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("n_words") >= length)
    doublings = F.floor(F.log2(F.col("n_words") / F.lit(length)) + F.lit(1e-9))
    whole = F.when((F.col("n") > 1) & (F.col("n_words") >= length), F.pow(F.lit(2), doublings).cast("long") * length)
    return met.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("own_removed")).alias("n_removed"),
        F.when(copy, F.lit(sha256(b"").hexdigest())).otherwise(F.col("own_sha256")).alias("kept_sha256"), F.coalesce(F.greatest(F.col("longest").cast("long"), whole), F.lit(0)).cast("long").alias("longest"),
    )


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs``, all columns, with the texts that are left (words joined by one space) where something was removed; others stay as they are.
    Rows are taken as by ``repeats``; a document of which nothing is left has an empty text."""
    ids, firsts, texts = distinct_texts(docs, doc_id, text)

    def made(words: list[bytes], kept: np.ndarray) -> tuple:
        return len(words), None if kept.all() else b" ".join(_kept_words(words, kept)).decode()

    columns = [("n_words", pa.int64()), ("left", pa.string())]
    judged = _covered(texts, repeated_windows(texts, length)).mapInArrow(_by_text(made, columns, length), "uid long, n_words long, left string")
    judged = firsts.join(judged, "uid").select(F.struct("digest", "first", "n_words", "left").alias("judged"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)).alias("of"))
    met = whole.join(judged, F.col("of") == F.col("judged.digest"))
    copy = ~F.col(f"row.`{doc_id}`").eqNullSafe(F.col("judged.first")) & (F.col("judged.n_words") >= length)
    left = F.when(copy, F.lit("")).otherwise(F.coalesce(F.col("judged.left"), F.col(f"row.`{text}`")))
    return met.select(F.col("row").withField(f"`{text}`", left).alias("row")).select("row.*")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


def oracle_sql(docs: str = "documents", length: int = LENGTH, levels: int = 11) -> str:
    """DuckDB SQL for ``repeats``: every window as a string, and twice its length by the digests of both halves, without pruning."""
    out = rf"""
WITH listed AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM {docs}),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos, len(words) AS n FROM listed),
strings AS (
  SELECT doc_id, pos, word, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING) AS said FROM placed),
level0 AS (SELECT doc_id, pos, md5(said) AS key FROM strings WHERE pos + {length} <= n),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS place FROM level0) WHERE place > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {length})) AS pos FROM later),
kept AS (
  SELECT p.doc_id, count(*) FILTER (g.pos IS NOT NULL) AS n_removed, coalesce(string_agg(p.word, ' ' ORDER BY p.pos) FILTER (g.pos IS NULL), '') AS left_over
  FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)"""
    for k in range(1, levels):
        gap = length << (k - 1)
        out += f""",
level{k} AS (
  SELECT a.doc_id, a.pos, md5(a.key || b.key) AS key FROM level{k - 1} a JOIN level{k - 1} b ON a.doc_id = b.doc_id AND a.pos + {gap} = b.pos)"""
    found = " UNION ALL ".join(f"SELECT DISTINCT doc_id, {length << k} AS long FROM (SELECT doc_id, count(*) OVER (PARTITION BY key) AS met FROM level{k}) WHERE met > 1" for k in range(levels))
    return out + f""",
longest AS (SELECT doc_id, max(long)::BIGINT AS longest FROM ({found}) GROUP BY doc_id)
SELECT l.doc_id, len(l.words)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.left_over, '')) AS kept_sha256, coalesce(g.longest, 0)::BIGINT AS longest
FROM listed l LEFT JOIN kept k ON l.doc_id = k.doc_id LEFT JOIN longest g ON l.doc_id = g.doc_id
"""


OP12_SQL = oracle_sql()
