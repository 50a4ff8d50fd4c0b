"""Spelling variants: words that differ by one inserted, deleted or replaced letter, found by rolling-hash deletion keys.

A word's deletion keys come from polynomial hashes of its prefixes and suffixes, all of them in one go of numpy however long it is:
``hash(without letter i) = prefix(i) * B ** (n - 1 - i) + suffix(i + 1)``. Two words that differ in letter i have the same key for place i; a
word with one letter more has, for the place of that letter, the key of the shorter word itself. Of a run of equal letters only
the first is deleted, so a pair of words meets under one key and is counted once.

Keys are dealt by their leading bits and sorted there; what is alone under its key goes. The rest is dealt by key once more, now with the
words themselves, and equal keys are verified on strings. No pairs are made: words that share a deletion are counted, and the two best
tell everyone's best. As no two words are the same, a key's words are bounded by the letters there are (and for inserted
letters by the word's length), not by the corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, store, table, unstore, utf8

#: Letters of a word: A-Z, a-z and the Latin-1 ones.
LETTERS = re.compile(r"[A-Za-zÀ-ÿ]+")
#: A word has so many letters and occurs so often; a form occurs so many times as often as its variant.
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: One of so many (document, word) loses a letter.
NOISE = 199
#: Keys that one task sorts, and words that a task counts before it passes them on.
KEYS_A_TASK, COUNTED = 1 << 21, 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_REPLACED, _DELETED = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5A35625E6F5D8E1)


def noisy(doc_id: str, run: str, noise: int) -> str:
    """``run`` without one of its letters, if the checksum of document and run says so."""
    h = crc32(f"{doc_id}:{run}".encode())
    if noise and h % noise == 0:
        at = h % len(run)
        return run[:at] + run[at + 1 :]
    return run


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", noise: int = NOISE, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words of ``docs``: runs of letters with A-Z lower-cased, of at least so many letters, met at least so often.

    ``noise``: one of so many (document, run) loses a letter, by checksum (0: none). A null doc_id is the empty string there, a null or empty text has
    no words, repeated rows count each for themselves. Counts are taken in each task first, so a frequent word is a few rows.
    """

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in slices(batches, 1):
            for i, source in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                name = "" if i is None else str(i)
                for run, n in Counter(LETTERS.findall(source.lower().decode())).items():
                    if len(run) >= least_letters:
                        word = noisy(name, run, noise)
                        if len(word) >= least_letters:
                            total[word] += n
            if len(total) >= COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
                total.clear()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`")).mapInArrow(counted, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, _BASE, np.uint64))])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def deletion_keys(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``whole, without, deletes`` of the words whose code points lie one after the other in ``points``, beginning at ``starts`` (its last entry is the end): a hash of
    each word, for each letter one of its word without it, and whether that letter isn't the same as the one before it in its word.

    All are polynomials modulo 2 ** 64. Sums run over all words; a word's prefix is a difference of two of them, scaled to the word's end.
    """
    n = len(points)
    lengths = np.diff(starts)
    word = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(n) - starts[word]
    power = _powers(int(lengths.max(initial=0)) + 1)
    letters = points.astype(np.uint64) + np.uint64(1)
    left = lengths[word] - 1 - place  # letters after this one
    # As a term of the whole word a letter has the power of the letters after it; before a deleted letter it has one less.
    term, lower = letters * power[left], letters * power[np.maximum(left - 1, 0)]
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
    upto_lower = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lower, dtype=np.uint64)])
    whole = upto[starts[1:]] - upto[starts[:-1]]
    prefix = upto_lower[:-1] - upto_lower[starts[word]]
    suffix = upto[starts[1:]][word] - upto[1:]
    deletes = np.ones(n, bool)
    deletes[1:] = (points[1:] != points[:-1]) | (place[1:] == 0)
    return whole, prefix + suffix, deletes


def key_rows(ids: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``key, id, place`` of the keys of words: for each letter one that words with another letter there share, for each that isn't the same as
    the one before it one that the word without it has (``place`` from 0 in both, below 0 for the latter: -2 - place), and the word's own (-1)."""
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    whole, without, deletes = deletion_keys(points, starts)
    lengths = np.diff(starts)
    word = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(points)) - starts[word]
    replaced = _mixed(without * _REPLACED + (place + 1).astype(np.uint64) * _BASE)
    kept = np.flatnonzero(deletes)
    keys = np.concatenate([replaced, _mixed(without[kept] * _DELETED), _mixed(whole * _DELETED)])
    return keys, np.concatenate([ids[word], ids[word[kept]], ids]), np.concatenate([place, -2 - place[kept], np.full(len(texts), -1)])


def _keys(vocabulary: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 18):
            key, word, place = key_rows(batch.column(0).to_numpy(), batch.column(1).to_pylist())
            for at in range(0, len(key), 1 << 17):
                cut = slice(at, at + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(key[cut].view(np.int64)), pa.array(word[cut]), pa.array(place[cut].astype(np.int32))], names=["key", "id", "place"])

    return vocabulary.select("id", "word").mapInArrow(run, "key long, id long, place int")


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition of keys, sorted, those that are there twice."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    key, word, place = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
    order = np.argsort(key, kind="stable")
    key, word, place = key[order], word[order], place[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    yield pa.RecordBatch.from_arrays([pa.array(c[twice]) for c in (key, word, place)], names=["key", "id", "place"])


def _best(found: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    return sorted(found, key=lambda x: (-x[0], x[1]))[:2]


def meetings(rows: list[tuple[int, int, str, int]]) -> Iterator[tuple[int, int, int, str]]:
    """``id, n_near, n, word`` of the words of one key (``id, place, word, n``): how many they are near to by it, and the best of those.

    Strings decide: words meet by what is left of them without the letter, so words of unlike keys that collide don't.
    """
    replaced: dict[tuple[int, str], list] = {}
    longer: dict[str, list] = {}
    whole: dict[str, tuple[int, str, int]] = {}
    for i, place, word, n in rows:
        if place >= 0:
            replaced.setdefault((place, word[:place] + word[place + 1 :]), []).append((n, word, i))
        elif place == -1:
            whole[word] = (n, word, i)
        else:
            longer.setdefault(word[: -2 - place] + word[-1 - place :], []).append((n, word, i))
    for group in replaced.values():
        if len(group) > 1:
            best = _best(group)
            for x in group:
                n, word, _ = best[x[2] == best[0][2]]
                yield x[2], len(group) - 1, n, word
    for left, group in longer.items():
        if short := whole.get(left):
            n, word, _ = _best(group)[0]
            yield short[2], len(group), n, word
            for x in group:
                yield x[2], 1, short[0], short[1]


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``meetings`` of each key, from rows sorted by it. A key's rows are as many as the letters allow, whatever the corpus is."""
    held: list[tuple] = []
    key = None
    out: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["id", "n_near", "n", "word"])

    for batch in batches:
        for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                out.extend(meetings(held))
                key, held = k, []
                if len(out) >= 1 << 14:
                    yield made()
                    out = []
            held.append(tuple(row))
    out.extend(meetings(held))
    if out:
        yield made()


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``id, n_near, best`` of the words of ``vocabulary(id, word, n)``, a stored table of distinct words, that have near ones: how many words differ from
    it by exactly one inserted, deleted or replaced code point, and of those the one of largest ``n`` (ties: the smallest by code points) as struct
    ``n, word``. An empty vocabulary has none; a very long word has as many keys as letters, each of a few bytes."""
    keys = store(_keys(vocabulary), "spelling-keys")
    parts = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // KEYS_A_TASK))
    # Leading bits of the key name the part.
    part = (F.shiftrightunsigned("key", 40) % parts).cast("int")
    met = store(keys.repartitionById(parts, part).mapInArrow(_met, "key long, id long, place int"), "spelling-met")
    unstore(keys)
    named = met.join(vocabulary.select("id", "word", "n"), "id").select("key", "id", "place", "word", "n")
    found = named.repartition("key").sortWithinPartitions("key").mapInArrow(_verified, "id long, n_near long, n long, word string")
    best = F.min(F.struct((-F.col("n")).alias("down"), "word"))
    return found.groupBy("id").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("id", "n_near", F.struct((-F.col("best.down")).alias("n"), F.col("best.word").alias("word")).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms(word, form)``: forms followed to the last, twice as far in each round. A form occurs several times as often as
    its variant, so there are no circles, and rounds are few."""
    now = store(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = now.select(F.col("word").alias("of"), F.col("root").alias("onward"))
        after = now.join(onward, F.col("root") == F.col("of"), "left")
        after = store(after.select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "spelling-roots")
        unstore(now)
        now = after
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every row of ``counts(word, n)``, whose words are distinct.

    ``n_near`` counts the words that differ by exactly one inserted, deleted or replaced code point. ``form`` is the near word of largest ``n`` (ties: the
    smallest by code points) if that is at least ``ratio`` times the word's own, else null, as is ``form_n``; ``root`` is where following forms ends, the word itself
    without one. Rows with a null word or count are left out; an empty table gives no rows.
    """
    counts = counts.select("word", "n").where("word IS NOT NULL AND n IS NOT NULL")
    vocabulary = store(counts.withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    near = near_words(vocabulary).withColumnRenamed("id", "of")
    known = F.col("best.n") >= F.col("n") * ratio
    judged = vocabulary.join(near, F.col("id") == F.col("of"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(known, F.col("best.word")).alias("form"), F.when(known, F.col("best.n")).alias("form_n")
    )
    judged = store(judged, "spelling-judged")
    roots = _roots(judged.where("form IS NOT NULL")).withColumnRenamed("word", "of")
    return judged.join(roots, F.col("word") == F.col("of"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents and the spellings they vary. Distinct words are counted after each (document, run) has lost a letter or not."""
    return variants(words(table(spark, sf_dir, "documents", "doc_id", "text"))).select("word", "form", "root", "n", "n_near", "form_n")
