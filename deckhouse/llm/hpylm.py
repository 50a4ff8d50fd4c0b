"""Language-model scores from a hierarchical Pitman-Yor model whose seating is sampled by Gibbs.

Every context (the word before; the end of a text at the start of the next) is a restaurant, and all share one
parent restaurant of words over a uniform base. A customer is a token, a table serves one word, and
each table of a context sends one customer to the parent. A Gibbs sweep seats all customers of a
pair anew in one draw: of its number of tables, which is all that probabilities depend on.
Predictive probabilities are averaged over the sweeps after the burn-in.

Pairs are dealt by word: all tables that serve a word, in every context and in the parent, are in
one part, of at most an entry for each context a word, so no frequent word or context makes a part
large. The totals of contexts are a table of their own, dealt the same way: before a sweep each part
tells the parts of its contexts how many tables it has there and gets the sums back. They and the
parent's totals are those of the sweep before, so sweeps run in parallel over the parts.

A pair with one customer has one table whatever is drawn, and a word with one customer in the parent too: sweeps
leave both out and count them once. So what a sweep moves is the repeated pairs, not the corpus.

Texts are read once, into blocks. A block asks each part about its distinct (context, word) pairs;
counts are the sums of what blocks ask with, and answers go back to the block. So what is shuffled
is what distinct pairs there are in a block, packed, not tokens. Sorted numbers travel as their gaps, all numbers
by byte position, compressed. Words are 64-bit hashes, contexts the first 48 bits of theirs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import low_words, slices, store, store_kinds, table, unstore, utf8
from .minmax import _WORDS

#: Tokens in a block; texts in a part, in bytes; most tasks that share the parts.
BLOCK_TOKENS, PART_BYTES, TASKS = 1_500_000, 16 << 20, 16_384
#: Sweeps that are thrown away, sweeps that are averaged.
BURN_IN, SAMPLES = 2, 3
#: Customers up to which table counts are drawn from a table of Stirling numbers; beyond, from contour integrals.
STIRLING = 1024
#: Strength of a restaurant and of the parent. Discounts come from the counts: n1 / (n1 + 2 * n2).
THETA = 1.0
#: The end of a text as a token, and the context of its first word: no word has a space.
END = xxhash.xxh64_intdigest(b" ")
LAST = (1 << 31) - 1
#: Bits of a word's hash that don't name its context.
_SHORT = np.uint64(16)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays by byte position (high bytes of small numbers compress away), compressed."""
    out = [len(arrays).to_bytes(4, "little")]
    for x in arrays:
        x = np.ascontiguousarray(x)
        out += [x.dtype.str.encode().ljust(4), len(x).to_bytes(8, "little"), x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpack(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 4
    for _ in range(int.from_bytes(data[:4], "little")):
        kind, n = np.dtype(data[at : at + 4].decode().strip()), int.from_bytes(data[at + 4 : at + 12], "little")
        at += 12
        size = n * kind.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, size, at).reshape(kind.itemsize, n).T).view(kind).ravel())
        at += size
    return out


def _gaps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending.astype(np.uint64), prepend=np.uint64(0))


def _whole(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.uint64)


def _u32(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32)


def _ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and the place of each value there: one sort of values with their positions in the low bits."""
    low = np.uint64(max(1, len(x) - 1).bit_length())
    values = x.astype(np.uint64, copy=False)
    if len(x) and int(values.max()) >> (64 - int(low)):
        if x.dtype != np.uint64:
            return np.unique(x, return_inverse=True)
        kept = values >> low  # of hashes the high bits do, unless two meet in them
    else:
        kept = values
    both = kept << low
    both |= np.arange(len(x), dtype=np.uint64)
    both.sort()
    order = (both & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    new = np.empty(len(x), bool)
    new[:1] = True
    ordered = x[order]
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    if kept is not values and (new[1:] & (both[1:] >> low == both[:-1] >> low)).any():
        return np.unique(x, return_inverse=True)
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def _part_of(names: np.ndarray, parts: int) -> np.ndarray:
    """The part of words or contexts, by the first 32 bits of their 48."""
    return ((names >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _runs(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``value, from, to`` of each run of equal values."""
    edges = np.flatnonzero(np.diff(part, prepend=-1))
    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(part)], strict=False):  # (no edges, no runs)
        yield int(part[lo]), lo, hi


def _sums_at(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(at, values, size).astype(np.int64)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def _dealt(rows: DataFrame, parts: int, key: str, then: str) -> DataFrame:
    """Rows of one key together, in order; at most TASKS tasks, each with its share of the keys."""
    tasks = min(parts, TASKS)
    return rows.repartitionById(tasks, F.pmod(F.col(key), F.lit(tasks)).cast("int")).sortWithinPartitions(key, then)


def _by_key(batches: Iterable[pa.RecordBatch], columns: int) -> Iterator[tuple[int, list[tuple]]]:
    """Runs of rows with one first column, the others as tuples."""
    now, got = None, []
    for batch in batches:
        for key, *row in zip(*(batch.column(i).to_pylist() for i in range(columns)), strict=True):
            if key != now and got:
                yield now, got
                got = []
            now = key
            got.append(tuple(row))
    if got:
        yield now, got


# ---------------------------------------------------------------- reading


def read_blocks(docs: DataFrame, parts: int) -> DataFrame:
    """``kind, part, block, body``: for each block a row ``texts`` (part LAST) and a row ``asked`` for each part.

    ``asked``: distinct words, contexts of their pairs, the pairs (context * words + word), training count of each pair.
    ``texts``: ids, lengths, training flags, number of words in each part, part and place there of each token's word.
    """

    def block_rows(block: int, ids: list, texts: list[np.ndarray]) -> Iterator[tuple]:
        lengths = np.array(list(map(len, texts)), np.int64)
        train = np.array([not held_out(i) for i in ids])
        words, place = _ranked(np.concatenate(texts))
        runs = list(_runs(_part_of(words >> _SHORT, parts)))
        sizes = np.array([hi - lo for _, lo, hi in runs])
        number, rank = np.repeat(np.arange(len(runs)), sizes)[place], (np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[place]
        pair, at = _ranked(_codes(number, rank, place, sizes, lengths))
        count = np.bincount(at[np.repeat(train, lengths)], minlength=len(pair))
        named = np.array([i is not None for i in ids])
        yield "texts", LAST, block, _pack(np.array([i or 0 for i in ids], np.int64), named.astype(np.uint8), lengths, train.astype(np.uint8), sizes, _u32(number), _u32(rank))
        edges = np.searchsorted(pair, np.arange(len(runs) + 1) * len(words) * int(sizes.max()))
        for (p, lo, hi), a, b in zip(runs, edges, edges[1:], strict=False):
            context, word = np.divmod(pair[a:b] % (len(words) * int(sizes.max())), int(sizes.max()))
            new = np.diff(context, prepend=-1) > 0  # contexts ascend
            yield "asked", p, block, _pack(_gaps(words[lo:hi]), _gaps(words[context[new]] >> _SHORT), _gaps((np.cumsum(new) - 1) * (hi - lo) + word), _u32(count[a:b]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        ids, texts, size, done = [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for row in block_rows(done << 32 | task, ids, texts):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.string(), pa.int32(), pa.int64(), pa.binary()], strict=True)], names=["kind", "part", "block", "body"])

        for batch in slices(batches, 1):
            for key, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = low_words(text)
                tokens = np.empty(len(words) + 1, np.uint64)
                tokens[:-1] = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
                tokens[-1] = END
                ids.append(key)
                texts.append(tokens)
                size += len(tokens)
            if size >= BLOCK_TOKENS:
                yield from flush()
                ids, texts, size, done = [], [], 0, done + 1
        if ids:
            yield from flush()

    return docs.mapInArrow(run, "kind string, part int, block long, body binary")


def _codes(number: np.ndarray, rank: np.ndarray, place: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(number of the word's part, place of the word before, the word's rank in its part) of every token, as one number.
    Before a text's first word stands the end, which is every text's last token."""
    context = np.empty(len(place), np.int64)
    context[1:] = place[:-1]
    context[np.cumsum(lengths) - lengths] = place[-1]
    return (number * int(sizes.sum()) + context) * int(sizes.max()) + rank


# ---------------------------------------------------------------- counting


class Merged:
    """What all blocks asked one part: its words and contexts, the pairs (word * contexts + context) and their training counts."""

    def __init__(self, asked: list[bytes]) -> None:
        got = [_unpack(body) for body in asked]
        words, contexts = [_whole(g[0]) for g in got], [_whole(g[1]) for g in got]
        self.words, at = _ranked(np.concatenate(words))
        self.contexts, to = _ranked(np.concatenate(contexts))
        #: For each block, its words among all.
        self.at = np.split(at, np.cumsum([len(w) for w in words])[:-1])
        codes = []
        for (_, _, code, _), mine, theirs in zip(got, self.at, np.split(to, np.cumsum([len(c) for c in contexts])[:-1]), strict=True):
            context, word = np.divmod(_whole(code).astype(np.int64), max(1, len(mine)))
            codes.append(mine[word] * len(self.contexts) + theirs[context])
        self.pairs, back = _ranked(np.concatenate(codes))
        self.back = np.split(back, np.cumsum([len(c) for c in codes])[:-1])
        self.count = _sums_at(back, np.concatenate([g[3] for g in got]), len(self.pairs))
        word, context = np.divmod(self.pairs, max(1, len(self.contexts)))
        known = self.count > 0
        self.in_training = _sums_at(word, self.count, len(self.words))
        self.alone = np.bincount(word[known], minlength=len(self.words))
        #: Pairs and words whose tables are drawn: of more than one customer.
        self.many = np.flatnonzero(self.count > 1)
        self.busy = np.flatnonzero((self.alone > 1) | (np.bincount(word[self.many], minlength=len(self.words)) > 0))
        self.word, self.context = word, context


def merge(asked: DataFrame, parts: int) -> DataFrame:
    """``part, drawn, shares, totals``. ``drawn``: pairs of each busy word, then word, context and customers of the pairs that are
    drawn, names of those contexts, and how many words with a pair aren't busy. ``shares``: contexts, their tokens and their pairs
    of one customer. ``totals``: pairs and words of count 1 and 2, words, tokens, pairs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_key(batches, 2):
            m = Merged([body for (body,) in rows])
            known, by_word = m.count > 0, m.in_training
            shape = [int((m.count == 1).sum()), int((m.count == 2).sum()), int((by_word == 1).sum()), int((by_word == 2).sum()), int((by_word > 0).sum()), int(m.count.sum()), int(known.sum())]
            used, to = np.unique(m.context[m.many], return_inverse=True)
            place = np.zeros(len(m.words), np.int64)
            place[m.busy] = np.arange(len(m.busy))
            drawn = _pack(_u32(m.alone[m.busy]), _gaps(place[m.word[m.many]]), _u32(to), _u32(m.count[m.many]), _gaps(m.contexts[used]), np.array([shape[4] - len(m.busy)]))
            tokens = _sums_at(m.context, m.count, len(m.contexts))
            there = np.flatnonzero(tokens)
            single = np.bincount(m.context[m.count == 1], minlength=len(m.contexts))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([drawn], pa.binary()), pa.array([_pack(_gaps(m.contexts[there]), _u32(tokens[there]), _u32(single[there]))], pa.binary()), pa.array([shape], pa.list_(pa.int64()))], names=["part", "drawn", "shares", "totals"])

    return _dealt(asked, parts, "part", "block").select("part", "body").mapInArrow(run, "part int, drawn binary, shares binary, totals array<long>")


def _sums(df: DataFrame, column: str, size: int) -> list[int]:
    """Element sums of an array column: as many rows as elements reach the driver."""
    out = [0] * size
    for r in df.select(F.posexplode(column)).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        out[r.pos] = int(r.n)
    return out


# ---------------------------------------------------------------- totals of contexts


def _to_homes(shares: DataFrame, parts: int) -> DataFrame:
    """``part, home, body``: the shares of each part's contexts, for the parts of the contexts. A share's first array is the contexts' gaps."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, got in _by_key(batches, 2):
            gaps, *values = _unpack(got[0][0])
            context = _whole(gaps)
            rows = [(home, part, _pack(_gaps(context[lo:hi]), *(v[lo:hi] for v in values))) for home, lo, hi in _runs(_part_of(context, parts))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int32(), pa.binary()], strict=True)], names=["home", "part", "body"])

    return shares.mapInArrow(run, "home int, part int, body binary")


def homes(counts: DataFrame, parts: int) -> DataFrame:
    """``home, part, body``: the contexts of each home (part -1), their tokens and pairs of one customer in all parts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, rows in _by_key(batches, 3):
            got = [_unpack(body) for _, body in rows]
            context, at = _ranked(np.concatenate([_whole(g[0]) for g in got]))
            sums = [_u32(_sums_at(at, np.concatenate([g[i] for g in got]), len(context))) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array([home], pa.int32()), pa.array([-1], pa.int32()), pa.array([_pack(_gaps(context), *sums)], pa.binary())], names=["home", "part", "body"])

    return _dealt(_to_homes(counts.select("part", "shares"), parts), parts, "home", "part").mapInArrow(run, "home int, part int, body binary")


def _with_tables(own: bytes, shares: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Contexts of a home, their tokens, their tables by each array of the shares, and where each share's contexts are."""
    gaps, tokens, single = _unpack(own)
    context = _whole(gaps)
    at = [np.searchsorted(context, _whole(g[0])) for g in shares]
    tables = [single.astype(np.int64) for _ in shares[0][1:]] if shares else []
    for where, (_, *values) in zip(at, shares, strict=True):
        for total, value in zip(tables, values, strict=True):
            total[where] += value  # (a share names a context once)
    return context, tokens, tables, at


def context_tables(around: DataFrame, shares: DataFrame, parts: int) -> DataFrame:
    """``part, home, tables``: of each part's drawn contexts, in order of home, the tables that all parts have there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, rows in _by_key(batches, 3):
            (_, own), *told = rows
            if not told:
                continue
            _, _, (tables,), at = _with_tables(own, [_unpack(body) for _, body in told])
            yield pa.RecordBatch.from_arrays([pa.array([part for part, _ in told], pa.int32()), pa.array([home] * len(told), pa.int32()), pa.array([_pack(_u32(tables[x])) for x in at], pa.binary())], names=["part", "home", "tables"])

    return _dealt(around.union(_to_homes(shares, parts)), parts, "home", "part").mapInArrow(run, "part int, home int, tables binary")


def context_samples(around: DataFrame, kept: DataFrame, parts: int, samples: int) -> DataFrame:
    """``part, body``: of each home its contexts, their tokens and their tables in each sample."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, rows in _by_key(batches, 3):
            (_, own), *told = rows
            context, tokens, tables, _ = _with_tables(own, [_unpack(body) for _, body in told])
            tables = tables or [_unpack(own)[2]] * samples
            yield pa.RecordBatch.from_arrays([pa.array([home], pa.int32()), pa.array([_pack(_gaps(context), tokens, *map(_u32, tables))], pa.binary())], names=["part", "body"])

    return _dealt(around.union(_to_homes(kept, parts)), parts, "home", "part").mapInArrow(run, "part int, body binary")


# ---------------------------------------------------------------- Gibbs


@lru_cache(2)
def _stirling(discount: float) -> np.ndarray:
    """Logs of the generalised Stirling numbers: row c, column t is the weight of all ways to seat c customers at t tables."""
    out = np.full((STIRLING + 1, STIRLING + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, STIRLING + 1)
    with np.errstate(divide="ignore"):
        for c in range(1, STIRLING):
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], out[c, 1:] + np.log(np.maximum(c - discount * t, 0.0)))
    return out


def log_ways(customers: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """Log of the generalised Stirling number over (customers - 1)!, by the contour integral of its generating function.

    With g(x) = 1 - (1 - x)**d it is [x**(c - 1)] g**(t - 1) g' / (t - 1)! / d**t, and x = exp(-v) runs on a parabola
    around the cut through (about) the saddle; if that leaves the strip of width 2 pi, on the circle.
    """
    c, t = customers.astype(float)[:, None], tables.astype(float)[:, None]

    def log_value(v: np.ndarray) -> np.ndarray:
        rest = np.log(-np.expm1(-v))
        return (c - 1) * v + (t - 1) * np.log(-np.expm1(discount * rest)) + (discount - 1) * rest

    def slope(v: np.ndarray) -> np.ndarray:
        x, rest = np.exp(-v), -np.expm1(-v)
        return (c - 1) - (t - 1) * discount * x * rest ** (discount - 1) / -np.expm1(discount * np.log(rest)) + (discount - 1) * x / rest

    low, high = np.full(c.shape, -50.0), np.full(c.shape, 4.0)
    for _ in range(50):
        middle = (low + high) / 2
        rising = slope(np.exp(middle)) > 0
        low, high = np.where(rising, low, middle), np.where(rising, middle, high)
    a = np.exp(high) + 1 / c
    step = 1e-4 * a
    bend = (slope(a + step) - slope(a - step)) / (2 * step)
    reach = 1.5 * np.sqrt(40 / np.maximum(2 * a * a * bend + a * np.maximum(slope(a), 0), 1e-3))
    around = 2 * a * reach > np.pi
    at = np.arange(65) / 64
    u = reach * at
    v = np.where(around, a + 1j * np.pi * at, a * (1 + 1j * u) ** 2)
    dv = np.where(around, np.pi / 64 + 0j, 2 * a * (1 + 1j * u) * reach / 64)
    top = log_value(a)
    parts = (np.exp(log_value(v) - top) * dv).real
    whole = parts[:, 1:-1].sum(1) + (parts[:, 0] + parts[:, -1]) / 2
    with np.errstate(invalid="ignore"):
        out = top[:, 0] + np.log(whole / np.pi) - log_gamma(t[:, 0]) + (1 - t[:, 0]) * np.log(discount)
    return np.where(t[:, 0] == c[:, 0], -log_gamma(c[:, 0]), out)


def log_gamma(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.lgamma, x.ravel().tolist()), float, x.size).reshape(x.shape)


def _many_tables(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Table counts of pairs with many customers, each drawn from its whole distribution (cut where it is below 1e-12)."""
    # The mean: with w (1 - e) e**(d - 1) = c, about w (1 - e**d) / d.
    low, high = np.full(len(customers), -700.0), np.zeros(len(customers))
    for _ in range(60):
        middle = (low + high) / 2
        over = np.log(weight) + np.log(-np.expm1(middle)) + (discount - 1) * middle > np.log(customers)
        low, high = np.where(over, middle, low), np.where(over, high, middle)
    mean = -weight * np.expm1(discount * high) / discount
    spread = 8 * np.sqrt(mean + 1)
    least = np.clip(np.floor(mean - spread - 4), 1, customers).astype(np.int64)
    most = np.clip(np.ceil(mean + spread + 14), 1, customers).astype(np.int64)
    nodes = np.rint(least[:, None] + (most - least)[:, None] * (1 - np.cos(np.pi * np.arange(28) / 27)) / 2).astype(np.int64)
    out = np.empty(len(customers), np.int64)
    for at in range(0, len(customers), 64):
        these = slice(at, at + 64)
        ways = log_ways(np.repeat(customers[these], 28), nodes[these].ravel(), discount).reshape(-1, 28)
        for i, w in zip(range(at, at + 64), ways, strict=False):
            # Logs of the ways are smooth in the number of tables, but for (t - 1)!, which goes and comes back.
            t = np.arange(least[i], most[i] + 1)
            scale = max(1.0, (most[i] - least[i]) / 2)
            middle = (most[i] + least[i]) / 2
            known, place = np.unique(nodes[i], return_index=True)
            if len(t) <= len(known):
                log_p = w[place]
            else:
                fit = np.polynomial.chebyshev.chebfit((known - middle) / scale, w[place] + log_gamma(known.astype(float)), min(18, len(known) - 1))
                log_p = np.polynomial.chebyshev.chebval((t - middle) / scale, fit) - log_gamma(t.astype(float))
            log_p = log_p + (t - middle) * math.log(weight[i])
            mass = np.cumsum(np.exp(log_p - log_p.max()))
            out[i] = t[min(np.searchsorted(mass, rng.random() * mass[-1], "right"), len(t) - 1)]
    return out


def draw_tables(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """The number of tables of each pair, all its customers seated anew: t with probability in proportion to
    weight**t times the generalised Stirling number of its customers and t. ``weight`` is that of a new table."""
    out = np.minimum(customers, 1).astype(np.int64)
    if not len(out):
        return out
    many = np.flatnonzero(customers > STIRLING)
    if len(many):
        out[many] = _many_tables(customers[many], weight[many], discount, rng)
    order = np.argsort(customers, kind="stable")
    values, starts = np.unique(customers[order], return_index=True)
    for c, lo, hi in zip(values.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        if not 2 <= c <= STIRLING:
            continue
        ways, step = _stirling(discount)[c, 1 : c + 1], max(1, 500_000 // c)
        for at in range(lo, hi, step):
            who = order[at : min(at + step, hi)]
            log_p = ways + np.log(weight[who])[:, None] * np.arange(1, c + 1)
            mass = np.cumsum(np.exp(log_p - log_p.max(1, keepdims=True)), 1)
            out[who] = 1 + np.minimum((mass < (rng.random(len(who)) * mass[:, -1])[:, None]).sum(1), c - 1)
    return out


def parent_probability(customers: np.ndarray, tables: np.ndarray, all_customers: int, all_tables: int, discount: float, words: int) -> np.ndarray:
    """Probability of words in the parent restaurant; of a word without customers if those are 0."""
    seated = np.maximum(customers - discount * tables, 0.0)
    return (seated + (THETA + discount * all_tables) / (words + 1)) / (THETA + all_customers)


def first_seating(drawn: bytes) -> tuple[bytes, bytes]:
    """``seating, shares`` to start with: each pair has one table in its context, each word one in the parent."""
    alone, word, context, count, names, _ = _unpack(drawn)
    ones = np.ones(len(count), np.uint32)
    return _pack(ones, np.ones(len(alone), np.uint32), np.zeros(len(count), np.uint32)), _pack(names, _u32(np.bincount(context, minlength=len(names))))


def swept(part: int, drawn: bytes, seating: bytes, kept: bytes | None, in_context: np.ndarray, number: int, burn_in: int, shape: dict, totals: tuple[int, int], seed: int) -> tuple[int, bytes, bytes, bytes | None, list[int]]:
    """A sweep over one part: ``part, seating, shares, kept, totals`` (parent customers, parent tables).
    ``in_context``: tables of each of its drawn contexts in all parts. ``shares``: contexts, tables now; ``kept``: contexts, tables of
    each sweep after the burn-in."""
    rng = np.random.default_rng([seed, number, part])
    alone, gaps, context, count, names, (rest,) = _unpack(drawn)
    word = _whole(gaps).astype(np.int64)
    tables, up_tables, summed, *sampled = _unpack(seating)
    up = alone + _sums_at(word, tables.astype(np.int64) - 1, len(alone))
    known = parent_probability(up, up_tables, *totals, shape["parent"], shape["words"])
    weight = (THETA + shape["child"] * in_context[context]) * known[word]
    tables = draw_tables(count.astype(np.int64), weight, shape["child"], rng)
    up = alone + _sums_at(word, tables - 1, len(alone))
    up_weight = np.full(len(alone), (THETA + shape["parent"] * totals[1]) / (shape["words"] + 1))
    up_tables = draw_tables(up, up_weight, shape["parent"], rng)
    here = _u32(_sums_at(context, tables, len(names)))
    if number >= burn_in:
        summed = summed + _u32(tables - 1)
        sampled += [_u32(up), _u32(up_tables)]
        kept = _pack(*(_unpack(kept) if kept else [names]), here)
    return part, _pack(_u32(tables), _u32(up_tables), summed, *sampled), _pack(names, here), kept, [int(up.sum() + rest), int(up_tables.sum() + rest)]


SEATING = "part int, seating binary, shares binary, kept binary, totals array<long>"
_SEATING_TYPES = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]


def _seating_batch(row: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _SEATING_TYPES, strict=True)], names=["part", "seating", "shares", "kept", "totals"])


def begun(counts: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_key(batches, 2):
            yield _seating_batch((part, *first_seating(rows[0][0]), None, []))

    return counts.select("part", "drawn").mapInArrow(run, SEATING)


def sweep(counts: DataFrame, state: DataFrame, around: DataFrame, number: int, burn_in: int, shape: dict, totals: tuple[int, int], parts: int, seed: int) -> DataFrame:
    """One Gibbs sweep over every part of ``counts(part, drawn)`` and ``state(part, seating, shares, kept)``."""
    nothing = F.lit(None).cast("binary")
    rows = counts.select("part", F.lit(-2).alias("home"), F.col("drawn").alias("body"), nothing.alias("kept"))
    rows = rows.union(state.select("part", F.lit(-1), "seating", "kept")).union(context_tables(around, state.select("part", "shares"), parts).select("part", "home", "tables", nothing))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, got in _by_key(batches, 4):
            (_, drawn, _), (_, seating, kept), *replies = got
            in_context = np.concatenate([np.empty(0, np.uint32), *(_unpack(reply)[0] for _, reply, _ in replies)])
            yield _seating_batch(swept(part, drawn, seating, kept, in_context, number, burn_in, shape, totals, seed))

    return _dealt(rows, parts, "part", "home").mapInArrow(run, SEATING)


# ---------------------------------------------------------------- answers


def answers(asked: DataFrame, state: DataFrame, around: DataFrame, parts: int, samples: int) -> DataFrame:
    """``part, block, answer``: of each asked pair its customers and how many tables more than one it has had in all samples; of each word
    its training count, its tokens as a context, and for each sample its customers and tables in the parent and its tables as a context."""
    rows = state.select("part", F.lit(-2).cast("long").alias("block"), F.col("seating").alias("body"))
    rows = rows.union(around.select("part", F.lit(-1).cast("long"), "body")).union(asked.select("part", "block", "body"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, got in _by_key(batches, 3):
            own = {block: body for block, body in got if block < 0}
            got = [(block, body) for block, body in got if block >= 0]
            if not got:
                continue  # contexts here are words of some block, so this can't be; a part without questions has no answers
            m = Merged([body for _, body in got])
            n = len(m.words)
            extra, ups = np.zeros(len(m.pairs), np.uint32), []
            _, _, summed, *sampled = _unpack(own[-2])
            extra[m.many] = summed
            once = np.minimum(m.alone, 1)
            for values in sampled:
                x = once.copy()
                x[m.busy] = values
                ups.append(x)
            seen = [np.zeros(n, np.int64) for _ in range(1 + samples)]
            if -1 in own:
                gaps, *values = _unpack(own[-1])
                names, mine = _whole(gaps), m.words >> _SHORT
                at = np.minimum(np.searchsorted(names, mine), len(names) - 1)
                seen = [np.where(names[at] == mine, v[at], 0) for v in values]
            for (block, _), words, pairs in zip(got, m.at, m.back, strict=True):
                body = _pack(_u32(m.count[pairs]), extra[pairs], *(_u32(x[words]) for x in (m.in_training, *seen, *ups)))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([body], pa.binary())], names=["part", "block", "answer"])

    return _dealt(rows, parts, "part", "block").mapInArrow(run, "part int, block long, answer binary")


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def gather_scores(texts: DataFrame, replies: DataFrame, readers: int, shape: dict, sampled: list[tuple[int, int]]) -> DataFrame:
    """Scores of the texts of every block, once the answers of all its parts are there. (Blocks are numbered by reading task, of
    which there are ``readers``, so that they deal out evenly.)"""
    both = texts.select("part", "block", "body").union(replies.select("part", "block", "answer"))
    tasks = min(max(1, texts.count()), TASKS)
    dense = F.shiftright("block", 32) * F.lit(readers) + F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    both = both.repartitionById(tasks, F.pmod(dense, F.lit(tasks)).cast("int")).sortWithinPartitions("block", "part")
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])
    samples = len(sampled)

    def scored(body: bytes, got: list[list[np.ndarray]]) -> pa.RecordBatch:
        ids, named, lengths, train, sizes, number, rank = _unpack(body)
        number = number.astype(np.int64)
        place = (np.cumsum(sizes) - sizes)[number] + rank
        customers, extra, count, tokens, *rest = (np.concatenate(x).astype(float) for x in zip(*got, strict=True))
        tables, ups = rest[:samples], rest[samples:]
        pair, at = _ranked(_codes(number, rank, place, sizes, lengths))
        before, word = np.divmod(pair, int(sizes.max()))
        part, context = np.divmod(before, len(count))
        word += (np.cumsum(sizes) - sizes)[part]
        gathered = customers - shape["child"] * (np.minimum(customers, 1) + extra / samples)
        back = np.zeros(len(pair))
        for s, totals in enumerate(sampled):
            up = parent_probability(ups[2 * s], ups[2 * s + 1], *totals, shape["parent"], shape["words"])
            back += (THETA + shape["child"] * tables[s][context]) * up[word] / samples
        log_p = np.log10((gathered + back) / (THETA + tokens[context]))
        starts = np.cumsum(lengths) - lengths
        base = np.log10((count + 1) / (shape["tokens"] + shape["words"] + 1))
        score = np.add.reduceat(log_p[at], starts)
        known = np.add.reduceat((count > 0)[place].astype(np.int64), starts)
        columns = [pa.array(ids, mask=named == 0), train == 0, lengths, known, np.full(len(ids), shape["tokens"]), np.add.reduceat(base[place], starts), score, 10 ** np.minimum(300, -score / lengths)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = []
        for batch in batches:
            for part, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if part == LAST:
                    yield scored(body, got)
                    got = []
                else:
                    got.append(_unpack(body))

    return both.mapInArrow(run, SCORES)


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 11, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every whole text.

    Texts whose crc32(doc_id as text) mod 7 is not 2 are learnt from (a null id counts as empty text).
    A null or empty text is its end token alone. Repeated rows count as often as they are there. If
    nothing is learnt from, every token has the probability of the uniform base over one unknown
    word, 1. An empty table gives no rows. A text longer than a block is a block of its own.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, -(-size // PART_BYTES))
    asked, blocks = store_kinds(read_blocks(rows, parts), "blocks", "kind", ["asked", "texts"], packed=True)
    counts = store(merge(asked, parts), "counts", packed=True)
    n1, n2, w1, w2, words, tokens, pairs = _sums(counts, "totals", 7)
    shape = {"child": n1 / (n1 + 2 * n2) if n2 else 0.5, "parent": w1 / (w1 + 2 * w2) if w2 else 0.5, "words": words, "tokens": tokens}
    around = store(homes(counts, parts), "contexts", packed=True)
    state, totals, sampled = store(begun(counts), "seating", packed=True), (pairs, words), []
    for number in range(burn_in + samples):
        after = store(sweep(counts, state, around, number, burn_in, shape, totals, parts, seed), "seating", packed=True)
        unstore(state)
        a, b = _sums(after, "totals", 2)
        state, totals = after, (a, b)
        if number >= burn_in:
            sampled.append(totals)
    unstore(counts)
    seen = context_samples(around, state.where("kept is not null").select("part", "kept"), parts, samples)
    replies = store(answers(asked, state, seen, parts, samples), "answers", packed=True)
    for step in (asked, around, state):
        unstore(step)
    return gather_scores(blocks, replies, max(1, rows.rdd.getNumPartitions()), shape, sampled)


def op10_hpylm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents", "doc_id", "text"))
