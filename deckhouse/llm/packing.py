"""Best-fit packing of tokenized documents into sequences.

Tokenizing happens in one Arrow pass over the texts; only lengths and checksums go on.
The packer is online best-fit in bounded space: a fixed number of open bins, indexed by a
bitset keyed by free space, so that the fullest bin that still takes a piece is the lowest
set bit above its length. When all bins are open, the fullest closes first.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, store, table

#: Chunks whose ids a worker keeps in a generation.
CACHE_CHUNKS = 300_000
#: Pieces that one packing task takes, on average.
TASK_PIECES = 200_000


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_signs() -> dict[int, str]:
    """The sign that byte-level tokenizers write for a byte: itself if printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Ids(dict):
    """Ids of chunks; a chunk that isn't there is made, or taken over from the generation before."""

    def __init__(self, make, older: dict[str, bytes]) -> None:
        self.make, self.older = make, older

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.make(chunk)
        self[chunk] = ids
        return ids


#: A full stop or comma beside another sign: the tokenizer takes such a run as one.
_RUN = re.compile(r"[.,](?:(?=[^\w\s]|[_\x1c-\x1f])|(?<=[^\w\s][.,])|(?<=[_\x1c-\x1f][.,]))")
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class _Letters(dict):
    """Whether the tokenizer takes a sign of a normalised text for a letter: it is asked once for each sign."""

    def __init__(self, pre_tokenizer) -> None:
        self.pieces = pre_tokenizer.pre_tokenize_str

    def __missing__(self, sign: str) -> bool:
        self[sign] = found = len(self.pieces(f"a{sign}a")) == 1
        return found


class ChunkEncoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    The tokenizer normalises (NFC, lower case of each sign by itself), drops white space and splits between letters
    and other signs before any merge, so the ids of a text are those of its chunks in turn. Chunks recur: their ids
    are kept, in two generations of at most CACHE_CHUNKS. Cuts are made at spaces, tabs and line feeds, which normalise
    with nothing, and in texts of Latin-1 (where normalising keeps every sign apart) before a stop or comma. A word goes
    straight to the model only if what the tokenizer's own normaliser makes of it is letters by the tokenizer's own
    splitter; ASCII punctuation after such a word never normalises with it. All else is left to the whole tokenizer,
    chunk by chunk. An empty text has no ids. (``tests/llm`` compares with whole-text encoding, for every sign that
    normalising or lower case changes.)
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.model, self.signs = self.encoder.model, byte_signs()
        self.normal, self.letters = self.encoder.normalizer.normalize_str, _Letters(self.encoder.pre_tokenizer)
        self.ids = _Ids(self.make, {})

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if len(self.ids) > CACHE_CHUNKS:
                self.ids.older = {}
                self.ids = _Ids(self.make, self.ids)
            out.append(b"".join(map(self.ids.__getitem__, self.chunks(text))))
        return out

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Pieces that encode on their own; empty ones have no ids."""
        spaced = text.replace("\n", " ").replace("\t", " ")
        if "<|" in text or not _latin(text):  # special tokens; signs that change their neighbours
            return spaced.split(" ")
        spaced = spaced.lower()
        if not _RUN.search(spaced):
            spaced = spaced.replace(".", " .").replace(",", " ,")
        return spaced.split(" ")

    def make(self, chunk: str) -> bytes:
        # A word of letters is one unit to the model.
        if chunk.isascii():
            if chunk.isalpha():
                return self._merged(chunk.lower())
        elif "<|" not in chunk and all(map(self.letters.__getitem__, x := self.normal(chunk))):
            return self._merged(x.encode().decode("latin-1").translate(self.signs))
        word = chunk.rstrip(_PUNCTUATION)
        if word and len(word) < len(chunk) and "<|" not in chunk and all(map(self.letters.__getitem__, self.normal(word))):
            return self.ids[word] + self.ids[chunk[len(word) :]]
        return np.array(self.encoder.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _merged(self, signs: str) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(signs)])


def _latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


#: A worker process keeps its encoder between tasks.
_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder_for(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 1, most: int = 4096, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``.

    A document is its token ids and then ``end_id``; only one longer than ``most`` is cut, into
    pieces of ``most`` tokens and a last, shorter one. A null or empty text is its end alone.
    Rows with null or repeated ids are documents like any other. An empty table gives no rows.
    """
    where = path or vocabulary()
    schema = PIECES + (", ids array<long>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(where)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches, 1):
            out: list[tuple] = []
            for key, ids in zip(batch.column(0).to_pylist(), encoder.encode([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * most)):
                    part = ids[at : at + 4 * most]
                    out.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").tolist()] if with_ids else [])))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if i != 1 and i < 5 else pa.array(c, pa.int32() if i == 1 else pa.list_(pa.int64())) for i, c in enumerate(zip(*out, strict=True))], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


class BestFit:
    """Bounded-space online best-fit. ``place`` gives (bin, offset); bins are numbered as they open."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.bits = 0  # bit f is set if a bin with f free places is open
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.opened = self.live = 0

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bins = self.at[free]
            number = bins.pop()
            if not bins:
                self.bits ^= 1 << free
            self.live -= 1
        else:
            if self.live == self.open_bins:
                fullest = (self.bits & -self.bits).bit_length() - 1
                bins = self.at[fullest]
                bins.pop()
                if not bins:
                    self.bits ^= 1 << fullest
                self.live -= 1
            free, number = self.capacity, self.opened
            self.opened += 1
        left = free - length
        if left:
            self.at[left].append(number)
            self.bits |= 1 << left
            self.live += 1
        return number, self.capacity - free


def pack(pieces: DataFrame, most: int = 4096, open_bins: int = 4096) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``most``.

    Pieces are dealt by a hash of their identity to tasks of about TASK_PIECES pieces each,
    and every task packs its own stream in hash order, so a rerun gives the same sequences.
    Memory is bounded by the open bins, loss by one set of open bins a task. Tasks follow the
    number of pieces alone, so no key can make one of them large. Rows equal in identity are
    packed as rows of their own. Empty input gives empty output.
    """
    held = store(pieces, "pieces")
    tasks = max(1, -(-held.count() // TASK_PIECES))
    # Whole-capacity pieces need no packing; the others meet in hash order.
    keyed = held.withColumn("key", F.xxhash64("doc_id", "piece", "length", "ids_crc32"))
    keyed = keyed.repartition(tasks, F.pmod("key", F.lit(tasks))).sortWithinPartitions("key", "doc_id", "piece", "length", "ids_crc32")
    keyed = keyed.withColumn("task", F.pmod("key", F.lit(tasks)))
    names = [f.name for f in held.schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema) + ", sequence_id long, offset long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers: dict[int, BestFit] = {}  # a partition can hold several tasks if their hashes meet
        for batch in batches:
            lengths, tasks_ = batch.column(names.index("length")).to_pylist(), batch.column(len(names) + 1).to_pylist()
            ids, offsets = [], []
            for length, task in zip(lengths, tasks_, strict=True):
                packer = packers.get(task) or packers.setdefault(task, BestFit(most, open_bins))
                number, offset = packer.place(length)
                ids.append(task << 40 | number)
                offsets.append(offset)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], names=[*names, "sequence_id", "offset"])

    return keyed.mapInArrow(run, schema)


def op9_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pack(tokenize(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
