"""Telephony audio in media columns: mu-law, A-law and IMA ADPCM in WAVE files, to resampled PCM.

mu-law and A-law expand by 256-entry tables built from their rule. ADPCM is sequential within a
block but blocks are independent, so numpy decodes all blocks of a batch side by side, one
nibble position at a time. Resampling is polyphase with integer taps, so results are exact
and equal everywhere.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table, utf8

#: WAVE format codes (fixed values).
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 0x11
CODEC_NAMES = {PCM: "pcm", ALAW: "alaw", MULAW: "mulaw", IMA_ADPCM: "ima_adpcm"}

#: IMA ADPCM step sizes and index changes (fixed values).
IMA_STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
IMA_INDEX = [-1, -1, -1, -1, 2, 4, 6, 8]

#: Bytes of texts or media that are worked on at a time: their PCM is up to eight times as long.
SLICE = 1 << 20
#: Payload bytes in an ADPCM block, after its 4-byte header.
BLOCK = 64
RATE, TARGET_RATE = 8000, 16000


@lru_cache(maxsize=1)
def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


@lru_cache(maxsize=1)
def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent = (code >> 4) & 7
    size = ((code & 0x0F) << 4) + 8
    size = np.where(exponent > 0, (size + 0x100) << np.maximum(exponent - 1, 0), size)
    return np.where(code & 0x80, size, -size).astype(np.int16)


@lru_cache(maxsize=1)
def _ima_tables() -> tuple[np.ndarray, np.ndarray]:
    step, nibble = np.array(IMA_STEPS)[:, None], np.arange(16)[None, :]
    size = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
    change = np.where(nibble & 8, -size, size).astype(np.int32).ravel()
    after = np.clip(np.arange(89)[:, None] + np.array(IMA_INDEX * 2)[None, :], 0, 88) * 16
    return change, after.astype(np.int32).ravel()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Blocks (n, 4 + m) of bytes to samples (n, 1 + 2m), all blocks at once."""
    n, width = blocks.shape
    change, after = _ima_tables()
    value = blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8
    value = (value ^ 0x8000) - 0x8000
    row = np.minimum(blocks[:, 2].astype(np.int32), 88) * 16
    out = np.empty((1 + 2 * (width - 4), n), np.int16)  # by position, so that a step writes one row
    out[0] = value
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(2 * (width - 4)):
        nibble = data[i >> 1] >> 4 if i & 1 else data[i >> 1] & 15
        at = row + nibble
        value = np.clip(value + change[at], -32768, 32767)
        row = after[at]
        out[i + 1] = value
    return out.T


def write_wave(codec: int, data: bytes, rate: int = RATE) -> bytes:
    """A mono WAVE file; ADPCM data must be whole blocks of 4 + BLOCK bytes."""
    bits, align = {PCM: (16, 2), IMA_ADPCM: (4, 4 + BLOCK)}.get(codec, (8, 1))
    samples = {PCM: len(data) // 2, IMA_ADPCM: len(data) // align * (1 + 2 * BLOCK)}.get(codec, len(data))
    per_s = rate * align // (1 + 2 * BLOCK) if codec == IMA_ADPCM else rate * align
    extra = struct.pack("<HH", 2, 1 + 2 * BLOCK) if codec == IMA_ADPCM else b"" if codec == PCM else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", codec, 1, rate, per_s, align, bits) + extra
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(fmt)) + fmt
    if codec != PCM:
        body += struct.pack("<4sII", b"fact", 4, samples)
    body += struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) & 1)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def read_wave(media: bytes) -> tuple[int, int, int, bytes]:
    """``codec, rate, block align, data`` of a mono WAVE file; ValueError if it is something else."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt " and size >= 16:
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        if name == b"data":
            if fmt is None or fmt[1] != 1 or fmt[0] not in CODEC_NAMES:
                raise ValueError("not a mono file of a known codec")
            return fmt[0], fmt[2], fmt[4], media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def decode_waves(files: list[bytes]) -> list[tuple[int, int, bytes, np.ndarray] | ValueError]:
    """``codec, rate, coded payload, samples`` of each file; ADPCM blocks of all files decode together."""
    out: list = []
    adpcm: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, media in enumerate(files):
        try:
            codec, rate, align, data = read_wave(media)
            if codec == IMA_ADPCM and align <= 4:
                raise ValueError("bad block size")
        except ValueError as e:
            out.append(e)
            continue
        raw = np.frombuffer(data, np.uint8)
        if codec == IMA_ADPCM:
            blocks = raw[: len(raw) // align * align].reshape(-1, align)
            adpcm.setdefault(align, []).append((i, blocks))
            out.append((codec, rate, blocks[:, 4:].tobytes(), None))
        elif codec == PCM:
            out.append((codec, rate, data, np.frombuffer(data[: len(data) // 2 * 2], "<i2")))
        else:
            out.append((codec, rate, data, (mulaw_table() if codec == MULAW else alaw_table())[raw]))
    for some in adpcm.values():
        samples = decode_ima(np.concatenate([b for _, b in some]))
        at = 0
        for i, blocks in some:
            out[i] = (*out[i][:3], samples[at : at + len(blocks)].ravel())
            at += len(blocks)
    return out


@lru_cache(maxsize=16)
def _taps(up: int, down: int, width: int = 8) -> np.ndarray:
    """Integer taps (up, width), each phase summing to 2**14: a Hann-windowed sinc."""
    cut = min(1.0, up / down)
    x = np.arange(width)[None, :] - width // 2 + 1 - np.arange(up)[:, None] / up
    h = np.sinc(x * cut) * (0.5 + 0.5 * np.cos(np.pi * np.clip(x / (width / 2), -1, 1)))
    whole = np.rint(h / h.sum(1, keepdims=True) * (1 << 14)).astype(np.int32)
    whole[np.arange(up), np.argmax(whole, 1)] += (1 << 14) - whole.sum(1)
    return whole


def resample(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    """16-bit samples at another rate; ``len * target // rate`` of them, equal rates pass through."""
    up, down = target // gcd(rate, target), rate // gcd(rate, target)
    if up == down or not len(samples):
        return samples.astype(np.int16)
    taps, n = _taps(up, down), len(samples)
    width = taps.shape[1]
    total = n * up // down
    padded = np.zeros(n + width + down, np.int32)
    padded[width // 2 - 1 : width // 2 - 1 + n] = samples
    out = np.empty(total, np.int16)
    for j in range(min(up, total)):  # output j, j + up, ...: one phase, every down-th input
        start, phase = divmod(j * down, up)
        count = len(range(j, total, up))
        sums = np.full(count, 1 << 13, np.int32 if down == 1 else np.int64)
        for k in range(width):
            if taps[phase, k]:
                at = start + k
                sums += padded[at : at + (count - 1) * down + 1 : down] * taps[phase, k]
        out[j::up] = np.clip(sums >> 14, -32768, 32767)
    return out


def describe(codec: int, samples: np.ndarray, pcm: np.ndarray, target: int = TARGET_RATE) -> str:
    """Features of decoded audio as text: all integers, so equal media give equal strings."""
    wide = samples.astype(np.int64)
    crossings = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    return f"codec={CODEC_NAMES[codec]} samples={len(samples)} peak={int(np.abs(wide).max(initial=0))} power={int(wide @ wide) // max(1, len(wide))} crossings={crossings} pcm={len(pcm)}@{target} pcm_crc32={zlib.crc32(pcm.astype('<i2').tobytes())}"


#: What ``store_pcm`` adds to a row.
STORED = {"codec": "string", "rate": "int", "n_samples": "long", "feature": "string", "payload": "binary", "pcm": "binary", "error": "string"}
_STORED_TYPES = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t] for t in STORED.values()]


def store_pcm(df: DataFrame, media: str = "media", target: int = TARGET_RATE) -> DataFrame:
    """``df`` with its column ``media`` of WAVE files read: ``codec, rate, n_samples, feature, payload, pcm, error``.

    ``payload`` holds the coded samples as they are stored, ``pcm`` is a 16-bit WAVE file at the target rate. Media that are null, empty or
    not a known mono file keep their row with null results and a reason in ``error``. Repeated rows are kept, all other columns too, but
    those of the names that are added. An empty table gives none.
    """
    rows = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in STORED))
    names = rows.columns
    return rows.mapInArrow(lambda batches: _stored(batches, names, names.index(media), target), _with_stored(rows.schema))


def _with_stored(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, *T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in STORED.items())).fields])


def _stored(batches: Iterable[pa.RecordBatch], names: list[str], at: int, target: int) -> Iterator[pa.RecordBatch]:
    def one(got) -> tuple:
        if isinstance(got, ValueError):
            return (None,) * 6 + (str(got),)
        codec, rate, payload, samples = got
        pcm = resample(samples, rate, target)
        return CODEC_NAMES[codec], rate, len(samples), describe(codec, samples, pcm, target), payload, write_wave(PCM, pcm.astype("<i2").tobytes(), target), None

    for batch in slices(batches, at, SLICE):
        out = [one(got) for got in decode_waves(batch.column(at).fill_null(b"").to_pylist())]
        added = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _STORED_TYPES, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*names, *STORED])


def carry(payload: bytes) -> bytes:
    """A payload (a multiple of BLOCK bytes) as a telephony file whose coded samples are its bytes.

    The payload's checksum picks mu-law, A-law or ADPCM, so equal payloads give equal files.
    """
    codec = (MULAW, ALAW, IMA_ADPCM)[zlib.crc32(payload) % 3]
    if codec != IMA_ADPCM:
        return write_wave(codec, payload)
    blocks = np.zeros((len(payload) // BLOCK, 4 + BLOCK), np.uint8)
    blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    return write_wave(codec, blocks.tobytes())


def carry_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: every whole text as a telephony file.

    The payload is the text as UTF-8 with bytes 0 up to a positive multiple of 64; a null text is
    empty and gives 64 zero bytes. Every row has its row; an empty table gives none.
    """

    return _texts(docs, doc_id, text).mapInArrow(_carried, CARRIED)


CARRIED = "doc_id long, n_bytes long, media binary"


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def _carried(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1, SLICE):
        raw = utf8(batch.column(1))
        media = [carry(x + b"\0" * (-len(x) % BLOCK or (not x) * BLOCK)) for x in raw]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def carried_and_stored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``store_pcm(carry_texts(docs))`` in one pass: the media column goes from step to step without leaving the worker, a slice at a time."""
    names = ["doc_id", "n_bytes", "media"]
    schema = _with_stored(T._parse_datatype_string(CARRIED))
    return _texts(docs, doc_id, text).mapInArrow(lambda batches: _stored(_carried(batches), names, 2, TARGET_RATE), schema)


def described(stored: DataFrame) -> DataFrame:
    """The digests of ``store_pcm(carry_texts(docs))``, all of what was read back from the stored bytes."""
    payload, media = F.col("payload"), F.col("media")
    return stored.select(
        "doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -BLOCK, BLOCK)).alias("tail_crc32"),
        F.octet_length(media).cast("long").alias("media_bytes"), F.sha2(media, 256).alias("media_sha256"), "feature", "codec", "pcm",
    )


def op4_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to files, files to their payload and stored PCM, digests of those."""
    return described(carried_and_stored(table(spark, sf_dir, "documents", "doc_id", "text")))
