"""Advance widths out of font files (TrueType, OpenType, collections), by Arrow batches.

Only the tables that say how wide a character is are read: ``cmap`` (which glyph a character has; formats 4, 6 and 12), ``hmtx`` with
``hhea`` (how wide glyphs are), ``head`` (units in an em) and ``name``. Variable fonts are read as they are stored, at their default weight.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTHS = "path string, family string, codepoint int, advance int, upm int, error string"
#: (platform, encoding) of character maps in Unicode, the fullest first.
UNICODE = ((3, 10), (0, 6), (0, 4), (3, 1), (0, 3), (0, 2), (0, 1), (0, 0))


class Font:
    """One font of a file; ValueError for anything that is none."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data = data
        if data[at : at + 4] not in (b"\0\1\0\0", b"OTTO", b"true"):
            raise ValueError("not a font")
        (n,) = struct.unpack_from(">H", data, at + 4)
        self.tables = {tag: (start, size) for tag, _, start, size in (struct.unpack_from(">4sLLL", data, at + 12 + 16 * i) for i in range(n))}

    def table(self, tag: bytes) -> bytes:
        start, size = self.tables[tag]
        return self.data[start : start + size]

    def family(self) -> str:
        """The typographic family, or else the family."""
        table = self.table(b"name")
        _, n, base = struct.unpack_from(">HHH", table)
        found = {}
        for i in range(n):
            platform, _, _, what, size, start = struct.unpack_from(">6H", table, 6 + 12 * i)
            if what in (1, 16):
                raw = table[base + start : base + start + size]
                found.setdefault((what != 16, platform != 3), raw.decode("utf-16-be" if platform in (0, 3) else "mac-roman", "replace"))
        return found[min(found)] if found else ""

    def advances(self) -> np.ndarray:
        """Widths by glyph; glyphs beyond the table have its last."""
        (n,) = struct.unpack_from(">H", self.table(b"hhea"), 34)
        return np.frombuffer(self.table(b"hmtx"), ">u2", 2 * n)[::2].astype(np.int64)

    def characters(self) -> tuple[np.ndarray, np.ndarray]:
        """Code points, sorted, and their glyphs; what has glyph 0 has none."""
        table = self.table(b"cmap")
        (n,) = struct.unpack_from(">H", table, 2)
        maps = {(p, e): start for p, e, start in (struct.unpack_from(">HHL", table, 4 + 8 * i) for i in range(n))}
        start = next((maps[k] for k in UNICODE if k in maps), None)
        if start is None:
            raise ValueError("no Unicode character map")
        return _mapped(table[start:])


def _mapped(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    (kind,) = struct.unpack_from(">H", table)
    if kind == 4:
        segments = struct.unpack_from(">H", table, 6)[0] // 2
        whole = np.frombuffer(table, ">u2", len(table) // 2).astype(np.int64)
        ends, starts, deltas, offsets = (whole[a : a + segments] for a in (7, 8 + segments, 8 + 2 * segments, 8 + 3 * segments))
        chars, glyphs = [], []
        for i, (end, first, delta, offset) in enumerate(zip(ends.tolist(), starts.tolist(), deltas.tolist(), offsets.tolist(), strict=True)):
            c = np.arange(first, end + 1)
            if offset:
                where = 8 + 3 * segments + i + offset // 2 + (c - first)
                g = np.where(where < len(whole), whole[np.minimum(where, len(whole) - 1)], 0)
                g = np.where(g > 0, (g + delta) & 0xFFFF, 0)
            else:
                g = (c + delta) & 0xFFFF
            chars.append(c)
            glyphs.append(g)
        chars, glyphs = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (chars, glyphs))
    elif kind == 6:
        first, n = struct.unpack_from(">HH", table, 6)
        chars, glyphs = np.arange(first, first + n), np.frombuffer(table, ">u2", n, 10).astype(np.int64)
    elif kind == 12:
        (n,) = struct.unpack_from(">L", table, 12)
        groups = np.frombuffer(table, ">u4", 3 * n, 16).astype(np.int64).reshape(-1, 3)
        if len(groups) and ((groups[:, 1] < groups[:, 0]).any() or groups[:, 1].max() > 0x10FFFF):
            raise ValueError("broken character map")
        lengths = groups[:, 1] - groups[:, 0] + 1
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        chars, glyphs = (np.repeat(groups[:, i], lengths) + inside for i in (0, 2))
    else:
        raise ValueError(f"character map of format {kind}")
    kept = (glyphs > 0) & (chars != 0xFFFF)
    return chars[kept], glyphs[kept]


def fonts_of(data: bytes) -> Iterator[Font]:
    """The fonts of a file: one, or those of a collection."""
    if data[:4] == b"ttcf":
        (n,) = struct.unpack_from(">L", data, 8)
        for at in struct.unpack_from(f">{n}L", data, 12):
            yield Font(data, at)
    else:
        yield Font(data)


#: Rows of a batch that ``glyph_widths`` gives on, or those of one font if it has more.
ROWS = 1 << 16


def _together(fonts: list[tuple]) -> pa.RecordBatch:
    """One batch of several fonts' (path, family, code points, widths, units, error)."""
    paths, families, chars, widths, units, errors = zip(*fonts, strict=True)
    of = np.repeat(np.arange(len(fonts)), [len(c) for c in chars])
    failed = np.array([e is not None for e in errors])[of]
    each = [pa.array(x, pa.string()).take(pa.array(of)) for x in (paths, families, errors)]
    numbers = [pa.array(x.astype(np.int32), mask=failed) for x in (np.concatenate(chars), np.concatenate(widths), np.array(units)[of])]
    return pa.RecordBatch.from_arrays([*each[:2], *numbers, each[2]], names=[c.split()[0] for c in WIDTHS.split(", ")])


def _fonts(name: str, data: bytes | None) -> Iterator[tuple]:
    """What ``_together`` takes, for each font of a file."""
    try:
        for font in fonts_of(data or b""):
            chars, glyphs = font.characters()
            advances = font.advances()
            (upm,) = struct.unpack_from(">H", font.table(b"head"), 18)
            yield name, font.family(), chars, advances[np.minimum(glyphs, len(advances) - 1)], upm or 1000, None
    except (ValueError, KeyError, IndexError, struct.error) as e:
        yield name, None, np.zeros(1, np.int64), np.zeros(1, np.int64), 0, f"{type(e).__name__}: {e}"


def _widths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fonts have few characters, and a batch costs as much as some of them: batches hold many fonts."""
    held, n = [], 0
    for batch in batches:
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for font in _fonts(name, data):
                held.append(font)
                n += max(1, len(font[2]))
                if n >= ROWS:
                    yield _together(held)
                    held, n = [], 0
    if held:
        yield _together(held)


def glyph_widths(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, family, codepoint, advance, upm, error`` of every character that the fonts in ``files`` have. A file that is no font, null or
    broken has one row with an ``error``; of files that hold several fonts each comes for itself. An empty table gives no rows."""
    return files.select(F.col(path), F.col(content)).mapInArrow(_widths, WIDTHS)
