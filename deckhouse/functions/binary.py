"""Functions of bytes: GIF frames and notes in PDF files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import types as T

from .rows import by_rows


def _after_blocks(data: bytes, at: int) -> int:
    """Past a chain of counted sub-blocks and its terminator."""
    while at < len(data) and data[at]:
        at += 1 + data[at]
    return at + 1


def _table(flags: int) -> int:
    """Bytes of the colour table that a flags byte announces."""
    return 3 << ((flags & 7) + 1) if flags & 0x80 else 0


def gif_frames(data: bytes | None) -> int | None:
    """P10: number of images in a GIF; null if it has no GIF header. A cut file counts what it has."""
    if not data or data[:6] not in (b"GIF87a", b"GIF89a"):
        return None
    if len(data) < 11:
        return 0
    at, frames = 13 + _table(data[10]), 0
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x2C:  # an image: descriptor, colour table, code size, data
            frames += 1
            flags = data[at + 9] if at + 9 < len(data) else 0
            at = _after_blocks(data, at + 10 + _table(flags) + 1)
        elif data[at] == 0x21:  # an extension
            at = _after_blocks(data, at + 2)
        else:
            at += 1
    return frames


gif_frame_count = by_rows(T.IntegerType())(gif_frames)


class PdfError(ValueError):
    """A file that isn't a PDF with classic cross-reference tables."""


class Ref(NamedTuple):
    number: int
    generation: int


class Raw(bytes):
    """A token kept as it is written: a string, a number, a keyword, a name with its slash."""


_TOKEN = re.compile(rb"(?:[\x00\t\n\f\r ]|%[^\r\n]*)*(<<|>>|[\[\]]|/[^\x00\t\n\f\r ()<>\[\]{}/%]*|<[0-9A-Fa-f\s]*>|\(|[^\x00\t\n\f\r ()<>\[\]{}/%]+)")
_NESTING = re.compile(rb"\\.|[()]", re.S)


class Scanner:
    """Reads PDF objects from bytes: dictionaries as dict, arrays as list, references as Ref, all else as Raw."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at

    def token(self) -> bytes:
        found = _TOKEN.match(self.data, self.at)
        if not found:
            raise PdfError(f"no token at byte {self.at}")
        self.at = found.end()
        if found[1] != b"(":
            return found[1]
        depth, begin = 1, found.start(1)
        while depth:  # a string ends where its brackets balance
            sign = _NESTING.search(self.data, self.at)
            if not sign:
                raise PdfError(f"a string without end at byte {begin}")
            depth += {b"(": 1, b")": -1}.get(sign[0], 0)
            self.at = sign.end()
        return self.data[begin : self.at]

    def value(self, most: int = 100):
        return self._from(self.token(), most)

    def _from(self, token: bytes, most: int):
        if not most:
            raise PdfError("objects nested too deeply")
        if token == b"<<":
            pairs = self._until(b">>", most)
            return dict(zip(pairs[::2], pairs[1::2], strict=False))
        if token == b"[":
            return self._until(b"]", most)
        return Raw(token)

    def _until(self, end: bytes, most: int) -> list:
        out: list = []
        while (token := self.token()) != end:
            if token == b"R" and len(out) > 1:
                generation, number = out.pop(), out.pop()
                out.append(Ref(int(number), int(generation)))
            else:
                out.append(self._from(token, most - 1))
        return out


def pdf_bytes(value) -> bytes:
    """An object as it is written in a file."""
    if isinstance(value, dict):
        return b"<< " + b" ".join(k + b" " + pdf_bytes(v) for k, v in value.items()) + b" >>"
    if isinstance(value, list):
        return b"[" + b" ".join(map(pdf_bytes, value)) + b"]"
    return b"%d %d R" % value if isinstance(value, Ref) else value


class Leaf(NamedTuple):
    """A page: its object and the box that it has or inherits."""

    ref: Ref
    entries: dict
    box: list


_LETTER = [b"0", b"0", b"612", b"792"]


class Pdf:
    """A PDF file with classic cross-reference tables."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        mark = data.rfind(b"startxref")
        if mark < 0:
            raise PdfError("no startxref")
        self.start = int(Scanner(data, mark + 9).token())
        self.places: dict[int, int] = {}
        self.trailer: dict = {}
        for places, trailer in self._revisions():  # the newest comes first, and what it says counts
            self.places = places | self.places
            self.trailer = trailer | self.trailer
        if not isinstance(self.trailer.get(b"/Root"), Ref):
            raise PdfError("the trailer names no catalogue")

    def _revisions(self) -> Iterator[tuple[dict[int, int], dict]]:
        at, met = self.start, set()
        while at not in met:
            met.add(at)
            scan = Scanner(self.data, at)
            if scan.token() != b"xref":
                raise PdfError("no classic cross-reference table (a stream, perhaps)")
            places = {}
            while (word := scan.token()) != b"trailer":
                first, count = int(word), int(scan.token())
                for number in range(first, first + count):
                    place, _, kind = scan.token(), scan.token(), scan.token()
                    if kind == b"n":
                        places[number] = int(place)
            trailer = scan.value()
            yield places, trailer
            if b"/Prev" not in trailer:
                return
            at = int(trailer[b"/Prev"])

    def object(self, value):
        """What a reference refers to (null objects and missing ones: None); any other value is itself."""
        if not isinstance(value, Ref):
            return value
        if value.number not in self.places:
            return None
        scan = Scanner(self.data, self.places[value.number])
        scan.token(), scan.token(), scan.token()  # its number, its generation, obj
        return scan.value()

    def leaves(self) -> Iterator[Leaf]:
        """The pages in order. Boxes are inherited downwards; US letter if no node has one."""
        root = self.object(self.trailer[b"/Root"])
        waiting = [(root.get(b"/Pages"), _LETTER, frozenset())] if isinstance(root, dict) else []
        while waiting:
            ref, box, above = waiting.pop()
            node = self.object(ref)
            if not isinstance(ref, Ref) or not isinstance(node, dict) or ref in above:
                continue
            box = self.object(node.get(b"/MediaBox")) or box
            if node.get(b"/Type") == b"/Page":
                yield Leaf(ref, node, box)
            else:
                waiting += [(kid, box, above | {ref}) for kid in reversed(self.object(node.get(b"/Kids")) or [])]


def pdf_string(text: str) -> bytes:
    """P27."""
    return b"<FEFF" + text.encode("utf-16-be").hex().upper().encode() + b">"


def note_box(box: list) -> list:
    """A square of 20 near the upper left corner of a page."""
    left, top = float(box[0]), float(box[3])
    return [b"%.2f" % x for x in (left + 12, top - 32, left + 32, top - 12)]


def annotate_pdf(data: bytes, notes: dict[int, str]) -> tuple[bytes | None, int]:
    """K8: the file with a text annotation for each page's note, and how many; nothing if none fits.

    An incremental update: the bytes that are there stay, objects that are new or changed follow with a table of their places. Notes
    of pages that the file doesn't have are left out (F8).
    """
    pdf = Pdf(data)
    leaves = list(pdf.leaves())
    if not leaves:
        raise PdfError("no pages")
    free = max(int(pdf.trailer.get(b"/Size", 0)), max(pdf.places, default=0) + 1)
    changed: dict[int, dict | list] = {}
    added = 0
    for page, text in sorted(notes.items()):
        if not 1 <= page <= len(leaves):
            continue
        ref, entries, box = leaves[page - 1]
        note = Ref(free + added, 0)
        added += 1
        changed[note.number] = {
            b"/Type": b"/Annot", b"/Subtype": b"/Text", b"/Rect": note_box(box), b"/Contents": pdf_string(text), b"/T": pdf_string("Speaker notes"),
            b"/Name": b"/Note", b"/C": [b"1", b"0.85", b"0.2"], b"/F": b"4", b"/P": ref,
        }
        listed = entries.get(b"/Annots")
        if isinstance(listed, Ref):  # a list of its own, which stays one
            changed[listed.number] = [*(pdf.object(listed) or []), note]
        else:
            changed[ref.number] = entries | {b"/Annots": [*(listed or []), note]}
    return (pdf_update(pdf, changed, free + added), added) if added else (None, 0)


def pdf_update(pdf: Pdf, changed: dict[int, dict | list], size: int) -> bytes:
    """A revision after the last one: objects, their table in a section for each run of numbers (W11), a trailer."""
    out = bytearray(pdf.data)
    if not out.endswith(b"\n"):
        out += b"\n"
    places = []
    for number in sorted(changed):
        places.append((number, len(out)))
        out += b"%d 0 obj\n%b\nendobj\n" % (number, pdf_bytes(changed[number]))
    table = len(out)
    out += b"xref\n"
    for _, run in groupby(enumerate(places), lambda x: x[1][0] - x[0]):
        section = [place for _, place in run]
        out += b"%d %d\n" % (section[0][0], len(section))
        out += b"".join(b"%010d 00000 n \n" % at for _, at in section)
    trailer = {b"/Size": b"%d" % size, b"/Root": pdf.trailer[b"/Root"], b"/Prev": b"%d" % pdf.start}
    out += b"trailer\n%b\nstartxref\n%d\n%%%%EOF\n" % (pdf_bytes(trailer), table)
    return bytes(out)
