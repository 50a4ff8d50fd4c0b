"""Animation of one slide: click steps, what each step hides, and the slide's markup after k clicks.

Markup is cut as bytes at offsets that an XML parser reports, never written anew, because
serialisers drop namespace declarations that the format needs.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

PML = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
#: Children of the shape tree that a step can hide (Q9).
SHAPES = frozenset(("p:sp", "p:grpSp", "p:pic", "p:graphicFrame", "p:cxnSp"))

#: (step from 1, "entr" or "exit", shape id, paragraph or None)
Effect = tuple[int, str, str, int | None]


def _paragraphs(target: ET.Element) -> list[int]:
    """Paragraph indexes of a target; ranges that are no numbers or end before they start count for nothing (Q8)."""
    out: list[int] = []
    for r in target.iter(f"{PML}pRg"):
        try:
            first = int(r.get("st", "0"))
            out += range(first, int(r.get("end", first)) + 1)
        except ValueError:
            continue
    return out


def _effects_of(click: ET.Element) -> Iterator[tuple[str, str, int | None]]:
    for node in click.iter(f"{PML}cTn"):
        kind = node.get("presetClass")
        if kind not in ("entr", "exit"):
            continue
        for target in node.iter(f"{PML}spTgt"):
            if shape := target.get("spid"):
                for paragraph in _paragraphs(target) or [None]:
                    yield kind, shape, paragraph


def click_effects(xml: bytes) -> list[Effect]:
    """TV1: entrances and exits of a slide by click step; none for markup that doesn't parse.

    Steps without an entrance or exit are not numbered.
    """
    try:
        timing = ET.fromstring(xml).find(f"{PML}timing")
    except ET.ParseError:
        return []
    out: list[Effect] = []
    step = 0
    for node in timing.iter(f"{PML}cTn") if timing is not None else ():
        if node.get("nodeType") == "clickEffect" and (effects := list(dict.fromkeys(_effects_of(node)))):
            step += 1
            out += [(step, *e) for e in effects]
    return out


@dataclass
class Shape:
    start: int
    end: int = 0
    spid: str | None = None
    paragraphs: list[tuple[int, int]] = field(default_factory=list)
    #: end tags of the text bodies with the numbers of their paragraphs
    bodies: list[tuple[int, list[int]]] = field(default_factory=list)


class _Layout:
    """Byte ranges of the top-level shapes with their paragraphs, and of the timing and transition elements."""

    def __init__(self, xml: bytes) -> None:
        self.xml, self.shapes, self.dynamic = xml, [], {}
        self.stack: list[str] = []
        self.open: list[int] = []
        self.depth_of_tree = 0
        self.shape: Shape | None = None
        self.body: list[int] | None = None
        self.paragraph = -1
        p = expat.ParserCreate()
        p.StartElementHandler, p.EndElementHandler = self._start, self._end
        self.parser = p
        p.Parse(xml, True)

    def _start(self, name: str, attributes: dict[str, str]) -> None:
        at = self.parser.CurrentByteIndex
        self.stack.append(name)
        self.open.append(at)
        if name == "p:spTree" and not self.depth_of_tree:
            self.depth_of_tree = len(self.stack)
        elif self.depth_of_tree and len(self.stack) == self.depth_of_tree + 1 and name in SHAPES:
            self.shape = Shape(at)
        elif self.shape:
            if name == "p:cNvPr" and self.shape.spid is None and attributes.get("id", "").isdigit():
                self.shape.spid = attributes["id"]
            elif name == "p:txBody":
                self.body = []
            elif name == "a:p" and self.body is not None:
                self.paragraph = at

    def _end(self, name: str) -> None:
        # The parser reports where an end tag starts; of an empty element, where its only tag starts.
        end = self.xml.index(b">", self.parser.CurrentByteIndex) + 1
        start = self.open.pop()
        self.stack.pop()
        if self.shape:
            if name == "a:p" and self.paragraph == start and self.body is not None:
                self.body.append(len(self.shape.paragraphs))
                self.shape.paragraphs.append((start, end))
            elif name == "p:txBody" and self.body is not None:
                self.shape.bodies.append((self.parser.CurrentByteIndex, self.body))
                self.body = None
            elif start == self.shape.start:
                self.shape.end = end
                if self.shape.spid is not None:
                    self.shapes.append(self.shape)
                self.shape = None
        if name in ("p:timing", "p:transition"):
            self.dynamic.setdefault(name, (start, end))
            if start < self.dynamic[name][0]:
                self.dynamic[name] = (start, end)
        if len(self.stack) < self.depth_of_tree:
            self.depth_of_tree = 1 << 30  # only the first shape tree counts


def hidden_at(effects: list[Effect], k: int) -> tuple[set[str], dict[str, set[int]]]:
    """Shapes and paragraphs that are hidden after k clicks.

    Whatever enters after k or has left by k is hidden, without an order among steps (Q10). A shape
    with a hidden paragraph is not hidden whole (Q11).
    """
    shapes: set[str] = set()
    paragraphs: dict[str, set[int]] = defaultdict(set)
    for step, kind, shape, paragraph in effects:
        if (step > k) if kind == "entr" else (step <= k):
            if paragraph is None:
                shapes.add(shape)
            else:
                paragraphs[shape].add(paragraph)
    return shapes - paragraphs.keys(), dict(paragraphs)


def states_of(xml: bytes, effects: list[Effect] | None = None) -> list[bytes]:
    """TV2: the slide after 0, 1, ... clicks, static, without states equal to the one before."""
    effects = click_effects(xml) if effects is None else effects
    layout = _Layout(xml)
    out: list[bytes] = []
    for k in range(max((e[0] for e in effects), default=0) + 1):
        shapes, paragraphs = hidden_at(effects, k)
        cuts: list[tuple[int, int, bytes]] = [(*span, b"") for span in layout.dynamic.values()]
        for shape in layout.shapes:
            if shape.spid in shapes:
                cuts.append((shape.start, shape.end, b""))
            elif gone := paragraphs.get(shape.spid):
                cuts += [(*span, b"") for i, span in enumerate(shape.paragraphs) if i in gone]
                # A text body must keep a paragraph, or the file is taken for damaged.
                cuts += [(at, at, b"<a:p/>") for at, held in shape.bodies if gone.issuperset(held)]
        state, at = [], 0
        for start, end, instead in sorted(cuts):
            if start >= at:
                state += [xml[at:start], instead]
                at = end
        body = b"".join([*state, xml[at:]])
        if not out or body != out[-1]:
            out.append(body)
    return out


_ROOT = re.compile(rb"<p:sld\b[^>]*>")


def is_hidden(xml: bytes) -> bool:
    """The slide's own tag says show="0"."""
    root = _ROOT.search(xml)
    return root is not None and b'show="0"' in root[0]
