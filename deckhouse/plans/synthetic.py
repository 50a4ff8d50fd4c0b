"""Small decks, GIFs and PDF files made from values, for queries over the virtual library and for tests."""

from __future__ import annotations

import io
import struct
import zipfile

P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def shape(spid: int, name: str, *paragraphs: str) -> str:
    lines = "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in paragraphs)
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{spid}" name="{name}"/></p:nvSpPr><p:txBody>{lines}</p:txBody></p:sp>'


def click(spid: int, kind: str = "entr", paragraphs: tuple[int, int] | None = None) -> str:
    aim = f'<p:txEl><p:pRg st="{paragraphs[0]}" end="{paragraphs[1]}"/></p:txEl>' if paragraphs else ""
    return f'<p:par><p:cTn nodeType="clickEffect" presetClass="{kind}"><p:spTgt spid="{spid}">{aim}</p:spTgt></p:cTn></p:par>'


def slide(shapes: list[str], clicks: list[str] = (), hidden: bool = False) -> str:
    timing = f"<p:timing>{''.join(clicks)}</p:timing>" if clicks else ""
    return f'<p:sld {P}{" show=\"0\"" if hidden else ""}><p:cSld><p:spTree>{"".join(shapes)}</p:spTree></p:cSld>{timing}</p:sld>'


def notes(text: str, number: int = 31) -> str:
    lines = "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in text.split("\n"))
    return (
        f'<p:notes {P}><p:cSld><p:spTree><p:sp><p:nvPr><p:ph type="sldImg"/></p:nvPr><p:txBody><a:p><a:r><a:t>{number}</a:t></a:r></a:p></p:txBody></p:sp>'
        f'<p:sp><p:nvPr><p:ph type="body" idx="1"/></p:nvPr><p:txBody>{lines}</p:txBody></p:sp></p:spTree></p:cSld></p:notes>'
    )


def rels(*items: tuple[str, str, str, bool]) -> str:
    """Relationships of (id, type, target, external)."""
    tags = "".join(f'<Relationship Id="{i}" Type="http://x/{t}" Target="{g}"{" TargetMode=\"External\"" if e else ""}/>' for i, t, g, e in items)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{tags}</Relationships>'


def package(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def deck(slides: list[str], slide_rels: dict[int, str] | None = None, extra: dict[str, str | bytes] | None = None, size: tuple[int, int] = (12192000, 6858000), order: list[int] | None = None, embedded: str = "") -> bytes:
    """A package of slides; every slide is related to a layout unless ``slide_rels`` has its own relationships."""
    order = order or list(range(1, len(slides) + 1))
    listed = "".join(f'<p:sldId id="{255 + n}" r:id="rId{n}"/>' for n in order)
    overrides = "".join(f'<Override PartName="/ppt/slides/slide{n}.xml" ContentType="slide"/>' for n in range(1, len(slides) + 1))
    parts: dict[str, str | bytes] = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">{overrides}</Types>',
        "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst>{listed}</p:sldIdLst><p:sldSz cx="{size[0]}" cy="{size[1]}"/>{embedded}</p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(*((f"rId{n}", "slide", f"slides/slide{n}.xml", False) for n in range(1, len(slides) + 1))),
    }
    for n, xml in enumerate(slides, 1):
        parts[f"ppt/slides/slide{n}.xml"] = xml
        parts[f"ppt/slides/_rels/slide{n}.xml.rels"] = (slide_rels or {}).get(n, rels(("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml", False)))
    return package(parts | (extra or {}))


def gif(frames: int) -> bytes:
    """A GIF of 2 x 1 pixels in four grey tones; every frame has a comment, and its pixels as uncompressed codes."""
    screen = b"GIF89a" + (2).to_bytes(2, "little") + (1).to_bytes(2, "little") + bytes([0x81, 0, 0]) + bytes(x for tone in (0, 85, 170, 255) for x in (tone,) * 3)
    comment = b"\x21\xfe\x05frame\x00"
    picture = b"\x2c" + bytes(4) + b"\x02\x00\x01\x00\x00" + b"\x02\x02\x8c\x0a\x00"
    return screen + (comment + picture) * frames + b";"


def pdf(pages: int) -> bytes:
    """A PDF of empty pages with a classic cross-reference table."""
    kids = " ".join(f"{3 + i} 0 R" for i in range(pages))
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {pages} /MediaBox [0 0 720 405] >>", *["<< /Type /Page /Parent 2 0 R >>"] * pages]
    out, places = b"%PDF-1.4\n", []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{n} 0 obj\n{body}\nendobj\n".encode()
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


def font(family: str, advances: dict[int, int], upm: int = 1000, kind: int = 4) -> bytes:
    """A TrueType font that has nothing but the widths of some characters (by code point), with a character map of format 4, 6 or 12."""
    chars = sorted(advances)
    glyph = {c: i + 1 for i, c in enumerate(chars)}
    runs: list[list[int]] = []
    for c in chars:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    if kind == 4:
        parts = [*runs, [0xFFFF, 0xFFFF]]
        n = len(parts)
        words = [4, 16 + 8 * n, 0, 2 * n, 0, 0, 0, *(b for _, b in parts), 0, *(a for a, _ in parts), *((glyph.get(a, 0) - a) & 0xFFFF for a, _ in parts), *[0] * n]
        mapped = struct.pack(f">{len(words)}H", *words)
    elif kind == 6:
        first, last = (chars[0], chars[-1]) if chars else (0, -1)
        mapped = struct.pack(f">5H{last - first + 1}H", 6, 10 + 2 * (last - first + 1), 0, first, last - first + 1, *(glyph.get(c, 0) for c in range(first, last + 1)))
    else:
        mapped = struct.pack(">HHLLL", 12, 0, 16 + 12 * len(runs), 0, len(runs)) + b"".join(struct.pack(">LLL", a, b, glyph[a]) for a, b in runs)
    said = family.encode("utf-16-be")
    tables = {
        b"cmap": struct.pack(">HHHHL", 0, 1, 3, 10 if kind == 12 else 1, 12) + mapped,
        b"head": bytes(18) + struct.pack(">H", upm) + bytes(34),
        b"hhea": bytes(34) + struct.pack(">H", len(chars) + 1),
        b"hmtx": b"".join(struct.pack(">HH", w, 0) for w in [0, *(advances[c] for c in chars)]),
        b"name": struct.pack(">HHH6H", 0, 1, 18, 3, 1, 0x409, 1, len(said), 0) + said,
    }
    at, head, body = 12 + 16 * len(tables), b"", b""
    for tag, data in sorted(tables.items()):
        head += struct.pack(">4sLLL", tag, 0, at + len(body), len(data))
        body += data + bytes(-len(data) % 4)
    return struct.pack(">LHHHH", 0x10000, len(tables), 0, 0, 0) + head + body
