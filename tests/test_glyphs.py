"""Widths out of font files, picks by width, and the budget of text."""

import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deckhouse import cli
from deckhouse.functions import glyphs
from deckhouse.operators import fonts
from deckhouse.plans import synthetic as s
from deckhouse.plans.queries import QUERIES

WIDE = {c: 400 + c % 50 for c in range(32, 127)}


@pytest.mark.parametrize("kind", [4, 6, 12])
def test_widths_of_a_font(spark, kind):
    advances = {c: 100 + c % 900 for c in [*range(32, 100), 200, *range(300, 310), *([0x1F600, 0x1F601] if kind == 12 else [])]}
    rows = [("a.ttf", s.font("Some Face", advances, 2048, kind))]
    got = glyphs.glyph_widths(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert {r.codepoint: r.advance for r in got} == advances and {(r.path, r.family, r.upm, r.error) for r in got} == {("a.ttf", "Some Face", 2048, None)}


def test_other_files(spark):
    """Collections, files that are no fonts, glyphs past the widths, indexed segments, and no rows."""
    one, two = s.font("One", {65: 500}), s.font("Two", {66: 600})
    offset = 20
    moved = lambda data, by: data[:12] + b"".join(struct.pack(">4sLLL", tag, x, at + by, n) for tag, x, at, n in (struct.unpack_from(">4sLLL", data, 12 + 16 * i) for i in range(5))) + data[92:]
    both = struct.pack(">4sLLLL", b"ttcf", 0x10000, 2, offset, offset + len(one)) + moved(one, offset) + moved(two, offset + len(one))
    rows = [("c.ttc", both), ("x.ttf", b"nothing"), ("n.ttf", None), ("t.ttf", one[:120])]
    got = glyphs.glyph_widths(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert [(r.family, r.codepoint, r.advance) for r in got if r.path == "c.ttc"] == [("One", 65, 500), ("Two", 66, 600)]
    assert {r.path: r.error is None for r in got if r.path != "c.ttc"} == {"x.ttf": False, "n.ttf": False, "t.ttf": False}
    indexed = struct.pack(">7H2HH2H2H2H3H", 4, 40, 0, 4, 0, 0, 0, 67, 0xFFFF, 0, 65, 0xFFFF, 0, 1, 4, 0, 7, 0, 9)
    assert [x.tolist() for x in glyphs._mapped(indexed)] == [[65, 67], [7, 9]]
    assert glyphs.glyph_widths(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_batches_hold_many_fonts(monkeypatch):
    """Batches of many small fonts and of broken files, and large fonts in one of their own; rows in the order of the files."""
    monkeypatch.setattr(glyphs, "ROWS", 5000)
    small = [(f"{i}.ttf", s.font(f"F{i}", {65 + k: 100 * i + k for k in range(i % 4)})) if i % 7 else (f"{i}.ttf", b"none") for i in range(200)]
    large = [(f"large{i}.ttf", s.font("Large", {c: 500 + i for c in range(6000)}, kind=12)) for i in range(2)]
    files = [*small, *large, *small]
    batches = [pa.RecordBatch.from_pylist([{"path": p, "content": c} for p, c in part]) for part in (files[:50], files[50:])]
    got = list(glyphs._widths(batches))
    assert len(got) == 3
    want = []
    for path, content in files:
        name, number = path[:-4], int("".join(filter(str.isdigit, path)))
        if content == b"none":
            want.append((path, None, None, None, None, "ValueError: not a font"))
        elif "large" in name:
            want += [(path, "Large", c, 500 + number, 1000, None) for c in range(6000)]
        else:
            want += [(path, f"F{number}", 65 + k, 100 * number + k, 1000, None) for k in range(number % 4)]
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == want


def test_keys_of_fonts_are_dealt_to_tasks(spark):
    """d55 makes its files in as many tasks as a shuffle has, though the table is one small file."""
    assert QUERIES["d55_glyph_widths"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def brute_picks(groups, texts, widths, anchor):
    """Every group's text measured sign by sign, candidates sorted as the rule says."""
    from deckhouse.functions.faces import CANDIDATES

    def width(family, text):
        found = [widths[family][c] for c in text if c in widths[family]]
        return sum(found) / len(found) if found else 0

    out = {}
    for family, paths in groups.items():
        said, total = [], 0
        for p in sorted(paths):
            said.append(texts[p])
            total += len(texts[p])
            if total > 200_000:
                break
        text = " ".join(said)
        text = text if len(text) > 200 else f"{text} {fonts.SAMPLE_TEXT}"
        genre = "grotesque" if "grotesk" in family.lower() else None
        ranked = [(width(n, text) / width(anchor, text), n, k == genre and genre is not None) for n, k in CANDIDATES.items() if n in widths and k not in ("display", "mono")]
        order = sorted(ranked, key=lambda r: (r[0] > 1, not r[2], -r[0] if r[0] <= 1 else r[0]))
        out[family] = (order[0][1], round((order[0][0] - 1) * 100, 6), len(text))
    return out


def test_picks_by_the_text_of_each_group(spark):
    rng = random.Random(2)
    texts = {f"/d{i}": "".join(rng.choice("abcdefghi WQ") for _ in range(rng.choice([10, 500, 150_000]))) for i in range(8)}
    groups = {"Foo": ["/d0", "/d1"], "Akzidenz-Grotesk": list(texts), "Bar": ["/d2"], "Silent": ["/none"]}
    faces = {"Helvetica": {chr(c): w for c, w in WIDE.items()}, **{n: {chr(c): rng.randrange(300, 560) for c in range(32, 127)} for n in ("Inter", "Jost", "Montserrat", "Mulish", "Bebas Neue")}}
    files = spark.createDataFrame([(n, s.font(n, {ord(c): w for c, w in x.items()})) for n, x in faces.items()], "path string, content binary")
    df = spark.createDataFrame([(k, v, len(v)) for k, v in groups.items()], "family string, decks array<string>, deck_count int")
    said = spark.createDataFrame([(p, t, len(t)) for p, t in texts.items()], "path string, text string, chars long")
    got = {r.family: (r.pick, round(r.delta_pct, 6), int(r.why.split()[2])) for r in fonts.recommend_measured(df, said, glyphs.glyph_widths(files), "helvetica").collect()}
    want = brute_picks({k: v for k, v in groups.items() if k != "Silent"}, texts, faces, "Helvetica")
    assert {k: v for k, v in got.items() if k != "Silent"} == want and got["Silent"][2] == len(fonts.SAMPLE_TEXT) + 1
    none = fonts.recommend_measured(df, said, glyphs.glyph_widths(files), "Missing").collect()
    assert {(r.pick, r.why) for r in none} == {(None, "no candidate could be measured")}


def test_fonts_command_picks(spark, tmp_path, capsys):
    (tmp_path / "lib").mkdir()
    theme = {"ppt/theme/theme1.xml": '<a:minorFont><a:latin typeface="Foo Sans"/></a:minorFont>'}
    (tmp_path / "lib/a.pptx").write_bytes(s.deck([s.slide([s.shape(2, "T", "some words " * 40)])], extra=theme))
    (tmp_path / "faces/deep").mkdir(parents=True)
    for name, by in (("Helvetica", 0), ("Inter", -10), ("Jost", 30)):
        (tmp_path / f"faces/deep/{name}.ttf").write_bytes(s.font(name, {c: w + by for c, w in WIDE.items()}))
    (tmp_path / "faces/broken.otf").write_bytes(b"x")
    assert cli.main(["fonts", str(tmp_path / "lib"), "--faces", str(tmp_path / "faces")]) == 0
    line = next(x for x in capsys.readouterr().out.splitlines() if x.startswith("Foo") and "Inter" in x)
    assert line.split("\t")[1:4] == ["1", "Inter", "-2.4%"] and "measured on" in line


@pytest.mark.parametrize("by", [[], ["family"]])
def test_budget_of_any_paths(spark, by):
    """One folder for all decks, ties, nulls: the running sum is that of path order, and slices are even."""
    rng = random.Random(3)
    rows = [(f"f{i % 2}", f"/lib/one/folder/deck {i:06d}.pptx", rng.choice([None, 0, 5, 90])) for i in range(6000)]
    df = spark.createDataFrame(rows, "family string, path string, chars long")
    want = set()
    for family in ("f0", "f1") if by else (None,):
        total = 0
        for f, p, n in sorted(rows, key=lambda r: r[1]):
            if family in (None, f):
                if total > 1000:
                    break
                want.add((*([f] if by else []), p, n or 0, total))
                total += n or 0
    assert {tuple(r) for r in fonts.text_budget(df, 1000, by).collect()} == want
    assert fonts.text_budget(df.limit(0), 1000, by).count() == 0
