"""Rendering plans, export through a plugged-in renderer, texts to measure."""

from pyspark.sql import functions as F

from deckhouse.functions import package
from deckhouse.operators import fonts, notes, render
from deckhouse.plans import synthetic as s
from deckhouse.sources import decks as source

from . import decks


def fussy(data: bytes) -> bytes | None:
    """Renders a page for each slide; refuses embedded fonts, and expanded decks of three slides or more by an error."""
    p = package.Package(data)
    if any(package.FONT.fullmatch(n) for n in p.parts):
        return None
    if b"slide3.xml" in p.parts[package.TYPES] and b'name="Two"' in p.parts["ppt/slides/slide1.xml"]:
        raise RuntimeError("dialog")
    return s.pdf(len(p.slides()))


def test_export_through_a_renderer(spark):
    plain = s.deck([s.slide([s.shape(2, "A", "a")])])
    rows = [("a", decks.fixture()), ("b", decks.fixture(embedded=True)), ("c", plain), ("d", b"broken"), ("e", None)]
    got = {r.path: r for r in render.export_decks(spark.createDataFrame(rows, "path string, content binary"), fussy).collect()}
    assert {p: (r.status, r.recovery, r.attempts) for p, r in got.items()} == {"a": ("ok", None, 1), "b": ("ok", "fonts stripped", 3), "c": ("ok", None, 1), "d": ("fail", None, 2), "e": ("fail", None, 2)}
    assert [(x.slide, x.pages) for x in got["a"].expanded] == [(1, 3)] and got["c"].expanded == []
    flat = render.export_decks(spark.createDataFrame([("a", decks.fixture())], "path string, content binary"), lambda d: None if b"slide4.xml" in package.Package(d).parts[package.TYPES] else b"%PDF").first()
    assert (flat.status, flat.recovery, flat.feed, flat.expanded) == ("ok", "build states flattened", "flat", [])


def test_render_plan(spark, tmp_path):
    for name in ("x/a.pdf", "y/b.pdf", "y/images/b-01.jpg", "x/images/a-01.png", "z.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    pdfs = render.archive(spark, str(tmp_path))
    images = spark.createDataFrame([(str(p),) for p in tmp_path.rglob("images/*")], "path string")
    stems = lambda **o: [r.stem for r in render.render_plan(pdfs, images, **o).orderBy("path").collect()]
    assert stems() == ["b"] and stems(image_format="jpeg") == ["a"] and stems(force=True) == ["a", "b"]
    assert render.archive(spark, str(tmp_path), only="y/").count() == 1
    (tmp_path / "labels.txt").write_text("01\n\n03")
    assert [(r.page, r.label) for r in render.read_labels(spark, str(tmp_path / "labels.txt")).collect()] == [(1, "01"), (2, ""), (3, "03")]
    pages = spark.createDataFrame([(1,), (2,)], "page int")
    assert render.only_page(pages, 2).count() == 1 and render.only_page(pages, None).count() == 2


def test_sample_text(spark, tmp_path):
    (tmp_path / "a.pptx").write_bytes(s.deck([s.slide([s.shape(2, "T", "one", "two")]), s.slide([s.shape(2, "T", "x" * 300)])]))
    (tmp_path / "b.pptx").write_bytes(s.deck([s.slide([s.shape(2, "T", "later")])]))
    texts = fonts.deck_texts(source.read_parts(spark, str(tmp_path)))
    assert fonts.sample_text(texts, 10).first().text == "one two " + "x" * 300
    assert fonts.sample_text(texts).first().text.endswith("x later")
    assert fonts.sample_text(texts.where("path like '%b.pptx'")).first().text == "later " + fonts.SAMPLE_TEXT
    labels = spark.createDataFrame([("Graphik", ["a", "b", "c"], -3.04), ("Inter", ["a"], None)], "f string, faces array<string>, d double")
    assert [r[0] for r in labels.select(fonts.group_label(F.col("f"), F.col("faces"), F.col("d"))).collect()] == ["Graphik +2 weights  -3.0% width", "Inter"]


def test_notes_total(spark):
    rows = spark.createDataFrame([("d", 1, "[build 0 of 2]\nab"), ("d", 2, "é")], "deck string, page int, text string")
    assert tuple(notes.notes_total(rows).first()) == ("d", 2, 18)
