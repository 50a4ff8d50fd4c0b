"""Fates of slide-list entries and forecast states, against the expansion itself."""

from deckhouse.functions import package
from deckhouse.operators import lineage
from deckhouse.plans import synthetic as s

PARTS = "path string, part string, content binary, kind string, steps string, deck string"


def rows(spark, decks):
    return spark.createDataFrame([(p, n, c, "k", "s", "d") for p, parts in decks.items() for n, c in parts.items()], PARTS)


def test_forecast_is_accounted_for(spark):
    built = s.slide([s.shape(2, "T", "t"), s.shape(3, "B", "a", "b")], [s.click(3, paragraphs=(0, 0)), s.click(3, paragraphs=(1, 1))])
    idle = s.slide([s.shape(2, "T", "t")], [s.click(9), s.click(9)])
    shut = s.slide([s.shape(3, "T", "t")], [s.click(3)], hidden=True)
    data = s.deck([built, idle, shut, built, s.slide([s.shape(2, "E", "e")])], order=[1, 2, 3, 5])
    parts = package.Package(data).parts
    got = {r.deck: r for r in lineage.slide_lineage(rows(spark, {"/a": parts})).collect()}["/a"]
    out, expanded = package.expand(data)
    assert got.extra_pages == sum(n - 1 for _, n in expanded) == 2
    assert (got.entries, got.kept, got.unlisted, got.forecast, got.on_hidden, got.on_unlisted, got.collapsed) == (4, 4, 1, 7, 1, 2, 2)


def test_fates(spark):
    listed = '<p:sldIdLst><p:sldId id="1" r:id="rId1"/><p:sldId id="2" r:id="rId2"></p:sldId><p:sldId id="3" r:id="rId3"/><p:sldId id="4" r:id="rId4"/><p:sldId id="5" r:id="rId5"/><p:sldId id="6"/></p:sldIdLst>'
    rels = "".join(f'<Relationship Id="rId{i}" Target="{t}"/>' for i, t in ((1, "slides/slide1.xml"), (2, "slides/slide1.xml"), (4, "/ppt/slides/../x.xml"), (5, "slides/slide7.xml")))
    decks = {
        "/a": {"ppt/presentation.xml": listed.encode(), "ppt/_rels/presentation.xml.rels": rels.encode(), "ppt/slides/slide1.xml": b"<p:sld/>", "ppt/slides/slide2.xml": b"no xml <p:timing", "ppt/slides/slide7.xml": None},
        "/b": {"ppt/presentation.xml": listed.encode()}, "/c": {"other": b"", "ppt/slides/slide1.xml": b""}, None: {"ppt/presentation.xml": listed.encode()},
    }
    got = {r.deck: (r.entries, r.kept, r.unclosed, r.unrelated, r.elsewhere, r.missing, r.unlisted, r.forecast, r.collapsed) for r in lineage.slide_lineage(rows(spark, decks)).collect()}
    # An entry without a relationship number has none; an absolute target loses its slash before it is looked at, so it stays outside slides/.
    assert got == {"/a": (6, 1, 1, 2, 1, 1, 1, 0, 0), "/b": (6, 0, 1, 5, 0, 0, 0, 0, 0), "/c": (0, 0, 0, 0, 0, 0, 1, 0, 0)}
    assert lineage.slide_lineage(spark.createDataFrame([], PARTS)).count() == 0
