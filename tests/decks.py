"""A library of decks on disk, after the descriptions in FIXTURES.md."""

from pathlib import Path

from deckhouse.plans import synthetic as s

LAYOUT = s.rels(("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml", False))
THEME = '<a:theme xmlns:a="x"><a:latin typeface="Outside"/><a:majorFont><a:latin typeface="Helvetica"/></a:majorFont><a:minorFont><a:latin typeface="NotARealFontFace"/></a:minorFont></a:theme>'


def fixture(first_hidden: bool = False, embedded: bool = False) -> bytes:
    """Two slides; the first has two click entrances, notes, an animated GIF and a video link."""
    one = s.slide([s.shape(2, "Title", "Fixture"), s.shape(3, "One", "First"), s.shape(4, "Two", "Second")], [s.click(3), s.click(4)], first_hidden)
    rels = s.rels(("rId1", "notesSlide", "../notesSlides/notesSlide1.xml", False), ("rId2", "image", "../media/loop.gif", False), ("rId3", "video", "https://www.youtube.com/watch?v=a&amp;t=1", True), ("rId4", "slideLayout", "../slideLayouts/slideLayout1.xml", False))
    extra = {
        "ppt/theme/theme1.xml": THEME, "ppt/slideLayouts/slideLayout1.xml": '<p:sldLayout xmlns:p="x" xmlns:a="y"><a:latin typeface="+mj-lt"/><a:latin typeface="Wingdings"/></p:sldLayout>',
        "ppt/notesSlides/notesSlide1.xml": s.notes("Fixture speaker notes.\nSecond line."), "ppt/media/loop.gif": s.gif(2), "ppt/media/still.gif": s.gif(1), "ppt/media/odd.xyz": b"?", "ppt/media/fake.gif": b"nothing", "ppt/media/p.png": b"p",
    }
    if embedded:
        extra["ppt/fonts/font1.fntdata"] = b"font"
    return s.deck([one, s.slide([s.shape(2, "Plain", "Plain")])], {1: rels}, extra, embedded='<p:embeddedFontLst><p:embeddedFont><p:font typeface="Graphik"/></p:embeddedFont></p:embeddedFontLst>' if embedded else "")


def hidden() -> bytes:
    """Three slides, the middle one hidden."""
    return s.deck([s.slide([s.shape(2, "A", "a")]), s.slide([s.shape(2, "B", "b")], hidden=True), s.slide([s.shape(2, "C", "c")])])


def library(root: Path) -> Path:
    files = {
        "fixture.pptx": fixture(), "sub/hidden.pptx": hidden(), "sub/none.PPTX": s.deck([]), "broken.pptx": fixture()[:300], "_draft.pptx": hidden(), "_d/x.pptx": fixture(embedded=True),
        "~$lock.pptx": b"lock", "._fork.pptx": b"fork", ".dot.pptx": hidden(), ".git/y.pptx": hidden(), "notes.txt": b"no",
    }
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return root
