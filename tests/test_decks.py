"""Decks on disk: source, audit, notes, media, builds, expansion, validation, PDF notes."""

import io
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from deckhouse.functions import binary, package, slides, xml
from deckhouse.operators import builds, export, library, media, notes, pages
from deckhouse.plans import synthetic as s
from deckhouse.sources import decks as source

from . import decks


@pytest.fixture(scope="session")
def root(tmp_path_factory):
    return decks.library(tmp_path_factory.mktemp("library"))


@pytest.fixture(scope="session")
def parts(spark, root):
    return source.read_parts(spark, str(root), content=r"\.(xml|rels|gif)$").cache()


@pytest.fixture(scope="session")
def records(spark, parts):
    available = library.font_keys(spark.createDataFrame([("Helvetica.ttc",)], "name string"))
    return {r.name: r for r in library.audit(parts, available).collect()}


def test_hidden_rules(spark, root):
    names = lambda hidden, **o: [p.removeprefix(f"{root}/") for p, _ in source.list_decks(str(root), hidden, **o)]
    assert names("audit") == ["_d/x.pptx", "_draft.pptx", "broken.pptx", "fixture.pptx", "sub/hidden.pptx", "sub/none.PPTX"]
    assert names("export") == [".dot.pptx", ".git/y.pptx", "_d/x.pptx", "_draft.pptx", "broken.pptx", "fixture.pptx", "sub/hidden.pptx", "sub/none.PPTX"]
    assert names("audit", only="sub/") == ["sub/hidden.pptx", "sub/none.PPTX"]
    assert len(source.list_decks(f"{root}/fixture.pptx")) == 1
    with pytest.raises(ValueError):
        source.list_decks(f"{root}/notes.txt")
    with pytest.raises(FileNotFoundError):
        source.list_decks(f"{root}/nowhere")


def test_deck_rows_and_partitions(spark, root):
    got = {r.name: r for r in source.read_decks(spark, str(root), partition_bytes="1500").collect()}
    assert {n: r.status for n, r in got.items()} == {"x.pptx": "ok", "_draft.pptx": "ok", "broken.pptx": "unreadable", "fixture.pptx": "ok", "hidden.pptx": "ok", "none.PPTX": "no_slides"}
    assert got["broken.pptx"].error and got["fixture.pptx"].content is None and got["fixture.pptx"].bytes == len(decks.fixture())
    whole = source.read_decks(spark, str(root), content="true", only="fixture").first()
    assert bytes(whole.content) == decks.fixture()
    reader = source.DeckReader({"path": str(root), "partition_bytes": "1500"}, [])
    assert len(reader.partitions()) > 2 and sum(len(p.decks) for p in reader.partitions()) == 6


def test_part_rows(parts):
    rows = {r.part: r for r in parts.where("name = 'fixture.pptx'").collect()}
    assert rows["ppt/media/p.png"].content is None and rows["ppt/media/p.png"].part_bytes == 1  # not asked for, not inflated
    assert bytes(rows["ppt/media/loop.gif"].content) == s.gif(2)
    broken = parts.where("name = 'broken.pptx'").collect()
    assert len(broken) == 1 and broken[0].part is None and broken[0].status == "unreadable"


def test_audit_of_the_fixture(records):
    r = records["fixture.pptx"]
    assert (r.slides, r.width_px, r.height_px, r.aspect, r.animated_slides, r.build_states, r.hidden_slides) == (2, 1280, 720, "16:9", 1, 2, 0)
    assert (r.gifs, r.videos, r.audio, r.media_bytes, r.noted_slides, r.notes_chars, r.error) == (1, 0, 0, len(s.gif(2)), 1, 35, None)
    assert r.fonts == ["Helvetica", "NotARealFontFace"] and r.fonts_missing == ["NotARealFontFace"] and r.fonts_embedded == []
    assert [tuple(x) for x in r.external_media] == [(1, "https://www.youtube.com/watch?v=a&t=1")]


def test_audit_of_the_others(records):
    assert (records["hidden.pptx"].slides, records["hidden.pptx"].hidden_slides, records["hidden.pptx"].noted_slides) == (3, 1, 0)
    assert (records["none.PPTX"].slides, records["none.PPTX"].error) == (0, None)
    assert records["broken.pptx"].error.startswith("BadZipFile") and records["broken.pptx"].slides == 0 and records["broken.pptx"].aspect is None
    assert records["x.pptx"].fonts_embedded == ["Graphik"]
    assert records["hidden.pptx"].duplicate_of == records["_draft.pptx"].path and records["_draft.pptx"].duplicate_of is None
    assert {n: r.duplicate_group_size for n, r in records.items()} == {"_draft.pptx": 2, "hidden.pptx": 2, "x.pptx": 1, "broken.pptx": 1, "fixture.pptx": 1, "none.PPTX": 1}


def test_summary(spark, parts):
    available = spark.createDataFrame([("helvetica",)], "key string")
    r = library.summary(library.audit(parts, available)).first()
    assert (r.decks, r.slides, r.unreadable, r.font_risk_decks, r.decks_embedding_fonts, r.animated_decks, r.build_states) == (6, 10, 1, 2, 1, 2, 4)
    assert (r.hidden_slides, r.decks_with_hidden, r.external_media, r.redundant_copies, r.oversized_decks) == (2, 2, 2, 1, 0)
    assert [tuple(x) for x in library.missing_faces(library.audit(parts, available)).collect()] == [("NotARealFontFace", 2)]


@pytest.mark.parametrize("ratio, label", [(16 / 9, "16:9"), (4 / 3, "4:3"), (2**0.5, "A4"), (1.005, "1.00:1"), (2.675, "2.67:1"), (None, None)])
def test_aspects(spark, ratio, label):
    assert spark.createDataFrame([(ratio,)], "r double").select(library.aspect(F.col("r"))).first()[0] == label


# ---------------------------------------------------------------- builds

BULLETS = s.slide([s.shape(2, "Title", "t"), s.shape(3, "Body", "a", "b", "c", "d")], [s.click(3, paragraphs=(i, i)) for i in range(4)]).encode()


def test_click_effects():
    one = zipfile.ZipFile(io.BytesIO(decks.fixture())).read("ppt/slides/slide1.xml")
    assert slides.click_effects(one) == [(1, "entr", "3", None), (2, "entr", "4", None)]
    assert slides.click_effects(BULLETS) == [(i + 1, "entr", "3", i) for i in range(4)]
    odd = s.slide([s.shape(3, "x", "y")], [s.click(3, paragraphs=(3, 1)), s.click(3, "emph"), s.click(3, "exit")]).encode()
    assert slides.click_effects(odd) == [(1, "entr", "3", None), (2, "exit", "3", None)]  # a bad range hides the shape; emphasis is no step
    assert slides.click_effects(b"<p:sld") == [] and slides.click_effects(s.slide([]).encode()) == []


def test_states_of_paragraphs():
    states = slides.states_of(BULLETS)
    assert [x.count(b"<a:p>") for x in states] == [1, 2, 3, 4, 5] and all(b"p:timing" not in x for x in states)
    only = s.slide([s.shape(3, "Body", "a", "b", "c")], [s.click(3, paragraphs=(i, i)) for i in range(3)]).encode()
    states = slides.states_of(only)
    assert len(states) == 4 and b"<p:txBody><a:p/></p:txBody>" in states[0] and states[3].count(b"<a:t>") == 3
    assert not any(re.search(rb"<p:txBody></p:txBody>", x) for x in states)


def test_dead_steps_make_one_state():
    dead = s.slide([s.shape(2, "x", "y")], [s.click(99)] * 3).encode()
    assert len(slides.click_effects(dead)) == 3 and len(slides.states_of(dead)) == 1


def test_exit_and_reentry():
    effects = [(1, "exit", "3", None), (2, "entr", "3", None)]
    assert [slides.hidden_at(effects, k)[0] for k in range(3)] == [{"3"}, {"3"}, {"3"}]  # Q10
    both = [(1, "entr", "3", None), (2, "entr", "3", 0)]
    assert slides.hidden_at(both, 0) == (set(), {"3": {0}})  # Q11


def test_hide_sets_agree_with_states(spark):
    import random

    rng = random.Random(4)
    rows = [(d, step, rng.choice(["entr", "exit"]), str(rng.randrange(4)), rng.choice([None, None, 0, 1])) for d in range(30) for step in range(1, rng.randrange(2, 7))]
    got = {(r.deck, r.state, r.shape) for r in builds.hide_sets(spark.createDataFrame(rows, "deck int, step int, kind string, shape string, paragraph int")).collect()}
    want = set()
    for d in range(30):
        mine = [r[1:] for r in rows if r[0] == d]
        for k in range(max(r[0] for r in mine) + 1):
            want |= {(d, k, x) for x in slides.hidden_at(mine, k)[0]}
    assert got == want


def test_expansion():
    out, expanded = package.expand(decks.fixture())
    assert expanded == [(1, 3)] and package.faults(out) == []
    new = package.Package(out)
    assert sum(bool(package.SLIDE.fullmatch(n)) for n in new.parts) == 4
    ids = re.findall(r'<p:sldId id="(\d+)"', new.text(package.PRESENTATION))
    assert len(ids) == len(set(ids)) == 4
    base = new.text("ppt/slides/slide1.xml")
    assert 'name="One"' not in base and 'name="Title"' in base and "p:timing" not in base
    assert "notesSlide" in new.text("ppt/slides/_rels/slide1.xml.rels") and "notesSlide" not in new.text("ppt/slides/_rels/slide3.xml.rels")
    assert [p for p, _ in new.slides()] == [f"ppt/slides/slide{n}.xml" for n in (1, 3, 4, 2)]
    assert package.expand(decks.fixture(first_hidden=True)) == (decks.fixture(first_hidden=True), []) and package.expand(decks.hidden())[1] == []
    assert len(package.variants(decks.fixture(), "ppt/slides/slide1.xml")) == 3


def test_validator():
    good, _ = package.expand(decks.fixture())

    def broken(part, change):
        p = package.Package(good)
        p.parts[part] = change(p.parts[part])
        return [m for _, m in package.faults(p.write())]

    assert package.faults(good) == []
    assert any("no paragraphs" in m for m in broken("ppt/slides/slide1.xml", lambda x: re.sub(rb"<a:p>.*?</a:p>", b"", x)))
    assert any("well-formed" in m for m in broken("ppt/slides/slide1.xml", lambda x: x.replace(b"</p:sld>", b"")))
    assert any("slide layout" in m for m in broken("ppt/slides/_rels/slide1.xml.rels", lambda x: b"<Relationships/>"))
    assert any("twice" in m for m in broken(package.PRESENTATION, lambda x: x.replace(b'r:id="rId2"', b'r:id="rId1"')))
    assert any("nothing" in m for m in broken(package.PRESENTATION, lambda x: x.replace(b'r:id="rId2"', b'r:id="rId99"')))
    assert any("missing part" in m for m in broken(package.PRESENTATION_RELS, lambda x: x.replace(b"slide2.xml", b"slide77.xml")))
    assert any("override" in m for m in broken(package.TYPES, lambda x: x.replace(b"slide2.xml", b"s.xml")))
    assert [r for r, _ in package.faults(b"no zip")] == ["V1"]


def test_package_functions_on_columns(spark, root):
    whole = source.read_decks(spark, str(root), content="true")
    got = {r.name: r for r in whole.select("name", builds.expansion("content").alias("x"), builds.without_fonts("content").alias("f"), builds.deck_faults("content").alias("v")).where("name <> 'broken.pptx'").collect()}
    assert [(e.slide, e.pages) for e in got["fixture.pptx"].x.expanded] == [(1, 3)] and got["fixture.pptx"].x.faults == []
    assert got["x.pptx"].f.removed == 1 and got["fixture.pptx"].f.deck is None and got["hidden.pptx"].v == []
    stripped = package.Package(bytes(got["x.pptx"].f.deck))
    assert not any("font" in n for n in stripped.parts) and "embeddedFont" not in stripped.text(package.PRESENTATION) and len(stripped.slides()) == 2
    broken = whole.where("name = 'broken.pptx'").select(builds.expansion("content").alias("x")).first()
    assert broken.x.error and broken.x.deck is None


# ---------------------------------------------------------------- pages, notes, media


def test_page_map_and_notes(spark, parts):
    found = notes.presentation_slides(parts.where("name = 'fixture.pptx'"))
    expanded = found.where("slide_no = 1").select("deck", "slide_no", F.lit(3).alias("n_states"))
    page_map = pages.page_map(found, expanded)
    assert [tuple(r)[1:] for r in page_map.orderBy("page").collect()] == [(1, 1, 0, 3), (2, 1, 1, 3), (3, 1, 2, 3), (4, 2, None, None)]
    got = {r.page: r.text for r in notes.notes_on_pages(parts.where("name = 'fixture.pptx'"), page_map).collect()}
    assert sorted(got) == [1, 2, 3] and got[2].startswith("[build 1 of 2]\nFixture speaker notes.") and "7" not in got[1]
    plain = notes.notes_on_pages(parts.where("name = 'fixture.pptx'"))
    assert json.loads(notes.notes_json(plain).first().json) == {"1": "Fixture speaker notes.\nSecond line."}


def test_hidden_slides_shift_pages(spark, parts):
    found = notes.presentation_slides(parts.where("name = 'hidden.pptx'"))
    assert [(r.slide_no, r.page) for r in pages.page_of(found).orderBy("page").collect()] == [(1, 1), (3, 2)]


def test_order_of_the_list_counts(spark, tmp_path):
    note = s.notes("On the first page &amp; &eacute;")
    rel = s.rels(("rId1", "notesSlide", "../notesSlides/notesSlide9.xml", False), ("rId2", "slideLayout", "../slideLayouts/l.xml", False))
    (tmp_path / "d.pptx").write_bytes(s.deck([s.slide([]), s.slide([])], {2: rel}, {"ppt/notesSlides/notesSlide9.xml": note}, order=[2, 1]))
    p = source.read_parts(spark, str(tmp_path))
    assert [(r.slide_no, r.text) for r in notes.slide_notes(p).collect()] == [(1, "On the first page & é")]


def test_labels(spark):
    rows = [("d", 1, 1, None, None), ("d", 2, 2, 0, 10), ("d", 3, 2, 9, 10), ("d", 4, 3, None, None), ("e", 1, 100, 0, 2)]
    got = pages.labels(spark.createDataFrame(rows, "deck string, page int, slide int, state int, of int"))
    assert [r.label for r in got.orderBy("deck", "page").collect()] == ["01", "02.01", "02.10", "03", "100.01"]
    boxes = spark.createDataFrame([("d", 1, 720.0, 405.0), ("d", 2, 0.0, 5.0), ("e", 2, 3.0, 6.0)], "deck string, page int, box_width double, box_height double")
    images = pages.image_names(boxes, got, "x", 1000).orderBy("deck").collect()
    assert [(r.file, r.width, r.height) for r in images] == [("x-01.png", 1000, 563), ("x-02.png", 500, 1000)]


def test_media(spark, parts):
    mine = parts.where("name = 'fixture.pptx'")
    items = {r.source: r for r in media.extract_media(mine).collect()}
    assert {n: (r.kind, r.slides, r.frames) for n, r in items.items()} == {"loop.gif": ("animated-gif", [1], 2), "fake.gif": ("animated-gif", [], None), "odd.xyz": ("other", [], None)}
    assert items["loop.gif"].file == "fixture-slide001-loop.gif" and items["odd.xyz"].file == "fixture-unplaced-odd.xyz"
    assert {r.source for r in media.extract_media(mine, all_gifs=True).collect()} == {"loop.gif", "fake.gif", "odd.xyz", "still.gif"}
    rels = mine.where("part like '%/_rels/slide1.xml.rels'").select(F.col("path").alias("deck"), F.lit(1).alias("slide"), F.decode("content", "UTF-8").alias("xml"))
    links = media.external_links(rels)
    assert [(r.slide, r.url) for r in links.collect()] == [(1, "https://www.youtube.com/watch?v=a&t=1")]
    listed = json.loads(media.media_json(media.extract_media(mine), links).first().json)
    assert listed["deck"] == "fixture.pptx" and len(listed["items"]) == 3 and len(listed["external"]) == 1


def test_gif_frames():
    assert [binary.gif_frames(s.gif(n)) for n in (0, 1, 2, 7)] == [0, 1, 2, 7]
    assert binary.gif_frames(b"PNG") is None and binary.gif_frames(None) is None and binary.gif_frames(s.gif(3)[:45]) == 1 and binary.gif_frames(b"GIF89a") == 0


def test_pdf_notes(spark):
    data = s.pdf(4)
    out, added = binary.annotate_pdf(data, {1: "One", 3: "Drei é 🙂", 9: "none"})
    assert added == 2 and out.startswith(data) and len(out) - len(data) < 4096 and out.count(b"/Subtype /Text") == 2 and b"/Prev" in out
    twice, added = binary.annotate_pdf(out, {1: "again", 2: "two"})
    assert added == 2 and twice.startswith(out)
    leaves = list(binary.Pdf(twice).leaves())
    assert len(leaves) == 4 and [float(x) for x in leaves[1].box] == [0, 0, 720, 405]
    assert len(leaves[0].entries[b"/Annots"]) == 2 and [len(p.entries.get(b"/Annots", [])) for p in leaves] == [2, 1, 1, 0]
    note = binary.Pdf(twice).object(leaves[1].entries[b"/Annots"][0])
    assert note[b"/P"] == leaves[1].ref and note[b"/Rect"] == [b"12.00", b"373.00", b"32.00", b"393.00"] and note[b"/Contents"] == binary.pdf_string("two")
    assert binary.annotate_pdf(data, {7: "x"}) == (None, 0)
    for bad in (b"no pdf", data.replace(b"xref\n0", b"stream")):
        with pytest.raises(ValueError):
            binary.annotate_pdf(bad, {1: "x"})
    df = spark.createDataFrame([(data, {1: "a"}), (b"bad", {1: "a"})], "pdf binary, notes map<int,string>").select(builds.annotated("pdf", "notes").alias("x"))
    assert sorted((r.x.added, r.x.error) for r in df.collect()) == [(0, "PdfError: no startxref"), (1, None)]


def test_pdf_objects():
    scan = binary.Scanner(b"<< /A [1 0 R (a\\)(b)) <0A> -1.5 /N] % no\n/B << /C true >> /D 2 0 R >>x", 0)
    got = scan.value()
    assert got == {b"/A": [binary.Ref(1, 0), b"(a\\)(b))", b"<0A>", b"-1.5", b"/N"], b"/B": {b"/C": b"true"}, b"/D": binary.Ref(2, 0)}
    assert binary.Scanner(binary.pdf_bytes(got), 0).value() == got
    for bad in (b"[" * 500, b"(a", b"<< /A"):
        with pytest.raises(binary.PdfError):
            binary.Scanner(bad, 0).value()


def test_annotations_in_a_list_of_their_own():
    """A page whose list of annotations is an object keeps it there; boxes come from the nearest node above."""
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R 6 0 R] /Count 2 /MediaBox [0 0 100 50] >>", "<< /Type /Pages /Kids [4 0 R] /MediaBox [10 0 200 80] >>", "<< /Type /Page /Annots 5 0 R >>", "[7 0 R]", "<< /Type /Page /MediaBox [1 2 3 64] >>", "<< /Type /Annot >>"]
    data, places = b"%PDF-1.4\n", []
    for n, body in enumerate(objects, 1):
        places.append(len(data))
        data += f"{n} 0 obj\n{body}\nendobj\n".encode()
    data += f"xref\n0 1\n0000000000 65535 f \n1 7\n{''.join(f'{p:010d} 00000 n {chr(10)}' for p in places)}trailer << /Size 8 /Root 1 0 R >>\nstartxref\n{len(data)}\n%%EOF".encode()
    out, added = binary.annotate_pdf(data, {1: "a", 2: "b"})
    pdf = binary.Pdf(out)
    one, two = pdf.leaves()
    assert added == 2 and one.entries[b"/Annots"] == binary.Ref(5, 0) and pdf.object(one.entries[b"/Annots"]) == [binary.Ref(7, 0), binary.Ref(8, 0)]
    assert one.box[0] == b"10" and pdf.object(binary.Ref(8, 0))[b"/Rect"][0] == b"22.00" and two.entries[b"/Annots"] == [binary.Ref(9, 0)] and pdf.object(binary.Ref(9, 0))[b"/Rect"][1] == b"32.00"


def test_first_note(spark):
    def part(*bodies):
        shapes = "".join(f'<p:sp><p:ph type="{kind}"/>' + "".join("<a:p>" + "".join(f"<a:r><a:t>{t}</a:t></a:r>" for t in runs) + "</a:p>" for runs in lines) + "</p:sp>" for kind, lines in bodies)
        return f"<p:notes>{shapes}</p:notes>"

    cases = {part(("sldImg", [["no"]]), ("body", [["7"]]), ("body", [[" a", "&amp;b "], ["&nbsp;"], ["&lt;a:t&gt;"]])): "a&b\n<a:t>", part(("body", [["&#49;&#50;"]])): "", "": "", None: "", part(("body", [["x&eacute;"]]), ("body", [["y"]])): "xé"}
    df = spark.createDataFrame([(x, i) for i, x in enumerate(cases)], "xml string, i int")
    assert [r.t for r in df.select(notes.first_note(xml.body_runs(F.col("xml"))).alias("t"), "i").orderBy("i").collect()] == list(cases.values())


# ---------------------------------------------------------------- plan of a library


def test_export_plan_of_a_library(spark, root):
    found = source.read_decks(spark, str(root), hidden="export", only="sub").select("path", "status")
    plan = {r.path.removeprefix(f"{root}/"): r for r in export.export_plan(found, "mirror", f"{root}/", "/out//").collect()}
    assert plan["sub/hidden.pptx"].dest == "/out/sub/hidden (export)" and plan["sub/hidden.pptx"].action == "export"
    assert (plan["sub/none.PPTX"].action, plan["sub/none.PPTX"].reason) == ("skip", "no slides")
