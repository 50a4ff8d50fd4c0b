"""Sinks, commands and the incremental ingest, on a library on disk."""

import json

import pytest
from pyspark.sql import functions as F

from deckhouse import cli
from deckhouse.functions import package
from deckhouse.operators import notes, pages, sinks
from deckhouse.sources import decks as source
from deckhouse.streaming import ingest

from . import decks


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return decks.library(tmp_path_factory.mktemp("cli"))


def test_audit_command(spark, root, tmp_path, capsys):
    (tmp_path / "fonts.txt").write_text("Helvetica.ttc\nNotARealFontFace.otf\n")
    assert cli.main(["audit", str(root), "--json", str(tmp_path / "out"), "--fonts", str(tmp_path / "fonts.txt")]) == 0
    said = capsys.readouterr().out
    assert said.startswith("6 decks, 10 slides") and "0 decks miss fonts" in said and "1 decks that can't be read" in said
    records = [json.loads(json.loads(line)["json"]) for f in (tmp_path / "out").glob("*.json") for line in f.read_text().splitlines()]
    assert len(records) == 6 and {r["error"] is None for r in records} == {True, False} and all(len(r) == 23 for r in records)


def test_documents_copies_and_dropped(spark, tmp_path, capsys):
    root = tmp_path / "in"
    root.mkdir()
    for name in ("a", "b"):
        (root / f"{name}.pptx").write_bytes(decks.fixture())
    (root / "c.pptx").write_bytes(decks.hidden())
    assert cli.main(["audit", str(root), "--document", str(tmp_path / "all.json")]) == 0
    whole = json.loads((tmp_path / "all.json").read_text())
    assert whole["summary"]["decks"] == 3 and [d["path"].rpartition("/")[2] for d in whole["decks"]] == ["a.pptx", "b.pptx", "c.pptx"] and whole["decks"][1]["duplicate_of"].endswith("a.pptx")
    capsys.readouterr()
    assert cli.main(["copies", str(root)]) == 0
    assert [[x.rpartition("/")[2] for x in line.split("\t")[:3]] for line in capsys.readouterr().out.splitlines()] == [["a.pptx", "", "2"], ["b.pptx", "a.pptx", "2"]]
    assert cli.main(["dropped", str(root)]) == 0
    head, *rows = [line.split("\t") for line in capsys.readouterr().out.splitlines()]
    assert [dict(zip(head, r, strict=True))["extra_pages"] for r in rows] == ["2", "2", "0"]
    assert cli.main(["help"]) == 0 and "dropped" in capsys.readouterr().out and cli.main(["version"]) == 0


def test_other_commands(spark, root, tmp_path, capsys):
    assert cli.main(["plan", str(root), "--out", "/out", "--only", "sub"]) == 0
    assert "/out/sub/hidden (export)" in capsys.readouterr().out
    assert cli.main(["plan", str(root), "--out", "/out"]) == 1  # a broken deck
    assert cli.main(["plan", str(root / "nowhere"), "--out", "/out"]) == 2 and cli.main(["plan", str(root)]) == 2
    assert cli.main(["fonts", str(root)]) == 0 and "NotARealFontFace" in capsys.readouterr().out
    assert cli.main(["expand", str(root), "--out", str(tmp_path / "x"), "--only", "fixture"]) == 0
    assert package.faults((tmp_path / "x/fixture (expanded).pptx").read_bytes()) == []
    assert cli.main(["media", str(root), "--out", str(tmp_path / "m")]) == 0 and (tmp_path / "m/fixture-slide001-loop.gif").exists()
    assert cli.main(["notes", str(root)]) == 0 and cli.main(["map", str(root)]) == 0
    assert "Fixture speaker notes." in capsys.readouterr().out


def test_written_outputs(spark, tmp_path, capsys):
    """Folders with signs of regular expressions, catalogues of faces, variants, page maps and JSON outputs."""
    root = tmp_path / "decks (2024) c++"
    root.mkdir()
    (root / "one.pptx").write_bytes(decks.fixture())
    assert cli.main(["expand", str(root), "--out", str(tmp_path / "x")]) == 0
    assert sorted(p.name for p in (tmp_path / "x").iterdir()) == ["one (expanded).pages.json", "one (expanded).pptx"]
    found = json.loads((tmp_path / "x/one (expanded).pages.json").read_text())
    assert [p["slide"] for p in found["pages"]] == [1, 1, 1, 2] and found["expanded_slides"] == [{"slide": 1, "pages": 3}]
    assert cli.main(["variants", str(root), "--slide", "1", "--out", str(tmp_path / "v")]) == 0 and len(list((tmp_path / "v").iterdir())) == 3
    assert cli.main(["variants", str(root), "--slide", "9", "--out", str(tmp_path / "w")]) == 0 and not (tmp_path / "w").exists()
    (tmp_path / "office.txt").write_text("/office/NotARealFontFace.ttf\n")
    (tmp_path / "ours.txt").write_text("/own/Helvetica.otf\n")
    assert cli.main(["fonts", str(root), "--office", str(tmp_path / "office.txt"), "--ours", str(tmp_path / "ours.txt"), "--json", str(tmp_path / "f")]) == 0
    plan = [json.loads(line) for f in (tmp_path / "f").glob("*.json") for line in f.read_text().splitlines()]
    assert {p["face"]: (p["verdict"], p.get("kind"), p.get("detail")) for p in plan} == {"NotARealFontFace": ("alias", "office", "NotARealFontFace"), "Helvetica": ("alias", "installed", "Helvetica.otf")}
    for command in (["plan", str(root), "--out", "/o", "--json", str(tmp_path / "p")], ["map", str(root), "--json", str(tmp_path / "q")]):
        assert cli.main(command) == 0 and list(__import__("pathlib").Path(command[-1]).glob("*.json"))


def draw(data: bytes) -> bytes:
    """A renderer for the export command: a PDF with a page for each slide."""
    from deckhouse.plans import synthetic

    return synthetic.pdf(len(package.Package(data).slides()))


def test_export_and_render_commands(spark, tmp_path, capsys):
    root = tmp_path / "in"
    root.mkdir()
    (root / "one.pptx").write_bytes(decks.fixture())
    out, manifest = tmp_path / "out", str(tmp_path / "manifest")
    command = ["export", str(root), "--out", str(out), "--renderer", "tests.test_cli:draw", "--manifest", manifest]
    assert cli.main(command) == 0
    data = (out / "one (export)/one.pdf").read_bytes()
    assert data.count(b"/Subtype /Text") == 3 and len(list(__import__("deckhouse.functions.binary").functions.binary.Pdf(data).leaves())) == 4
    assert (out / "one (export)/media/one-slide001-loop.gif").exists() and sinks.read_manifest(spark, manifest).count() == 1
    capsys.readouterr()
    assert cli.main(command) == 0 and "one.pptx" not in capsys.readouterr().out  # done before
    assert cli.main(["export", str(root), "--out", str(out), "--renderer", "no.such:module"]) == 2
    assert json.loads((out / "one (export)/slides.json").read_text())["expanded_slides"] == [{"slide": 1, "pages": 3}]
    assert cli.main(["render", str(out)]) == 0
    listed = [line.split("\t") for line in capsys.readouterr().out.splitlines()]
    assert [line[1:5] for line in listed] == [[str(i), f"one-{n}.png", "1920", "1080"] for i, n in enumerate(("01.01", "01.02", "01.03", "02"), 1)] and listed[0][0].endswith("one.pdf")
    (tmp_path / "labels.txt").write_text("a\n\nc")
    assert cli.main(["render", str(out), "--edge", "720", "--format", "jpeg", "--labels", str(tmp_path / "labels.txt")]) == 0
    assert [line.split("\t")[2:5] for line in capsys.readouterr().out.splitlines()] == [[f"one-{n}.jpg", "720", "405"] for n in ("a", "02", "c", "04")]
    assert cli.main(["render", str(out), "--page", "4"]) == 0 and [line.split("\t")[2] for line in capsys.readouterr().out.splitlines()] == ["one-02.png"]
    (out / "bad.pdf").write_bytes(b"no pdf")
    assert cli.main(["render", str(out), "--only", "bad"]) == 1 and "no startxref" in capsys.readouterr().out
    (out / "bad.pdf").unlink()
    assert cli.main(["render", str(out), "--edge", "0"]) == 2
    (out / "one (export)/images").mkdir()
    (out / "one (export)/images/one-01.png").write_bytes(b"x")
    assert cli.main(["render", str(out)]) == 0 and "one.pdf" not in capsys.readouterr().out
    assert cli.main(["render", str(out), "--force"]) == 0 and "one.pdf" in capsys.readouterr().out


def test_page_maps_round_trip(spark, root, tmp_path):
    slides = notes.presentation_slides(source.read_parts(spark, str(root), only="fixture"))
    expanded = slides.where("slide_no = 1").select("deck", "slide_no", F.lit(3).alias("n_states"))
    found = sinks.page_map_json(pages.page_map(slides, expanded), expanded).first().json
    (tmp_path / "slides.json").write_text(json.dumps(json.loads(found), indent=1))
    (tmp_path / "bad.json").write_text("{")
    got = sinks.read_page_maps(spark, str(tmp_path)).orderBy("page").collect()
    assert [tuple(r) for r in got] == [("fixture.pptx", 1, 1, 0, 3), ("fixture.pptx", 2, 1, 1, 3), ("fixture.pptx", 3, 1, 2, 3), ("fixture.pptx", 4, 2, None, None)]
    assert sinks.parse_notes(spark.createDataFrame([('{"1": "a"}',), ("[",)], "json string")).collect()[0].notes == {"1": "a"}


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "manifest")
    assert sinks.read_manifest(spark, path).count() == 0
    for name in ("a", "b"):
        sinks.append_manifest(spark.createDataFrame([(f"/out/{name}", f"/src/{name}", 5)], "dest string, path string, bytes int"), path)
    assert {(r.dest, r.path, r.bytes) for r in sinks.read_manifest(spark, path).collect()} == {("/out/a", "/src/a", 5), ("/out/b", "/src/b", 5)}
    report = sinks.substitution_report(spark.createDataFrame([("b", "fonts stripped"), ("a", "retried"), ("b", "fonts stripped")], "path string, recovery string"))
    assert [r.path for r in report.collect()] == ["b"]


def test_ingest_resumes(spark, root, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pptx").write_bytes(decks.fixture())
    (tmp_path / "in/~$a.pptx").write_bytes(b"lock")
    run = lambda: ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), ingest.deck_status).awaitTermination()
    run()
    (tmp_path / "in/b.PPTX").write_bytes(decks.fixture()[:200])
    run()
    run()
    assert {(r.path.rpartition("/")[2], r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a.pptx", "ok"), ("b.PPTX", "unreadable")}
