"""Exports against what is in the output store, and folders that appear whole or not at all."""

import json
import os
from datetime import timedelta

import pyarrow.fs as pafs
import pytest
from pyspark.sql import Row

from deckhouse import cli
from deckhouse.operators import publish, render, sinks
from deckhouse.plans import synthetic as s
from deckhouse.sources import exports

from . import decks


def tree(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def folders(spark, rows):
    return spark.createDataFrame(rows, "dest string, path string, file string, content binary, replace boolean")


def two(out):
    return [(f"{out}/a (export)", "/lib/a.pptx", "a.pdf", b"A", False), (f"{out}/a (export)", "/lib/a.pptx", "media/x.gif", b"X", False), (f"{out}/sub/b (export)", "/lib/b.pptx", "b.pdf", b"B", False), (f"{out}/c (export)", "/lib/c.pptx", None, None, False)]


def test_published_folders_and_their_records(spark, tmp_path):
    out, manifest = str(tmp_path / "out"), str(tmp_path / "log")
    run = publish.stage(folders(spark, two(out)), out)
    assert exports.read_exports(spark, out).count() == 0 and not (tmp_path / "out/a (export)").exists()  # nothing is seen before
    assert publish.finish(spark, out, run, manifest) == []
    assert {k: v for k, v in tree(tmp_path / "out").items() if not k.endswith(exports.RECORD)} == {"a (export)/a.pdf": b"A", "a (export)/media/x.gif": b"X", "sub/b (export)/b.pdf": b"B"}
    got = {r.dest: (r.path, r.run, r.files) for r in exports.read_exports(spark, out).collect()}
    assert got == {f"{out}/a (export)": ("/lib/a.pptx", run, 2), f"{out}/sub/b (export)": ("/lib/b.pptx", run, 1), f"{out}/c (export)": ("/lib/c.pptx", run, 0)}
    assert {(r.path, r.bytes) for r in sinks.read_manifest(spark, manifest).collect()} == {("/lib/a.pptx", 2), ("/lib/b.pptx", 1), ("/lib/c.pptx", 0)}


def test_store_is_listed_at_any_depth(spark, tmp_path):
    for name in ("a (export)/a.pdf", "x/y/z/b (export) (2)/b.pdf", "x/y/w/c (export)/inner (export)/c.pdf", "x/no/d.pdf", ".hidden/e (export)/e.pdf", "f (export) (x)/f.pdf"):
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "empty (export)").mkdir()
    (tmp_path / "x/y/w/c (export)" / exports.RECORD).write_text("[1]")
    for seeds in ("1", "3", "256"):
        got = {os.path.relpath(r.dest, tmp_path): r.path for r in exports.read_exports(spark, str(tmp_path), seeds=seeds).collect()}
        assert got == {"a (export)": None, "x/y/z/b (export) (2)": None, "x/y/w/c (export)": None}
    assert exports.read_exports(spark, str(tmp_path / "nowhere")).count() == 0


def attempt(writer, rows, dies_after=None):
    def given():
        for i, row in enumerate(rows):
            if i == dies_after:
                raise RuntimeError("killed")
            yield Row(dest=row[0], path=row[1], file=row[2], content=row[3], replace=row[4])

    return writer.write(given())


@pytest.mark.parametrize("lost", ["an attempt", "the driver before its moves", "the driver amid its moves", "the driver before it is logged"])
def test_lost_tasks_and_drivers(spark, tmp_path, lost):
    out, manifest = str(tmp_path / "out"), str(tmp_path / "log")
    writer = publish.FolderWriter(f"{out}/{publish.STAGING}", "r1")
    rows = two(out)
    with pytest.raises(RuntimeError):
        attempt(writer, rows, dies_after=2)
    speculative = attempt(writer, rows)  # not among those that the job commits
    writer.commit([attempt(writer, rows)])
    assert speculative and not (tmp_path / "out/a (export)").exists()
    if lost == "the driver amid its moves":
        listing = json.loads((tmp_path / "out" / publish.STAGING / "r1/committed.json").read_text())[0]
        with open(listing) as f:
            assert publish.settle(pafs.LocalFileSystem(), json.loads(f.readline()), "r1") == "ok"
    if lost == "the driver before it is logged":
        publish.log(publish.publish(spark, out, "r1"), manifest, "r1")
    assert publish.recover(spark, out, manifest) == ["r1"] and publish.recover(spark, out, manifest) == []
    assert {k: v for k, v in tree(tmp_path / "out").items() if not k.endswith(exports.RECORD)} == {"a (export)/a.pdf": b"A", "a (export)/media/x.gif": b"X", "sub/b (export)/b.pdf": b"B"}
    assert sorted(r.path for r in sinks.read_manifest(spark, manifest).collect()) == ["/lib/a.pptx", "/lib/b.pptx", "/lib/c.pptx"]


def test_runs_that_never_commit_go(spark, tmp_path):
    out = str(tmp_path / "out")
    attempt(publish.FolderWriter(f"{out}/{publish.STAGING}", "r1"), two(out))
    assert publish.recover(spark, out) == [] and (tmp_path / "out" / publish.STAGING / "r1").exists()
    assert publish.recover(spark, out, stale=timedelta(0)) == [] and tree(tmp_path / "out") == {}
    writer = publish.FolderWriter(f"{out}/{publish.STAGING}", "r2")
    writer.abort([attempt(writer, two(out))])
    assert tree(tmp_path / "out") == {}


def test_what_is_there_is_replaced_only_if_asked(spark, tmp_path):
    out = str(tmp_path / "out")
    for run, rows in (("r1", two(out)), ("r2", [(*r[:3], b"new", r[1] == "/lib/b.pptx") for r in two(out)[1:3]])):
        blocked = publish.finish(spark, out, publish.stage(folders(spark, rows), out, run))
    assert [r.path for r in blocked] == ["/lib/a.pptx"]
    assert tree(tmp_path / "out")["sub/b (export)/b.pdf"] == b"new" and tree(tmp_path / "out")["a (export)/a.pdf"] == b"A"
    assert not (tmp_path / "out" / publish.STAGING).exists()


def draw(data: bytes) -> bytes:
    from deckhouse.functions import package

    return s.pdf(len(package.Package(data).slides())) + b"%" + os.environ.get("DRAWN", "").encode()


def test_exports_in_a_row(spark, tmp_path, capsys):
    root, out = tmp_path / "in", tmp_path / "out"
    (root / "2024").mkdir(parents=True)
    (root / "2024/Deck.pptx").write_bytes(s.deck([s.slide([s.shape(2, "A", "a")])]))
    quick = ["--renderer", "tests.test_publish:draw", "--no-notes", "--no-media"]
    run = lambda *more: cli.main(["export", f"{root}/", "--out", f"{out}/", *quick, *more])
    last = lambda: capsys.readouterr().out.strip().splitlines()[-1]
    pdf = out / "2024/Deck (export)/Deck.pdf"
    assert run() == 0 and last() == "done: 1 exported, 0 skipped, 0 failed"
    first = pdf.stat().st_mtime_ns
    assert run() == 0 and last() == "done: 0 exported, 1 skipped, 0 failed" and pdf.stat().st_mtime_ns == first
    (pdf.parent / "mine.txt").write_text("x")
    assert run("--on-conflict", "overwrite") == 0 and pdf.stat().st_mtime_ns != first and not (pdf.parent / "mine.txt").exists()
    assert run("--on-conflict", "new") == 0 and run("--on-conflict", "new") == 0
    assert sorted(p.name for p in (out / "2024").iterdir()) == ["Deck (export)", "Deck (export) (2)", "Deck (export) (3)"]
    # A folder that another deck says is its own isn't this deck's export.
    (pdf.parent / exports.RECORD).write_text(json.dumps({"source": "/elsewhere.pptx", "run": "r"}))
    assert run() == 0 and (out / "2024/Deck (2024) (export)/Deck.pdf").exists()
    assert cli.main(["version"]) == 0 and last().startswith("deckhouse ")
    assert cli.main(["export", str(root), "--out", str(out), "--renderer", "tests.test_publish:nothing"]) == 2


def test_one_deck_keeps_its_name(spark, tmp_path):
    (tmp_path / "Deck.pptx").write_bytes(decks.fixture())
    assert cli.main(["expand", str(tmp_path / "Deck.pptx"), "--out", str(tmp_path / "o")]) == 0
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["Deck (expanded).pages.json", "Deck (expanded).pptx"]


def moody(data: bytes) -> bytes | None:
    """Hangs on one deck, dies on one, fails on one, makes nothing of one, and renders the rest."""
    import time

    if b"hang" in data:
        time.sleep(60)
    if b"die" in data:
        os._exit(3)
    if b"dialog" in data:
        raise RuntimeError("a dialog is open")
    return None if b"nothing" in data else b"%PDF" * 50_000


def test_deadlines_reasons_and_the_breaker(spark):
    rows = [("a", b"hang"), ("b", b"fine"), ("c", b"die"), ("d", b"dialog"), ("e", b"nothing"), ("f", b"fine"), ("g", None)]
    df = spark.createDataFrame(rows, "path string, content binary").coalesce(1)
    got = {r.path: r for r in render.export_decks(df, moody, states=False, deadline=1.5).collect()}
    assert {p: r.status for p, r in got.items()} == {p: "ok" if p in "bfg" else "fail" for p in "abcdefg"} and len(got["b"].pdf) == 200_000
    assert got["a"].reason == "TimeoutError: nothing after 1.5 s" and got["c"].reason == "RuntimeError: the renderer's process died"
    assert got["d"].reason == "RuntimeError: RuntimeError: a dialog is open" and got["e"].reason == "the renderer made nothing" and got["f"].reason is None
    stopped = {r.path: r.status for r in render.export_decks(df, moody, states=False, deadline=1.5, most_failures=3).collect()}
    assert stopped == {"a": "fail", "b": "ok", "c": "fail", "d": "fail", "e": "fail", "f": "stopped", "g": "stopped"}
