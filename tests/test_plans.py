"""Names, fonts, export plans, outcomes, and the queries against their SQL."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from deckhouse.functions import faces, text
from deckhouse.operators import export, fonts, library
from deckhouse.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_its_sql(spark, tables, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0 or name in ("d08_oversized_topk",)
    if name in queries.SQL:
        want, columns = tables.sql(queries.SQL[name]).df(), sorted(got.columns)
        plain = lambda df: sorted(repr([None if pd.isna(x) else float(x) if isinstance(x, (int, float)) else x for x in r]) for r in df[columns].astype(object).values.tolist())
        assert columns == sorted(want.columns) and plain(got) == plain(want)


@pytest.mark.parametrize("module", ["queries", "content_queries", "lineage_queries", "package_queries", "run_queries", "source_queries", "synthetic"])
def test_any_module_of_queries_can_be_imported_first(module):
    """As in a Python worker, which begins with the module of its function."""
    code = f"import deckhouse.plans.{module}; from deckhouse.plans.queries import QUERIES; print(len(QUERIES))"
    run = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, check=False)
    assert run.returncode == 0, run.stderr
    assert int(run.stdout) == len(queries.QUERIES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


# ---------------------------------------------------------------- names


FACES = {
    "Helvetica Neue LT Std 75": ("Helvetica Neue", "Bold", None, None),
    "HelveticaNeueLTStd-Lt": ("Helvetica Neue", "Light", None, None),
    "HelveticaNeueLT Std Bold Cn": ("Helvetica Neue", "Bold", "Condensed", None),
    "Source Sans Pro SemiBold": ("Source Sans Pro", "SemiBold", None, None),
    "ObjektivMk3W03-Bold": ("Objektiv Mk3", "Bold", None, None),
    "Source Code Pro": ("Source Code Pro", None, None, None),
    "Aptos Narrow (Body)": ("Aptos", None, "Narrow", "Body"),
    "Aptos Display": ("Aptos", None, None, "Display"),
    "Display": ("Display", None, None, None),
    "Text Display": ("Text", None, None, "Display"),
    "Book LT": ("", "Light", None, None),
    "HelveticaNeue755": ("Helvetica Neue755", None, None, None),
    "PTSerif_ExtraBold.Italic": ("PT Serif", "ExtraBold", None, None),
    "Gotham X Light Wide": ("Gotham", "ExtraLight", "Wide", None),
    "Univers 45 Bold": ("Univers", "Bold", None, None),
    "": ("", None, None, None),
    None: (None, None, None, None),
}


def test_face_names(spark):
    df = spark.createDataFrame([(f,) for f in FACES], "face string").select("face", faces.face_words(F.col("face")).alias("words"), faces.face_parts(F.col("face")).alias("p"))
    got = {r.face: r for r in df.collect()}
    assert {f: tuple(r.p) for f, r in got.items()} == FACES
    assert got["PTSerif_ExtraBold.Italic"].words == ["PT", "Serif", "ExtraBold", "Italic"] and got["Gotham X Light Wide"].words == ["Gotham", "XLight", "Wide"]


def test_noise(spark):
    names = ["ui-sans-serif", "Hel\\", "ab", "12345", "Graphik Semibold", " Serif "]
    reasons = [r[0] for r in spark.createDataFrame([(n,) for n in names], "face string").select(faces.noise_reason(F.col("face"))).collect()]
    assert [bool(r) for r in reasons] == [True, True, True, True, False, True]


@pytest.mark.parametrize(
    "function, value, result",
    [(text.face_key, "Graphik-Bold.OTF", "graphik"), (text.face_key, "Source Sans Pro", "sourcesans"), (text.plain_key, "Source Sans Pro", "sourcesanspro"), (text.extension, "a/b.C.MP4", ".mp4"),
     (text.extension, ".hidden", ""), (text.extension, "a.b/c", ""), (text.extension, "..x.gif", ".gif"), (text.stem, "/a/b.c.pptx", "b.c"), (text.folder_name, "/a/b.x", "/a"), (text.folder_name, "/b", "/"), (text.folder_name, "b", "."),
     (text.unslash, "/a//", "/a"), (text.unslash, "//", "/"), (text.strip, " \t x \n", "x"), (text.pdf_string, "é🙂", "<FEFF00E9D83DDE42>"), (text.pixels, None, None)],
)
def test_text_functions(spark, function, value, result):
    kind = "long" if function is text.pixels else "string"
    assert spark.createDataFrame([(value,)], f"x {kind}").select(function(F.col("x"))).first()[0] == result


def test_pixels_round_half_even(spark):
    got = spark.createDataFrame([(int(9525 * 2.5),), (9525 * 5 // 2 + 9525,), (12192000,)], "x long").select(text.pixels(F.col("x"))).collect()
    assert [r[0] for r in got] == [2, 3, 1280]


# ---------------------------------------------------------------- fonts


def catalogues(spark):
    lines = ["Family: Helvetica Neue", " Full Name: Helvetica Neue Bold", "Full Name: Helvetica Neue Light", "Family: Aptos", "Family: Ours", "Full Name: Ours Bold", "Family: Aptos"]
    listing = spark.createDataFrame(list(enumerate(lines)), "number int, line string")
    ours = spark.createDataFrame([("ours", "Inter"), ("graphikxl", "Archivo")], "key string, source string")
    system = fonts.installed_faces(listing, ours)
    office = fonts.office_faces(spark.createDataFrame([(0, "/o/Avenir-Bold.ttf"), (1, "/p/Avenir-Bold.otf"), (2, "/o/readme.txt")], "ordinal int, path string"))
    return system, office, ours


def test_installed_and_office_faces(spark):
    system, office, _ = catalogues(spark)
    assert {(r.key, r.family) for r in system.collect()} == {("helveticaneue", "Helvetica Neue"), ("helveticaneuebold", "Helvetica Neue"), ("helveticaneuelight", "Helvetica Neue"), ("aptos", "Aptos")}
    assert [(r.key, r.path) for r in office.collect()] == [("avenirbold", "/o/Avenir-Bold.ttf")]


def test_face_plan(spark):
    wanted = ["Helvetica Neue LT Std 75", "Aptos Display", "Aptos Narrow", "Avenir Heavy Bold", "Graphik XL", "serif", "Graphik Thin", "Unknown Face"]
    missing = spark.createDataFrame([(p, f) for f in wanted for p in ("a", "b")[: 1 + (f == "serif")]], "path string, face string")
    got = {r.face: r for r in fonts.face_plan(missing, *catalogues(spark)).collect()}
    assert {f: r.verdict for f, r in got.items()} == {"Helvetica Neue LT Std 75": "alias", "Aptos Display": "alias", "Aptos Narrow": "substitute", "Avenir Heavy Bold": "alias", "Graphik XL": "alias", "serif": "noise", "Graphik Thin": "substitute", "Unknown Face": "substitute"}
    assert (got["Helvetica Neue LT Std 75"].detail, got["Avenir Heavy Bold"].kind, got["Graphik XL"].kind, got["serif"].decks) == ("Helvetica Neue Bold", "office", "installed", 2)
    assert (got["Graphik Thin"].family, got["Graphik Thin"].style, got["Graphik Thin"].weight, got["Unknown Face"].style) == ("Graphik", "Thin", 100, "Regular")


def test_groups(spark):
    rows = [("Graphik", "Graphik", "Regular", 400, ["a"]), ("Graphik Thin", "Graphik", "Thin", 100, ["a"]), ("Graphik Courant", "Graphik Courant", "Regular", 400, ["b"]), ("Proxima Nova", "Proxima Nova", "Regular", 400, ["c"]), ("Graphikal", "Graphikal", "Regular", 400, ["c"])]
    got = fonts.group_substitutes(spark.createDataFrame(rows, "face string, family string, style string, weight int, paths array<string>")).collect()
    assert [(r.family, len(r.faces), r.deck_count) for r in got] == [("Graphik", 3, 2), ("Graphikal", 1, 1), ("Proxima Nova", 1, 1)]


def test_ranking(spark):
    rows = [("f", c, r, g, i) for i, (c, r, g) in enumerate([("wide", 1.2, True), ("near", 0.99, False), ("own", 0.9, True), ("wider", 1.3, False), ("owner", 0.95, True), ("bit", 1.01, False)])]
    got = fonts.rank_candidates(spark.createDataFrame(rows, "family string, c string, ratio double, in_genre boolean, pool int"), ["family"])
    assert [r.c for r in got.orderBy("rank").collect()] == ["owner", "own", "near", "wide", "bit", "wider"]
    groups = spark.createDataFrame([("Graphik", 3), ("Muli", 1)], "family string, deck_count int")
    widths = spark.createDataFrame([("Inter", 1.05), ("Archivo", 0.97), ("Jost", 0.99), ("Bebas Neue", 0.5)], "candidate string, width double")
    picks = {r.family: r for r in fonts.recommend(groups, widths, 1.0).collect()}
    assert (picks["Graphik"].pick, round(picks["Graphik"].delta_pct, 1), len(picks["Graphik"].ranked)) == ("Archivo", -3.0, 3) and picks["Muli"].pick == "Mulish" and picks["Muli"].why == "the same design, free"


def test_weights_and_genres(spark):
    df = spark.createDataFrame([("Bold", 700, "My Transport New"), ("Odd", 400, "Graphik X")], "s string, w int, f string")
    got = df.select(faces.weight_of(F.col("s")), faces.bold_of(F.col("w")), faces.genre_of(F.col("f"))).collect()
    assert [tuple(r) for r in got] == [(700, 700, "signage"), (400, 600, "grotesque")]


def test_missing_face_order(spark):
    rows = [("b", ["Z", "A"]), ("a", ["M", "Z"]), ("c", [])]
    assert [(r.face, r.decks) for r in library.missing_faces(spark.createDataFrame(rows, "path string, fonts_missing array<string>")).collect()] == [("Z", 2), ("M", 1), ("A", 1)]


# ---------------------------------------------------------------- export


def plan(spark, paths, layout="flat", out="/out", manifest=None, conflict="skip"):
    rows = spark.createDataFrame([(p, "ok") for p in paths], "path string, status string")
    written = spark.createDataFrame(manifest, "dest string, path string") if manifest is not None else None
    return {r.path: r for r in export.export_plan(rows, layout, "/src", out, conflict, written).collect()}


@pytest.mark.parametrize("layout, out, dest", [("mirror", "/out/", "/out/2024/Acme/Deck (export)"), ("flat", "/out", "/out/Deck (export)"), ("beside", None, "/src/2024/Acme/Deck (export)")])
def test_layouts(spark, layout, out, dest):
    assert plan(spark, ["/src/2024/Acme/Deck.pptx"], layout, out)["/src/2024/Acme/Deck.pptx"].dest == dest


def test_same_names_borrow_their_folders(spark):
    got = plan(spark, [f"/src/cohorts/{c}/Personas.pptx" for c in ("Kiwi", "Shogito", "BizGees")] + ["/src/One.pptx"])
    assert sorted(r.dest for r in got.values()) == ["/out/One (export)", "/out/Personas (BizGees) (export)", "/out/Personas (Kiwi) (export)", "/out/Personas (Shogito) (export)"]
    deep = plan(spark, ["/src/a/x/D.pptx", "/src/b/x/D.pptx", "/src/c/b/x/D.pptx", "/src/d/b/x/D.pptx"])
    assert [deep[p].dest for p in sorted(deep)] == ["/out/D (x) (export)", "/out/D (b-x) (export)", "/out/D (2) (export)", "/out/D (3) (export)"]


def test_clash_with_an_earlier_run(spark):
    got = plan(spark, ["/src/k/D.pptx"], manifest=[("/out/D (export)", "/else/D.pptx")])
    assert (got["/src/k/D.pptx"].dest, got["/src/k/D.pptx"].action, got["/src/k/D.pptx"].reason) == ("/out/D (k) (export)", "export", "name clash")
    for writer in ("/src/k/D.pptx", None):  # the same deck, or a folder without a record
        assert plan(spark, ["/src/k/D.pptx"], manifest=[("/out/D (export)", writer)])["/src/k/D.pptx"].action == "skip"


def test_reruns_find_their_own_folders(spark):
    paths = ["/src/a/x/D.pptx", "/src/b/x/D.pptx", "/src/c/b/x/D.pptx", "/src/d/b/x/D.pptx", "/src/e/b/x/D.pptx"]
    once = plan(spark, paths[:4])
    written = [(r.dest, p) for p, r in once.items()]
    again = plan(spark, paths, manifest=written)
    assert {p: again[p].dest for p in paths[:4]} == {p: once[p].dest for p in paths[:4]} and again[paths[4]].dest == "/out/D (4) (export)"
    assert [again[p].action for p in paths] == ["skip"] * 4 + ["export"]


def test_conflicts(spark):
    mine = [("/out/D (export)", "/src/D.pptx"), ("/out/D (export) (2)", None), ("/out/D (export) (4)", None)]
    assert plan(spark, ["/src/D.pptx"], manifest=mine, conflict="overwrite")["/src/D.pptx"].action == "overwrite"
    again = plan(spark, ["/src/D.pptx"], manifest=mine, conflict="new")["/src/D.pptx"]
    assert (again.dest, again.action) == ("/out/D (export) (3)", "export")
    for bad in ({"layout": "x"}, {"conflict": "ask"}, {"layout": "beside"}, {"out": None}):
        with pytest.raises(ValueError):
            plan(spark, ["/src/D.pptx"], **bad)


def test_runs_stop_after_three_failures(spark):
    states = ["fail", "fail", "ok", "fail", "skip", "fail", "fail", "ok", "ok"]
    rows = spark.createDataFrame([("r", i, s) for i, s in enumerate(states)], "run string, n int, status string")
    totals = export.run_totals(export.reached(rows, ["run"], ["n"]), ["run"], spark.createDataFrame([("r", 9)], "run string, decks int"))
    r = export.exit_code(totals).first()
    assert (r.exported, r.skipped, r.failed, r.processed, r.shortfall, r.exit_code) == (1, 1, 5, 7, 2, 1)


def test_recovery_and_yields(spark):
    rows = [("a", 1, "deck", True), ("b", 1, "deck", False), ("b", 2, "deck", False), ("b", 3, "nofonts", True), ("c", 1, "deck", False), ("d", 4, "flat", True), ("e", 2, "deck", True)]
    got = {r.path: (r.status, r.recovery) for r in export.recovery(spark.createDataFrame(rows, "path string, attempt int, feed string, ok boolean")).collect()}
    assert got == {"a": ("ok", None), "b": ("ok", "fonts stripped"), "c": ("fail", None), "d": ("ok", "build states flattened"), "e": ("ok", "retried")}
    files = spark.createDataFrame([("media.json",), ("x.gif",)], "file string")
    assert tuple(export.yields(spark.range(4), spark.range(3), files).first()) == (4, 3, 1)


def test_deck_yields(spark):
    pages, images = (spark.createDataFrame(rows, "deck string") for rows in ([("a",), ("a",), ("b",), (None,)], [("a",)]))
    files = spark.createDataFrame([("a", "media.json"), ("c", "x.gif"), ("d", "media.json"), ("c", None)], "deck string, file string")
    assert {tuple(r) for r in export.deck_yields(pages, images, files).collect()} == {("a", 2, 1, 0), ("b", 1, 0, 0), (None, 1, 0, 0), ("c", 0, 0, 1)}
    none = pages.limit(0)
    assert export.deck_yields(none, none, files.limit(0)).count() == 0


def test_listing_over_blocks(spark):
    """Families that began blocks ago, blocks without a family, and blocks that aren't there."""
    said = ["Full Name: Lost", "Family: One", "Full Name: A", "Version: 1", "Full Name: B", "Family: Two", "Full Name: A", "Full Name: C", "Full Name: D", None]
    want = {("one", "One", "One"), ("a", "One", "A"), ("b", "One", "B"), ("two", "Two", "Two"), ("c", "Two", "C"), ("d", "Two", "D")}
    for step in (1, 1 << (fonts.BLOCK_BITS - 1), 1 << fonts.BLOCK_BITS, 5 << fonts.BLOCK_BITS):
        lines = spark.createDataFrame([(i * step, line) for i, line in enumerate(said)], "number long, line string").repartition(4)
        assert {tuple(r) for r in fonts.installed_faces(lines).collect()} == want
        ours = spark.createDataFrame([("one",)], "key string")
        assert {tuple(r) for r in fonts.installed_faces(lines, ours).collect()} == {("two", "Two", "Two"), ("a", "Two", "A"), ("c", "Two", "C"), ("d", "Two", "D")}


def test_one_name_for_all_decks(spark):
    """A name that every deck has: counted before anything is dealt by it, and no deck loses its place."""
    paths = [f"/src/f{i:04}/D.pptx" for i in range(1500)]
    decks = spark.createDataFrame([(p,) for p in paths], "path string")
    planned = export.destinations(decks, "flat", "/src", "/out")
    assert {r.path: (r.dest, r.clash) for r in planned.collect()} == {p: (f"/out/D ({p.split('/')[2]}) (export)", True) for p in paths}
    # No window or join deals the decks by their name or by the destination that they share.
    text_plan = planned._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(stem" not in text_plan and "windowspecdefinition(dest" not in text_plan
    same = spark.range(3000).select(F.concat(F.lit("/"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("path"), F.lit(7).alias("bytes"), F.lit(2).alias("slides"))
    got = library.with_duplicates(same).groupBy("duplicate_of", "duplicate_group_size").count().collect()
    assert {tuple(r) for r in got} == {(None, 3000, 1), ("/00000", 3000, 2999)}
