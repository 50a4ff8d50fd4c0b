"""Commands: ``python -m deckhouse audit|copies|dropped|fonts|plan|export|render|expand|variants|notes|media|map LIBRARY ...``, ``version``, ``help``.

Exit codes: 0 done, 1 a deck failed or was never reached, 2 bad arguments.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions import glyphs, text
from .operators import builds, content, export, fonts, library, lineage, media, notes, pages, publish, render, sinks
from .operators.settle import settled
from .sources import decks, exports


def _fonts(spark: SparkSession, path: str | None) -> DataFrame:
    """Keys of a list of font files, one name a line; none without a list."""
    if not path:
        return spark.createDataFrame([], "key string")
    return library.font_keys(spark.read.text(path), "value")


def audit(spark: SparkSession, args: argparse.Namespace) -> int:
    parts = decks.read_parts(spark, args.library, content=r"\.(xml|rels|gif)$")
    records = library.audit(parts, _fonts(spark, args.fonts))
    if args.json:
        sinks.audit_json(records).write.mode("overwrite").json(args.json)
    summary = library.summary(records).first()
    if args.document:
        sinks.write_document(records, summary, args.document)
    print(sinks.human_summary(summary, library.oversized(records).collect(), library.unreadable(records).collect()))
    return 0


def _names(spark: SparkSession, listed: str | None, **columns: Column) -> DataFrame:
    """A text file's lines as the given columns of ``value``; without a file no rows."""
    rows = spark.read.text(listed) if listed else spark.createDataFrame([], "value string")
    return rows.where("trim(value) <> ''").select(*(c.alias(n) for n, c in columns.items()))


def _say(df: DataFrame, out: str | None = None) -> None:
    """Every row: as JSON files where the caller wants them, else printed."""
    if out:
        df.write.mode("overwrite").json(out)
        return
    for line in sinks.lines(df):
        print(line)


def font_plan(spark: SparkSession, args: argparse.Namespace) -> int:
    """What to do about each missing face; catalogues are lists of installed faces, office files and own substitutes. With a folder of font files
    (candidates, and the anchor that they are compared with) substitutes are picked by width, on the decks' own text."""
    parts = decks.read_parts(spark, args.library)
    records = library.audit(parts, _fonts(spark, args.fonts))
    missing = records.select("path", F.explode("fonts_missing").alias("face"))
    value = F.col("value")
    system = fonts.installed_faces(_names(spark, args.listing, number=F.monotonically_increasing_id(), line=value))
    office = fonts.office_faces(_names(spark, args.office, ordinal=F.monotonically_increasing_id(), path=value))
    ours = _names(spark, args.ours, key=text.plain_key(text.stem(value)), source=text.base_name(value))
    plan = settled(fonts.face_plan(missing, system, office, ours))
    _say(plan.withColumn("paths", F.array_join("paths", ";")), args.json)
    groups = fonts.group_substitutes(plan.where("verdict = 'substitute'"))
    if args.faces:
        groups = settled(groups)
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(args.faces).where(r"lower(path) RLIKE '\\.(ttf|otf|ttc)$'")
        widths = glyphs.glyph_widths(files).where("error IS NULL").cache()
        picks = fonts.recommend_measured(groups, fonts.deck_texts(parts).cache(), widths, args.anchor)
        _say(picks.select("family", "deck_count", "pick", F.format_string("%+.1f%%", "delta_pct").alias("width"), "why") if not args.json else picks, args.json and f"{args.json.rstrip('/')}-picks")
    elif not args.json:
        _say(groups.select("family", F.size("faces"), "deck_count"))
    return 0


def _store(args: argparse.Namespace) -> str:
    """Where exports go: ``--out``, or beside the decks."""
    if args.out:
        return args.out
    return args.library if not args.library.lower().endswith(".pptx") else args.library.rpartition("/")[0] or "."


def _planned(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The plan against what is in the output store now; a manifest is a log and decides nothing."""
    export.check_arguments(args.layout, args.on_conflict, args.out)
    found = decks.read_decks(spark, args.library, hidden="export", only=args.only)
    there = exports.read_exports(spark, _store(args))
    return export.export_plan(found.select("path", "status"), args.layout, args.library, args.out, args.on_conflict, there)


def plan(spark: SparkSession, args: argparse.Namespace) -> int:
    planned = _planned(spark, args).cache()
    _say(planned, args.json)
    return 1 if planned.where("action = 'fail'").count() else 0


def _renderer(name: str) -> render.Renderer:
    """``module:function``; ValueError if there is none."""
    module, _, function = name.partition(":")
    try:
        return getattr(importlib.import_module(module), function or "render")
    except (ImportError, AttributeError) as e:
        raise ValueError(f"no renderer {name}: {e}") from e


def export_library(spark: SparkSession, args: argparse.Namespace) -> int:
    """The plan carried out by a renderer that is plugged in as ``module:function``, deck bytes to PDF bytes."""
    renderer, store = _renderer(args.renderer), _store(args)
    publish.recover(spark, store, args.manifest)
    planned = _planned(spark, args).cache()
    wanted = planned.where("action in ('export', 'overwrite')").select("path", "dest", (F.col("action") == "overwrite").alias("replace"))
    packages = decks.read_decks(spark, args.library, hidden="export", only=args.only, content="true").select("path", "bytes", "content").join(wanted, "path")
    rendered = render.export_decks(packages, renderer, not args.no_states, args.deadline, args.most_failures)
    done = rendered.join(wanted, "path").cache()
    good = done.where("status = 'ok'")
    pdf = F.col("pdf")
    parts = decks.read_parts(spark, args.library, hidden="export", only=args.only)
    states = good.select(F.col("path").alias("deck"), F.explode("expanded").alias("e")).select("deck", F.col("e.slide").alias("slide_no"), F.col("e.pages").alias("n_states"))
    mapped = pages.page_map(notes.presentation_slides(parts), states)
    maps = sinks.page_map_json(mapped, states).join(good.select(F.col("path").alias("deck"), "dest", "replace"), "deck")
    if not args.no_notes:
        on_pages = notes.notes_on_pages(parts, mapped)
        by_deck = on_pages.groupBy(F.col("deck").alias("path")).agg(F.map_from_entries(F.collect_list(F.struct("page", "text"))).alias("notes"))
        good = good.join(by_deck, "path", "left").withColumn("with_notes", builds.annotated("pdf", F.coalesce("notes", F.create_map().cast("map<int,string>"))))
        pdf = F.coalesce("with_notes.pdf", "pdf")
    files = good.select("dest", "path", F.concat(text.stem(F.col("path")), F.lit(".pdf")).alias("file"), pdf.alias("content"), "replace")
    files = files.unionByName(maps.select("dest", F.col("deck").alias("path"), F.lit(render.PAGE_MAP).alias("file"), F.col("json").cast("binary").alias("content"), "replace"))
    if not args.no_media:
        items = media.extract_media(decks.read_parts(spark, args.library, hidden="export", only=args.only, content=r"\.rels$|^ppt/media/"), svg=args.svg)
        placed = items.join(done.where("status = 'ok'").select(F.col("path").alias("deck"), "dest", "replace"), "deck")
        files = files.unionByName(placed.select("dest", F.col("deck").alias("path"), F.concat(F.lit("media/"), "file").alias("file"), "content", "replace"))
    run = publish.stage(files, store)
    blocked = publish.finish(spark, store, run, args.manifest)
    _say(done.select("path", "dest", "status", "recovery", "reason"), args.json)
    return _summary(planned, done, blocked)


def _summary(planned: DataFrame, done: DataFrame, blocked: list) -> int:
    """The last lines of an export (A18, A22, K13), and its exit code."""
    unplanned = planned.where("action in ('skip', 'fail')").select(F.col("action").alias("status"))
    outcomes = done.select("status").union(unplanned).withColumn("all", F.lit(1))
    totals = export.run_totals(outcomes.where("status <> 'stopped'"), ["all"], outcomes.groupBy("all").agg(F.count("*").alias("decks")))
    for row in sinks.substitution_report(done).toLocalIterator():
        print(f"without its embedded fonts: {row.path}")
    for row in blocked:
        print(f"not replaced, written meanwhile by another run: {row.dest}")
    t = export.exit_code(totals).first()
    if t is None:
        never = outcomes.where("status = 'stopped'").count()
        print(f"done: nothing exported{f', {never} never reached' if never else ''}")
        return 1 if never else 0
    print(f"done: {t.exported - len(blocked)} exported, {t.skipped} skipped, {t.failed + len(blocked)} failed" + (f", {t.shortfall} never reached" if t.shortfall else ""))
    return 1 if blocked else t.exit_code


def images(spark: SparkSession, args: argparse.Namespace) -> int:
    """The images that an archive still wants, with their names and sizes; drawing them is left to a renderer."""
    pdfs = render.archive(spark, args.library, args.only)
    have = render.archive_images(spark, args.library)
    named = render.read_labels(spark, args.labels) if args.labels else None
    wanted = render.images_wanted(render.render_plan(pdfs, have, args.format, args.force), args.library, args.edge, args.format, args.page, named).cache()
    _say(wanted, args.json)
    return 1 if wanted.where("error is not null").count() else 0


def copies(spark: SparkSession, args: argparse.Namespace) -> int:
    """Decks that hold the same as another one, or whose slides another one has all of."""
    parts = decks.read_parts(spark, args.library, content=".")
    same = content.duplicates_by_content(settled(content.package_digests(parts)))
    held = content.contained_decks(settled(content.slide_digests(parts))).select(F.col("deck").alias("path"), "slides", "containers", "container")
    _say(same.join(held, "path", "left").where("copies > 1 or containers > 0").select("path", "same_as", "copies", "slides", "containers", "container").orderBy("path"), args.json)
    return 0


def dropped(spark: SparkSession, args: argparse.Namespace) -> int:
    """Where entries of slide lists and forecast build states go, deck by deck."""
    found = lineage.slide_lineage(decks.read_parts(spark, args.library)).orderBy("deck")
    if not args.json:
        print("\t".join(found.columns))
    _say(found, args.json)
    return 0


def _below(path: Column, library: str) -> Column:
    """A deck's path below its library without the extension; of a library that is one deck, its name."""
    below = F.substring(path, len(exports.file_system(library)[1].rstrip("/")) + 2, 1 << 20)
    return text.stem(path) if library.lower().endswith(".pptx") else F.regexp_replace(below, r"(?i)\.pptx$", "")


def expand(spark: SparkSession, args: argparse.Namespace) -> int:
    """Decks with a slide for each build state, and their page maps beside them."""
    found = decks.read_decks(spark, args.library, content="true", only=args.only)
    out = found.select("path", builds.expansion("content").alias("x")).cache()
    name = F.concat(_below(F.col("path"), args.library), F.lit(" (expanded)"))
    good = out.where("x.error is null and size(x.faults) = 0")
    sinks.write_files(good.select(F.concat(name, F.lit(".pptx")).alias("file"), F.col("x.deck").alias("content")), args.out)
    slides = notes.presentation_slides(decks.read_parts(spark, args.library, only=args.only))
    states = good.select(F.col("path").alias("deck"), F.explode("x.expanded").alias("e")).select("deck", F.col("e.slide").alias("slide_no"), F.col("e.pages").alias("n_states"))
    maps = sinks.page_map_json(pages.page_map(slides, states), states).join(good.select(F.col("path").alias("deck"), name.alias("name")), "deck")
    sinks.write_files(maps.select(F.concat("name", F.lit(".pages.json")).alias("file"), F.col("json").cast("binary").alias("content")), args.out)
    bad = out.where("x.error is not null or size(x.faults) > 0").select("path", F.coalesce("x.error", F.array_join("x.faults", "; ")).alias("reason")).cache()
    _say(bad)
    return 1 if bad.count() else 0


def variants(spark: SparkSession, args: argparse.Namespace) -> int:
    """A deck for each build state of one slide."""
    found = decks.read_decks(spark, args.library, content="true", only=args.only)
    states = found.select(_below(F.col("path"), args.library).alias("stem"), F.posexplode(builds.slide_variants("content", F.lit(args.slide))).alias("state", "content"))
    sinks.write_files(states.select(F.concat("stem", F.lit(f" (slide {args.slide}, state "), F.col("state").cast("string"), F.lit(").pptx")).alias("file"), "content"), args.out)
    return 0


def speaker_notes(spark: SparkSession, args: argparse.Namespace) -> int:
    _say(notes.notes_json(notes.notes_on_pages(decks.read_parts(spark, args.library))), args.out)
    return 0


def extract(spark: SparkSession, args: argparse.Namespace) -> int:
    parts = decks.read_parts(spark, args.library, content=r"\.rels$|^ppt/media/")
    items = media.extract_media(parts, args.all_gifs, args.svg)
    sinks.write_files(items, args.out)
    _say(media.kind_summary(items))
    return 0


def page_maps(spark: SparkSession, args: argparse.Namespace) -> int:
    slides = notes.presentation_slides(decks.read_parts(spark, args.library))
    none = spark.createDataFrame([], "deck string, slide_no int, n_states int")
    _say(sinks.page_map_json(pages.page_map(slides, none), none), args.json)
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="deckhouse")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, function, *options: tuple[str, dict]) -> None:
        c = commands.add_parser(name)
        c.add_argument("library")
        for flag, settings in options:
            c.add_argument(flag, **settings)
        c.set_defaults(function=function)

    fonts_option, out, as_json, only, yes = ("--fonts", {}), ("--out", {}), ("--json", {}), ("--only", {"default": ""}), {"action": "store_true"}
    planning = (out, ("--layout", {"default": "mirror", "choices": export.LAYOUTS}), ("--on-conflict", {"default": "skip", "choices": export.CONFLICTS}), only, ("--manifest", {}), as_json)
    command("audit", audit, as_json, ("--document", {}), fonts_option)
    command("copies", copies, as_json)
    command("dropped", dropped, as_json)
    command("fonts", font_plan, fonts_option, ("--listing", {}), ("--office", {}), ("--ours", {}), ("--faces", {}), ("--anchor", {"default": "Helvetica"}), as_json)
    command("plan", plan, *planning)
    limits = ("--deadline", {"type": float}), ("--most-failures", {"type": int, "default": render.MOST_FAILURES})
    command("export", export_library, *planning, *limits, ("--renderer", {"required": True}), ("--no-states", yes), ("--no-notes", yes), ("--no-media", yes), ("--svg", yes))
    command("render", images, only, ("--format", {"default": "png", "choices": list(render.IMAGE_EXTENSION)}), ("--edge", {"type": int, "default": 1920}), ("--page", {"type": int}), ("--labels", {}), ("--force", yes), as_json)
    command("expand", expand, ("--out", {"required": True}), only)
    command("variants", variants, ("--slide", {"required": True, "type": int}), ("--out", {"required": True}), only)
    command("notes", speaker_notes, out)
    command("media", extract, ("--out", {"required": True}), ("--svg", yes), ("--all-gifs", yes))
    command("map", page_maps, as_json)
    commands.add_parser("version")
    commands.add_parser("help")
    args = p.parse_args(argv)
    if args.command == "help":
        p.print_help()
        return 0
    if args.command == "version":
        print(f"deckhouse {__version__}")
        return 0
    spark = SparkSession.builder.appName("deckhouse").getOrCreate()
    try:
        if args.command != "render":
            decks.open_library(args.library)
        return args.function(spark, args)
    except (ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2
