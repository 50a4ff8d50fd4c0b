"""Export plans: destinations, name clashes, conflicts, resumption and outcomes.

Where a sequential run would depend on its order, the order is that of paths by code point (Q16).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

LAYOUTS, CONFLICTS = ("mirror", "beside", "flat"), ("skip", "overwrite", "new")
SUFFIX = " (export)"


def check_arguments(layout: str, on_conflict: str, out: str | None, edge: int = 1920, image_format: str = "png") -> None:
    """S3 and the argument rules of the command; ValueError says what is wrong. Asking needs a terminal (TV15)."""
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {', '.join(LAYOUTS)}")
    if on_conflict not in CONFLICTS:
        raise ValueError(f"on_conflict must be one of {', '.join(CONFLICTS)}")
    if (layout == "beside") == bool(out):
        raise ValueError("layout beside writes next to each deck and takes no out; the others need one")
    if image_format not in ("png", "jpeg", "jpg") or edge <= 0:
        raise ValueError("images are png or jpeg, with a positive edge")


def base_destinations(decks: DataFrame, layout: str, root: str, out: str | None = None, single: bool = False) -> DataFrame:
    """Adds ``stem``, ``parent`` (folder for the destination) and ``dest`` to ``decks(path)``."""
    path, folder = F.col("path"), text.folder_name(F.col("path"))
    below = F.substring(folder, F.length(text.unslash(F.lit(root))) + 2, F.length(folder))
    where = text.unslash(F.lit(out or ""))
    parent = folder if layout == "beside" else F.when((below == "") | F.lit(single or layout == "flat"), where).otherwise(F.concat(where, F.lit("/"), below))
    rows = decks.withColumn("stem", text.stem(path)).withColumn("parent", parent)
    return rows.withColumn("dest", F.concat("parent", F.lit("/"), "stem", F.lit(SUFFIX)))


def repeated_names(decks: DataFrame) -> DataFrame:
    """``stem, n`` of the names that several decks have."""
    return decks.groupBy("stem").agg(F.count("*").alias("n")).where("n > 1")


def destinations(decks: DataFrame, layout: str, root: str, out: str | None = None, manifest: DataFrame | None = None) -> DataFrame:
    """TV14 (J13-J15): ``path, stem, dest, clash`` with a destination of its own for every deck.

    A deck clashes if its name repeats in a flat layout, if an earlier deck (by path) has its destination, or if
    ``manifest(dest, path)`` says that another deck wrote it (a null path is taken as the same deck). It is then
    named after its folder, else after two folders, else by its own earlier number or the lowest free one from 2.

    Decks and earlier folders are one table throughout; each step is a window over those that want the same name,
    so the plan is a chain of shuffles of paths, and no claim is compared with all claims. Which names repeat is counted before
    anything is dealt by name; a name that very many decks of one folder name have is numbered in one task (which sorts, and spills).
    """
    deck = base_destinations(decks.select("path"), layout, root, out).select("path", "stem", "parent", "dest", F.lit(None).cast("string").alias("writer"), F.lit(False).alias("written"))
    if manifest is not None:
        none = F.lit(None).cast("string")
        deck = deck.union(manifest.groupBy("dest").agg(F.max("path").alias("writer")).select(none, none, none, "dest", "writer", F.lit(True)))
    path, mine, written = F.col("path"), F.col("dest"), F.col("written")
    foreign = lambda w: F.coalesce(F.max(F.when(written, F.col("writer"))).over(w) != path, F.lit(False))
    if layout == "flat":
        again = repeated_names(deck.where(~written)).select("stem", F.lit(True).alias("repeats"))
        deck = deck.join(again, "stem", "left").withColumn("repeats", F.col("repeats").isNotNull())
    else:
        deck = deck.withColumn("repeats", F.lit(False))
    # Decks whose names repeat want no destination yet, so they aren't dealt by it.
    place = F.when(F.col("repeats"), F.concat("dest", F.lit("\n"), "path")).otherwise(mine)
    rows = deck.withColumn("place", place).withColumn("wants", ~written & ~F.col("repeats") & ~foreign(Window.partitionBy("place")))
    first = F.row_number().over(Window.partitionBy("place", "wants").orderBy("path")) == 1
    rows = rows.withColumn("settled", F.col("wants") & first).withColumn("clash", ~F.col("settled")).drop("wants", "place", "repeats")
    folder = text.folder_name(path)
    one = text.base_name(folder)
    two = F.concat_ws("-", text.base_name(text.folder_name(folder)), one)
    head = F.concat("parent", F.lit("/"), "stem")
    named = lambda what: F.concat(head, F.lit(" ("), what, F.lit(")" + SUFFIX))
    settled = F.col("settled")
    for what in (one, two):
        rows = rows.withColumn("name", F.when(settled | written, mine).otherwise(named(what)))
        same = Window.partitionBy("name")
        taken = F.max(settled).over(same) | foreign(same)
        first = F.row_number().over(Window.partitionBy("name", settled | written).orderBy("path")) == 1
        rows = rows.withColumn("won", ~settled & ~written & ~taken & first)
        rows = rows.withColumn("dest", F.when(F.col("won"), F.col("name")).otherwise(mine)).withColumn("settled", settled | F.col("won")).drop("name", "won")
    numbered = r"^(.*) \((\d+)\) \(export\)$"
    rows = rows.withColumn("head", F.when(settled | written, F.regexp_extract("dest", numbered, 1)).otherwise(head))
    rows = rows.withColumn("n", F.when(settled | written, F.nullif(F.regexp_extract("dest", numbered, 2), F.lit("")).cast("int")))
    # A number is taken once by a settled deck or an earlier folder. Below the j-th taken number t are t - 1 - j free ones, so a deck
    # that is due the r-th free number gets r + 1 and one more for each taken number with fewer than r free ones below it.
    n = F.col("n")
    rows = rows.withColumn("taken", (settled | written) & F.coalesce(n >= 2, F.lit(False)))
    rows = rows.withColumn("taken", F.col("taken") & (F.row_number().over(Window.partitionBy("head", "n", "taken").orderBy("path")) == 1))
    rows = rows.withColumn("free", n - 1 - F.row_number().over(Window.partitionBy("head", "taken").orderBy("n")))
    owner = F.when(written, F.col("writer")).otherwise(path)
    rows = rows.withColumn("own", F.min(F.when(written, n)).over(Window.partitionBy("head", owner)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("head", settled | written | F.col("own").isNotNull()).orderBy("path")))
    rows = rows.withColumn("seat", F.when(F.col("taken"), F.col("free")).otherwise(F.col("rank")))
    passed = F.count(F.when(F.col("taken"), 1)).over(Window.partitionBy("head").orderBy("seat").rangeBetween(Window.unboundedPreceding, -1))
    number = F.coalesce("own", F.col("rank") + 1 + passed.cast("int"))
    return rows.withColumn("number", number).where(~written).select("path", "stem", F.when(settled, mine).otherwise(named(F.col("number").cast("string"))).alias("dest"), "clash")


def lowest_free(rank, used):
    """The rank-th lowest number from 2 on that is not in the sorted array ``used``."""
    return F.aggregate(used, rank + 1, lambda n, u: F.when((u >= 2) & (u <= n), n + 1).otherwise(n))


def resolve_conflicts(planned: DataFrame, existing: DataFrame, on_conflict: str = "skip") -> DataFrame:
    """TV15, W13: adds ``action`` (export, skip, overwrite) where ``existing(dest)`` has the destination; ``new`` exports
    to ``dest (n)`` with the lowest free n from 2."""
    there = existing.select(F.regexp_replace("dest", r" \((\d+)\)$", "").alias("head"), F.nullif(F.regexp_extract("dest", r" \((\d+)\)$", 1), F.lit("")).cast("int").alias("n"))
    there = there.groupBy("head").agg(F.array_sort(F.collect_set("n")).alias("used"))
    whole = existing.select(F.col("dest").alias("found")).distinct()
    rows = planned.join(whole, F.col("dest") == F.col("found"), "left").join(there, F.col("dest") == F.col("head"), "left")
    taken = F.col("found").isNotNull()
    action = F.when(~taken, "export").otherwise("export" if on_conflict == "new" else on_conflict)
    again = F.concat("dest", F.lit(" ("), lowest_free(F.lit(1), F.coalesce("used", F.array().cast("array<int>"))).cast("string"), F.lit(")"))
    dest = F.when(taken, again).otherwise(F.col("dest")) if on_conflict == "new" else F.col("dest")
    return rows.withColumn("action", action).withColumn("dest", dest).drop("found", "head", "used")


def export_plan(decks: DataFrame, layout: str, root: str, out: str | None = None, on_conflict: str = "skip", manifest: DataFrame | None = None) -> DataFrame:
    """The dry run: ``path, dest, action, reason`` by path, from ``decks(path, status)``. Decks that can't be read fail, decks
    without slides are skipped (S7, F1). ``manifest(dest, path)`` is what there is: the folders of the output store
    (``sources.exports``), or a list of earlier exports where the store can't be read."""
    check_arguments(layout, on_conflict, out)
    planned = destinations(decks.select("path"), layout, root, out, manifest)
    existing = manifest.select("dest") if manifest is not None else decks.sparkSession.createDataFrame([], "dest string")
    rows = resolve_conflicts(planned, existing, on_conflict).join(decks.select("path", "status"), "path")
    reason = F.when(F.col("action") == "skip", "already exported").when(F.col("status") == "no_slides", "no slides").when(F.col("status") == "unreadable", "not a readable deck").when(F.col("clash"), "name clash")
    action = F.when(F.col("action") == "skip", "skip").when(F.col("status") == "no_slides", "skip").when(F.col("status") == "unreadable", "fail").otherwise(F.col("action"))
    return rows.select("path", "dest", action.alias("action"), reason.alias("reason")).orderBy("path")


def remaining(planned: DataFrame, manifest: DataFrame) -> DataFrame:
    """Decks whose destination ``manifest(dest, path)`` doesn't have from the same deck."""
    mine = manifest.where("path is null").select(F.col("dest").alias("d"), F.lit(None).cast("string").alias("p")).union(manifest.where("path is not null").select("dest", "path"))
    return planned.join(mine, (F.col("dest") == F.col("d")) & (F.col("p").isNull() | (F.col("p") == F.col("path"))), "left_anti")


def failure_runs(outcomes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``failures_in_a_row`` to ``outcomes(..., status)``; a success ends a run, a skip does not."""
    within = Window.partitionBy(*keys).orderBy(*order)
    run = F.sum(F.when(F.col("status") == "ok", 1).otherwise(0)).over(within.rowsBetween(Window.unboundedPreceding, 0))
    rows = outcomes.withColumn("_run", run)
    in_run = Window.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("failures_in_a_row", F.when(F.col("status") == "fail", F.sum(F.when(F.col("status") == "fail", 1).otherwise(0)).over(in_run)).otherwise(0).cast("long")).drop("_run")


def reached(outcomes: DataFrame, keys: list[str], order: list[str], most: int = 3) -> DataFrame:
    """The outcomes up to and with the one that stops the run."""
    counted = failure_runs(outcomes, keys, order)
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.max("failures_in_a_row").over(before), F.lit(0)) >= most
    return counted.withColumn("_stopped", stopped).where("not _stopped").drop("_stopped")


def run_totals(outcomes: DataFrame, keys: list[str], total: DataFrame | None = None) -> DataFrame:
    """``exported, skipped, failed, processed`` and, with ``total(keys, decks)``, ``shortfall``."""
    counts = outcomes.groupBy(*keys).agg(F.count_if(F.col("status") == "ok").alias("exported"), F.count_if(F.col("status") == "skip").alias("skipped"), F.count_if(F.col("status") == "fail").alias("failed"), F.count("*").alias("processed"))
    return counts if total is None else counts.join(total, keys).withColumn("shortfall", F.greatest(F.col("decks") - F.col("processed"), F.lit(0))).drop("decks")


def exit_code(totals: DataFrame) -> DataFrame:
    """Section 2.15: adds ``exit_code``, 1 if a deck failed or was never reached."""
    return totals.withColumn("exit_code", F.when((F.col("failed") > 0) | (F.col("shortfall") > 0), 1).otherwise(0))


def recovery(attempts: DataFrame) -> DataFrame:
    """TV16, K13, U5: ``path, status, recovery`` from a renderer's ``attempts(path, attempt, feed, ok)``: the first attempt
    that worked counts; what it was fed says what was given up (``nofonts``, ``flat``)."""
    best = attempts.groupBy("path").agg(F.min(F.when(F.col("ok"), F.struct("attempt", "feed"))).alias("best"))
    gave_up = F.when(F.col("best.feed") == "nofonts", "fonts stripped").when(F.col("best.feed") == "flat", "build states flattened").when(F.col("best.attempt") > 1, "retried")
    return best.select("path", F.when(F.col("best").isNull(), "fail").otherwise("ok").alias("status"), gave_up.alias("recovery"))


def yields(pages: DataFrame, images: DataFrame, media: DataFrame) -> DataFrame:
    """One row with the numbers of pages, images and media files (its index not counted)."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(pages, "pages").join(one(images, "images"), F.lit(True)).join(one(media.where("file <> 'media.json'"), "media"), F.lit(True))


def deck_yields(pages: DataFrame, images: DataFrame, media: DataFrame) -> DataFrame:
    """A19 by ``deck``: what each one has given, 0 where it has none of a kind; decks without any have no row."""
    kinds = ("pages", pages), ("images", images), ("media", media.where("file <> 'media.json'"))
    counted = [df.groupBy("deck").agg(*(F.count("*").alias(k) if k == kind else F.lit(0).cast("long").alias(k) for k, _ in kinds)) for kind, df in kinds]
    return counted[0].union(counted[1]).union(counted[2]).groupBy("deck").agg(*(F.sum(k).alias(k) for k, _ in kinds))
