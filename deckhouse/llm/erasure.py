"""Cascading erasure: tables laid out in files by key, an index from keys to runs of files, and rewrites of those files alone that hold a victim.

``layout`` sorts each table, cuts the order into files of the same number of rows and writes, from the same rows, an inverted index:
for each key the runs of file numbers that hold it. As tables are sorted by a checksum of the client, a client's rows, and those of
its sales, are a few runs. ``erase`` joins the victims with the index; what it names is read, filtered and written anew in the same order, everything else
isn't opened. The index loses the victims, too.

A rewrite is written beside the table and put in place by a journal: first every new file, then the list of moves, then the moves, each of which
can be done again. A driver that is lost before the list is written has changed nothing, after it ``finish`` completes the erasure.
Sorting is by ranges of the whole order (ties included, so no client is one task) and never by key; a file is written by one task, row by row.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, store, table, unstore

#: A table is cut into so many files at most.
FILES = 150
#: So many keys of victims a table are sent to every executor (8 bytes each); beyond, they meet the rows by a shuffle.
HELD = 1 << 21


class Laid(NamedTuple):
    """A table on disk: its folder (``<number>=<n>/part-*.parquet`` in it), the name of that number, its schema, rows, rows a file, and key column."""

    name: str
    folder: str
    number: str
    schema: object
    rows: int
    rows_a_file: int
    key: str


class Layout(NamedTuple):
    """Tables laid out under one folder, and the folder of their index (``table_name, key, first_file, last_file``), which lies elsewhere."""

    folder: str
    index: str
    tables: dict[str, Laid]


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, or with as many underscores as make it none of ``taken`` (names differ by more than case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def _fs(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _numbered(spark: SparkSession, laid: Laid, folder: str | None = None) -> dict[int, list[str]]:
    """Data files of a table by file number, from a listing (one folder a file, and at most FILES of them)."""
    fs, path = _fs(spark, folder or laid.folder)
    out: dict[int, list[str]] = {}
    for each in fs.listStatus(path) if fs.exists(path) else []:
        name = each.getPath().getName()
        if name.startswith(f"{laid.number}="):
            out[int(name.partition("=")[2])] = [f.getPath().toString() for f in fs.listStatus(each.getPath()) if f.getPath().getName().endswith(".parquet")]
    return out


@contextmanager
def _file_by_file(spark: SparkSession) -> Iterator[None]:
    """What is read in here is read in a task for each file, whole: files are neither split nor put together."""
    settings = dict.fromkeys(("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"), str(1 << 40))
    settings["spark.sql.files.maxPartitionNum"] = str((1 << 31) - 1)
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def _write_files(rows: DataFrame, number: str, folder: str, files: int | None) -> None:
    """Rows (a struct ``row``, its file number ``file`` and ``place``) as one Parquet file for each number: one task writes a file, in the order of places.
    Without ``files`` a file's rows are in one task already."""
    named = rows.select(F.col("file").cast("int").alias(number), F.col("place").alias("its_place"), "row")
    dealt = (named if files is None else named.repartitionById(max(1, files), number)).sortWithinPartitions(number, "its_place")
    dealt.select(number, "row.*").write.partitionBy(number).option("maxRecordsPerFile", 0).parquet(folder)


def lay_out(rows: DataFrame, name: str, key: str, cluster: Column, folder: str, files: int = FILES) -> tuple[Laid, DataFrame]:
    """Write ``rows`` to ``folder``, sorted by ``cluster`` and then by all columns left to right, ascending, nulls first, in files of
    ``1 + floor(n / files)`` consecutive rows. Returns where it lies, and its index rows ``table_name, key, first_file, last_file``.

    ``cluster`` may use columns of a table joined before: those that ``rows`` has beyond the struct ``row`` of what is written. A null key is in no posting, as it can be no victim; repeated
    rows are written as often as they are there; an empty table has no file. Any column names may be there.
    """
    spark = rows.sparkSession
    columns = rows.schema["row"].dataType.names
    keyed = rows.select(cluster.alias("cluster"), "row")
    order = [F.col("cluster").asc_nulls_first(), *(F.col(f"row.`{c}`").asc_nulls_first() for c in columns)]
    ranged = store(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("row", F.monotonically_increasing_id().alias("at")), f"layout-{name}")
    # The upper bits of ``at`` are the range, the lower ones the place in it.
    sizes = sorted(((r.range, r["count"]) for r in ranged.groupBy(F.shiftright("at", 33).alias("range")).count().collect()))  # as many as shuffle partitions at most
    n = sum(c for _, c in sizes)
    a_file = 1 + n // files
    starts, total = [], 0
    for r, c in sizes:
        starts.append((r, total))
        total += c
    offsets = spark.createDataFrame(starts, "range long, start long")
    place = F.col("start") + F.col("at") - F.shiftleft("range", 33)
    placed = ranged.withColumn("range", F.shiftright("at", 33)).join(F.broadcast(offsets), "range").select("row", place.alias("place"), F.floor(place / F.lit(a_file)).alias("file"))
    laid = Laid(name, folder, free_name("file_no", columns), rows.schema["row"].dataType, n, a_file, key)
    if n:
        _write_files(placed, laid.number, folder, -(-n // a_file))
    # A key's file numbers, cut where they aren't consecutive; they are no more than there are files.
    pairs = placed.select(F.col(f"row.`{key}`").cast("long").alias("key"), "file").where("key IS NOT NULL").distinct()
    run = F.col("file") - F.row_number().over(Window.partitionBy("key").orderBy("file"))
    index = pairs.withColumn("run", run).groupBy("key", "run").agg(F.min("file").alias("first_file"), F.max("file").alias("last_file"))
    index = store(index.select(F.lit(name).alias("table_name"), "key", "first_file", "last_file"), f"layout-index-{name}")
    unstore(ranged)
    return laid, index


def whole_rows(df: DataFrame, *beside: Column) -> DataFrame:
    """The rows of ``df`` as one struct ``row``, and other columns beside it."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *beside)


def layout(spark: SparkSession, tables: dict[str, tuple[DataFrame, str, Column]], files: int = FILES) -> Layout:
    """Lay out tables (rows as by ``whole_rows``, key, what to cluster by) in a new folder under the shared one, with an index in another."""
    folder, index = (f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}" for kind in ("erasure", "erasure-index"))
    laid = {}
    for name, (rows, key, cluster) in tables.items():
        laid[name], postings = lay_out(rows, name, key, cluster, f"{folder}/{name}", files)
        postings.write.mode("append").parquet(f"{index}/0")
        unstore(postings)
    return Layout(folder, f"{index}/0", laid)


def postings(spark: SparkSession, layout: Layout) -> DataFrame:
    return spark.read.schema("table_name string, key long, first_file long, last_file long").parquet(layout.index)


def selected_files(spark: SparkSession, layout: Layout, victims: DataFrame) -> dict[str, list[int]]:
    """The file numbers of each table that hold a victim (``victims``: ``table_name, key``), from the index alone. There are no more than FILES a table."""
    met = postings(spark, layout).join(victims.distinct(), ["table_name", "key"])
    numbers = met.select("table_name", F.explode(F.sequence("first_file", "last_file")).alias("file")).distinct()
    out: dict[str, list[int]] = {name: [] for name in layout.tables}
    for r in numbers.collect():
        out[r.table_name].append(r.file)
    return out


def _number(laid: Laid) -> Column:
    """The file number of a row that was read from a table's file."""
    return F.regexp_extract("_metadata.file_path", rf"/{laid.number}=(\d+)/[^/]*$", 1).cast("long")


def _survivors(spark: SparkSession, laid: Laid, paths: list[str], victims: DataFrame, held: bool) -> DataFrame:
    """``row, file, place`` of the rows of the files at ``paths`` whose key is no victim's. Keys that are ``held`` by every executor are looked up where a file is read, so
    its rows stay in their task; others are met by a shuffle."""
    there = spark.read.schema(laid.schema).parquet(*paths)
    rows = whole_rows(there, _number(laid).alias("file"), F.col("_metadata.row_index").alias("place"))
    own = victims.where(F.col("table_name") == laid.name).select(F.col("key").alias("victim")).distinct()
    return rows.join(F.broadcast(own) if held else own.hint("merge"), F.col(f"row.`{laid.key}`").cast("long") == F.col("victim"), "left_anti")


def erase(spark: SparkSession, layout: Layout, victims: DataFrame) -> Layout:
    """Erase the rows of ``victims`` (``table_name, key``) from the files that the index names, and the victims from the index.

    Files keep their number and their rows' order; one that has no row left is removed; others aren't opened. Null keys are no victims, keys that no
    file holds change nothing. Doing it again changes nothing more.
    """
    victims = store(victims.where("key IS NOT NULL").distinct(), "erasure-victims")
    moves: list[tuple[str, str]] = []  # from, to; an empty ``from`` only removes what is there
    stage = f"{layout.index.rsplit('/', 1)[0]}/stage-{uuid.uuid4().hex}"
    for name, numbers in selected_files(spark, layout, victims).items():
        if not numbers:
            continue
        laid = layout.tables[name]
        there = _numbered(spark, laid)
        old = [path for n in numbers for path in there.get(n, [])]
        if not old:
            continue
        into = f"{stage}/{name}"
        if victims.where(F.col("table_name") == name).count() <= HELD:
            with _file_by_file(spark):
                _write_files(_survivors(spark, laid, old, victims, True), laid.number, into, None)
        else:
            _write_files(_survivors(spark, laid, old, victims, False), laid.number, into, max(numbers) + 1)
        new = _numbered(spark, laid, into)
        for n in numbers:
            moves += [(path, f"{laid.folder}/{laid.number}={n}") for path in new.get(n, [])] or [("", f"{laid.folder}/{laid.number}={n}")]
    left = postings(spark, layout).join(victims, ["table_name", "key"], "left_anti")
    index = f"{layout.index.rsplit('/', 1)[0]}/{uuid.uuid4().hex}"
    left.write.parquet(index)
    _journal(spark, layout, moves, stage, index)
    return finish(spark, layout)


def _journal_path(layout: Layout) -> str:
    return f"{layout.index.rsplit('/', 1)[0]}/journal.json"


def _journal(spark: SparkSession, layout: Layout, moves: list[tuple[str, str]], stage: str, index: str) -> None:
    """Write the list of moves under another name and rename it: it is there whole or not at all."""
    fs, path = _fs(spark, _journal_path(layout))
    _, draft = _fs(spark, _journal_path(layout) + ".draft")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"moves": moves, "stage": stage, "index": index, "before": layout.index}).encode()))
    out.close()
    if not fs.rename(draft, path):
        raise OSError(f"an erasure is still open: {path}; call finish first")


def finish(spark: SparkSession, layout: Layout) -> Layout:
    """Do, or do again, what an erasure has decided: put new files in place of old ones, remove emptied ones, take the new index. Without an open erasure nothing happens."""
    fs, path = _fs(spark, _journal_path(layout))
    if not fs.exists(path):
        return layout
    source = fs.open(path)
    try:
        said = json.loads(bytes(source.readAllBytes()))
    finally:
        source.close()
    for new, folder in said["moves"]:
        _, target = _fs(spark, folder)
        if not new:
            fs.delete(target, True)
            continue
        _, moved = _fs(spark, new)
        if fs.exists(moved):  # else this move is done
            fs.delete(target, True)
            fs.rename(moved.getParent(), target)
    for gone in (said["stage"], said["before"]):
        fs.delete(_fs(spark, gone)[1], True)
    fs.delete(path, True)
    return layout._replace(index=said["index"])


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file_no, n_rows, cents, ids_sha256`` of files whose rows (``file_no, place, id, cents``) come one file after the other, in order: hashes run on, nothing is gathered."""
    file, n, cents, digest = None, 0, 0, sha256()

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file_no": file, "n_rows": n, "cents": cents, "ids_sha256": digest.hexdigest()}])

    for batch in batches:
        if not batch.num_rows:
            continue
        files, amounts, ids = batch.column(0).to_numpy(), batch.column(3).to_numpy(), batch.column(2).to_pylist()
        cuts = [0, *(np.flatnonzero(np.diff(files)) + 1).tolist(), len(files)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if files[a] != file:
                if file is not None:
                    yield made()
                file, n, cents, digest = int(files[a]), 0, 0, sha256()
            digest.update((b"," if n else b"") + ",".join(x or "" for x in ids[a:b]).encode())
            n += b - a
            cents += int(amounts[a:b].sum())
    if file is not None:
        yield made()


def file_report(spark: SparkSession, layout: Layout, rewritten: dict[str, list[int]], amounts: dict[str, str]) -> DataFrame:
    """A row for each data file that is there, read back from it: ``table_name, file_no, n_rows, n_erased, cents, rewritten, ids_sha256, columns, path``.

    ``cents`` sums ``floor(100 * x + 0.5)`` of the column that ``amounts`` names for the table (null and not a number: 0), ``ids_sha256`` is the digest of the first column's values, decimal, null
    empty, comma-joined in file order. ``n_erased`` is what the layout wrote there less what is there. Each file is read by one task, and the report (a row a file) is made at once.
    """
    out = None
    for name, laid in layout.tables.items():
        files = _numbered(spark, laid)
        paths = [p for each in files.values() for p in each]
        if not paths:
            continue
        there = spark.read.schema(laid.schema).parquet(*paths)
        amount = F.col(f"`{amounts[name]}`").cast("double")
        cents = F.when(amount.isNull() | F.isnan(amount), 0).otherwise(F.floor(amount * 100 + 0.5)).cast("long")
        rows = there.select(_number(laid).alias("file_no"), F.col("_metadata.row_index").alias("place"), F.col(f"`{laid.schema.names[0]}`").cast("string").alias("id"), cents.alias("cents"))
        rows = rows.sortWithinPartitions("file_no", "place").mapInArrow(_digests, "file_no long, n_rows long, cents long, ids_sha256 string")
        number = F.col("file_no")
        path = F.create_map(*(F.lit(x) for n, each in files.items() for x in (n, each[0])))[number.cast("int")]
        planned = F.least(F.lit(laid.rows_a_file), F.lit(laid.rows) - number * laid.rows_a_file)
        mine = rows.select(
            F.lit(name).alias("table_name"), "file_no", "n_rows", (planned - F.col("n_rows")).cast("long").alias("n_erased"), "cents",
            number.isin(rewritten.get(name, [])).alias("rewritten"), "ids_sha256", F.lit(",".join(laid.schema.names)).alias("columns"), F.regexp_replace(path, "^file:/+", "/").alias("path"),
        )
        out = mine if out is None else out.unionAll(mine)
    if out is not None:
        with _file_by_file(spark):
            return store(out, "erasure-report")
    return spark.createDataFrame([], "table_name string, file_no long, n_rows long, n_erased long, cents long, rewritten boolean, ids_sha256 string, columns string, path string")


# ---------------------------------------------------------------- the shop's clients and what belongs to them


def checksum(client: Column) -> Column:
    """crc32 of the decimal digits of a client's id; a null one is the empty string."""
    return F.crc32(F.coalesce(client.cast("string"), F.lit("")).cast("binary"))


def shop_layout(spark: SparkSession, sf_dir: str, files: int = FILES) -> Layout:
    """clients, clicks, sales and sale_lines, each by the checksum of its client; a line's client is that of its sale."""
    clients, clicks, sales, lines = (table(spark, sf_dir, t) for t in ("clients", "clicks", "sales", "sale_lines"))
    of_sale = sales.where("sale_id IS NOT NULL").groupBy(F.col("sale_id").alias("of")).agg(F.min("client_id").alias("client"))
    met = whole_rows(lines).join(of_sale, F.col("row.sale_id") == F.col("of"), "left")
    own = checksum(F.col("row.client_id"))
    return layout(
        spark,
        {
            "clients": (whole_rows(clients), "client_id", own),
            "clicks": (whole_rows(clicks), "client_id", own),
            "sales": (whole_rows(sales), "client_id", own),
            "sale_lines": (met, "sale_id", checksum(F.col("client"))),
        },
        files,
    )


def victim_clients(clients: DataFrame, clicks: DataFrame, every: int = 100) -> DataFrame:
    """``client_id`` of the clients whose master's checksum ``every`` divides, and of the master whose clients together have most clicks (ties: the smallest,
    even at none). Clients without a master are never victims; clicks are counted by client before they meet the clients."""
    owned = clients.where("master_id IS NOT NULL").select("client_id", "master_id").distinct()
    counts = clicks.where("client_id IS NOT NULL").groupBy(F.col("client_id").alias("of")).count()
    by_master = owned.join(counts, F.col("client_id") == F.col("of"), "left").groupBy("master_id").agg(F.sum(F.coalesce("count", F.lit(0))).alias("clicks"))
    busiest = by_master.orderBy(F.desc("clicks"), "master_id").limit(1).select(F.col("master_id").alias("busiest"))
    drawn = F.crc32(F.col("master_id").cast("string").cast("binary")) % every == 0
    chosen = by_master.where(drawn).select(F.col("master_id").alias("chosen")).union(busiest).distinct()
    return owned.join(chosen, F.col("master_id") == F.col("chosen"), "left_semi").where("client_id IS NOT NULL").select("client_id").distinct()


def cascade(victims: DataFrame, sales: DataFrame) -> DataFrame:
    """``table_name, key`` of all that goes with the clients ``victims``: they themselves, their clicks, their sales, and the lines of those."""
    own = F.explode(F.array(*map(F.lit, ("clients", "clicks", "sales"))))
    lines = sales.join(victims.withColumnRenamed("client_id", "victim"), F.col("client_id") == F.col("victim"), "left_semi").where("sale_id IS NOT NULL")
    return victims.select(own.alias("table_name"), F.col("client_id").alias("key")).union(lines.select(F.lit("sale_lines"), "sale_id").distinct())


def op11_cascading_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lay the shop's tables out, erase the victims from them, and report the files that are there; the folder stays."""
    laid = shop_layout(spark, sf_dir)
    victims = victim_clients(table(spark, sf_dir, "clients", "client_id", "master_id"), table(spark, sf_dir, "clicks", "client_id"))
    keys = store(cascade(store(victims, "erasure-clients"), table(spark, sf_dir, "sales", "sale_id", "client_id")), "erasure-keys")
    touched = selected_files(spark, laid, keys)
    return file_report(spark, erase(spark, laid, keys), touched, {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"})
