"""Cascading erasure against brute force, on files read back without Spark."""

import json
import math
import os
from collections import Counter
from glob import glob
from hashlib import sha256
from zlib import crc32

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from deckhouse.llm import erasure


SF = "/root/testdata/sf0.001"
AMOUNTS = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def read(sf_dir):
    return {t: pq.read_table(f"{sf_dir}/{t}.parquet") for t in AMOUNTS}


def brute(tables):
    """Every file that is left: (table, file_no) to (rows, erased, cents, rewritten, digest of ids)."""
    rows = {t: list(zip(*(c.to_pylist() for c in x.columns), strict=True)) for t, x in tables.items()}
    names = {t: x.column_names for t, x in tables.items()}
    at = lambda t, c: names[t].index(c)
    of_sale = {r[0]: r[at("sales", "client_id")] for r in rows["sales"]}
    client = {t: (lambda r, i=at(t, "client_id"): r[i]) for t in ("clients", "clicks", "sales")} | {"sale_lines": lambda r: of_sale.get(r[0])}
    master = {r[0]: r[1] for r in rows["clients"] if r[1] is not None}
    n_clicks = Counter(master[c] for r in rows["clicks"] if (c := client["clicks"](r)) in master)
    busiest = min(set(master.values()), key=lambda m: (-n_clicks[m], m))
    chosen = {m for m in master.values() if crc32(str(m).encode()) % 100 == 0} | {busiest}
    victims = {c for c, m in master.items() if m in chosen}
    out = {}
    for t, all_rows in rows.items():
        check = lambda r: crc32(b"" if client[t](r) is None else str(client[t](r)).encode())  # noqa: B023, E731
        ordered = sorted(all_rows, key=lambda r: (check(r), *((x is not None, x if x is not None else 0) for x in r)))  # noqa: B023
        size = 1 + len(ordered) // 150
        for k in range(0, len(ordered), size):
            part = ordered[k : k + size]
            left = [r for r in part if client[t](r) not in victims]
            if left:
                cents = sum(math.floor(100 * x + 0.5) if (x := r[at(t, AMOUNTS[t])]) is not None else 0 for r in left)
                out[t, k // size] = (len(left), len(part) - len(left), cents, len(left) < len(part), sha256(",".join("" if r[0] is None else str(r[0]) for r in left).encode()).hexdigest(), left)
    return out


def test_query_matches_brute_force(spark):
    got = erasure.op11_cascading_erasure(spark, SF).collect()
    want = brute(read(SF))
    assert {(r.table_name, r.file_no): (r.n_rows, r.n_erased, r.cents, r.rewritten, r.ids_sha256) for r in got} == {k: v[:5] for k, v in want.items()}
    assert len(got) == len(want) and sum(r.rewritten for r in got) > 4 and sum(not r.rewritten for r in got) > 4
    tables = read(SF)
    for r in got:
        file = pq.ParquetFile(r.path)
        read_back = file.read()
        assert read_back.column_names == r.columns.split(",") == tables[r.table_name].column_names
        assert list(zip(*(c.to_pylist() for c in read_back.columns), strict=True)) == want[r.table_name, r.file_no][5]
        groups = [file.metadata.row_group(i).column(0).statistics for i in range(file.metadata.num_row_groups)]
        ids = [i for i in read_back.column(0).to_pylist() if i is not None]
        assert sum(g.null_count for g in groups) == len(read_back) - len(ids) and (not ids or (min(g.min for g in groups if g.has_min_max), max(g.max for g in groups if g.has_min_max)) == (min(ids), max(ids)))
    root = os.path.commonpath([r.path for r in got])
    assert {f for f in glob(f"{root}/**/*.parquet", recursive=True)} == {r.path for r in got}
    again = erasure.op11_cascading_erasure(spark, SF)
    assert os.path.commonpath([r.path for r in again.collect()]) != root


def small(spark, n=40):
    rows = [(i % 7 if i % 5 else None, i, f"v{i % 3}") for i in range(n)]
    df = spark.createDataFrame(rows, "key long, file_no int, row string").withColumns({c: F.lit(1) for c in ("file", "place", "at", "range", "start", "cluster", "victim", "its_place", "table_name")})
    return erasure.layout(spark, {"t": (erasure.whole_rows(df), "key", F.col("row.key"))}, files=9), [(r[0], r[1]) for r in rows]


def held(spark, laid):
    files = erasure._numbered(spark, laid.tables["t"])
    return [(r[laid.tables["t"].key], r["file_no"]) for n in sorted(files) for r in pq.ParquetFile(files[n][0].removeprefix("file:")).read().to_pylist()]


def test_only_named_files_are_rewritten(spark):
    laid, rows = small(spark)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert held(spark, laid) == order and laid.tables["t"].number == "file_no_"
    before = {p: os.stat(p.removeprefix("file:")).st_mtime_ns for f in erasure._numbered(spark, laid.tables["t"]).values() for p in f}
    victims = spark.createDataFrame([("t", 3), ("t", None), ("t", 99), ("other", 1)], "table_name string, key long")
    touched = erasure.selected_files(spark, laid, victims.where("key IS NOT NULL"))["t"]
    assert sorted(touched) == sorted({i // 5 for i, r in enumerate(order) if r[0] == 3})
    after = erasure.erase(spark, laid, victims)
    assert held(spark, after) == [r for r in order if r[0] != 3]
    now = {p: os.stat(p.removeprefix("file:")).st_mtime_ns for f in erasure._numbered(spark, after.tables["t"]).values() for p in f}
    assert {p for p in before if now.get(p) == before[p]} == {p for p in before if not any(f"file_no_={n}/" in p for n in touched)}
    assert {r.key for r in erasure.postings(spark, after).collect()} == {0, 1, 2, 4, 5, 6}
    assert held(spark, erasure.erase(spark, after, victims)) == held(spark, after)


@pytest.mark.parametrize("done", [0, 1, 2])
def test_an_erasure_that_breaks_off_is_finished(spark, monkeypatch, done):
    laid, rows = small(spark)
    victims = spark.createDataFrame([("t", 3), ("t", 6)], "table_name string, key long")
    finish = erasure.finish
    monkeypatch.setattr(erasure, "finish", lambda _, layout: layout)
    erasure.erase(spark, laid, victims)  # the driver is lost once the list of moves is written
    with open(erasure._journal_path(laid).removeprefix("file:")) as f:
        moves = json.load(f)["moves"]
    for new, folder in [m for m in moves if m[0]][:done]:  # and again, amid the moves
        fs, target = erasure._fs(spark, folder)
        fs.delete(target, True)
        if done == 1:
            fs.rename(erasure._fs(spark, new)[1].getParent(), target)
    after = finish(spark, laid)
    assert sorted(held(spark, after), key=str) == sorted((r for r in rows if r[0] not in (3, 6)), key=str)
    assert finish(spark, after) == after and {r.key for r in erasure.postings(spark, after).collect()} == {0, 1, 2, 4, 5}


def test_empty_tables_and_no_victims(spark):
    none = spark.createDataFrame([], "client_id long, balance double")
    laid = erasure.layout(spark, {"t": (erasure.whole_rows(none), "client_id", F.col("row.client_id"))})
    after = erasure.erase(spark, laid, spark.createDataFrame([("t", 1)], "table_name string, key long"))
    assert erasure.file_report(spark, after, {}, {"t": "balance"}).count() == 0


def test_victims_and_ties(spark):
    clients = spark.createDataFrame([(1, 70), (2, 60), (3, 60), (4, None), (None, 60)], "client_id long, master_id long")
    none = spark.createDataFrame([], "client_id long")
    assert {r.client_id for r in erasure.victim_clients(clients, none).collect()} == {2, 3}
    clicks = spark.createDataFrame([(4,), (4,), (1,), (1,), (2,), (3,), (None,)], "client_id long")
    assert {r.client_id for r in erasure.victim_clients(clients, clicks).collect()} == {2, 3}
    assert {r.client_id for r in erasure.victim_clients(clients, clicks.union(clicks.where("client_id = 1"))).collect()} == {1}


@pytest.mark.parametrize("held", [0, erasure.HELD])
def test_files_are_rewritten_where_they_are_read(spark, monkeypatch, held):
    """With few victims a file is a task, read to written, however Spark would pack or split files; with many, rows are dealt by file. Both do the same."""
    monkeypatch.setattr(erasure, "HELD", held)
    rows = spark.range(3000).select((F.col("id") % 300).alias("k"), F.col("id").alias("v"))
    layout = erasure.layout(spark, {"t": (erasure.whole_rows(rows), "k", F.col("row.k"))}, files=40)
    victims = spark.createDataFrame([("t", k) for k in range(0, 300, 3)], "table_name string, key long")
    files = erasure._numbered(spark, layout.tables["t"])
    paths = [p for each in files.values() for p in each]
    with erasure._file_by_file(spark):
        assert erasure._survivors(spark, layout.tables["t"], paths, victims, True).rdd.getNumPartitions() == len(paths) > 30
    before = {n: [(r["k"], r["v"]) for p in each for r in pq.ParquetFile(p.removeprefix("file:")).read().to_pylist()] for n, each in files.items()}
    erasure.erase(spark, layout, victims)
    after = erasure._numbered(spark, layout.tables["t"])
    want = {n: left for n, rs in before.items() if (left := [r for r in rs if r[0] % 3])}
    assert {n: [(r["k"], r["v"]) for p in each for r in pq.ParquetFile(p.removeprefix("file:")).read().to_pylist()] for n, each in after.items()} == want
    assert all(len(each) == 1 for each in after.values()) and spark.conf.get("spark.sql.files.maxPartitionBytes") == "134217728b"
