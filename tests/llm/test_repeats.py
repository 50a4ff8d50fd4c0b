"""Substring deduplication against brute force."""

import random
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deckhouse.llm import repeats

from .cases import LONG, ROWS, docs


def words_of(text):
    return (text or "").encode().split()


def brute(rows, length):
    """By every window of every document, ids in order; rows that repeat an id and its text are one."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, sha256((r[1] or "").encode()).digest()))
    places = defaultdict(list)
    for doc, row in enumerate(order):
        w = words_of(row[1])
        for i in range(len(w) - length + 1):
            places[tuple(w[i : i + length])].append((doc, i))
    gone, longest = defaultdict(set), {}
    for where in places.values():
        for doc, i in where[1:]:
            gone[doc].update(range(i, i + length))
    size = length
    while True:
        met = defaultdict(list)
        for doc, row in enumerate(order):
            w = words_of(row[1])
            for i in range(len(w) - size + 1):
                met[tuple(w[i : i + size])].append(doc)
        twice = {doc for where in met.values() if len(where) > 1 for doc in where}
        if not twice:
            break
        longest |= dict.fromkeys(twice, size)
        size *= 2
    out = {}
    for doc, row in enumerate(order):
        kept = [x for i, x in enumerate(words_of(row[1])) if i not in gone[doc]]
        out[row] = (len(words_of(row[1])), len(gone[doc]), sha256(b" ".join(kept)).hexdigest(), longest.get(doc, 0), b" ".join(kept).decode())
    return out


def plain(rows):
    return sorted(repr(tuple(r)) for r in rows)


def passages(seed):
    rng = random.Random(seed)
    shared = [[f"s{p}_{i}" for i in range(rng.choice([5, 19, 20, 21, 45, 90]))] for p in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(5)):
            w += [f"w{rng.randrange(9)}" for _ in range(rng.randrange(30))] + rng.choice(shared)
        rows.append((i * 3 % 61, " ".join(w)))
    return rows + rows[:4] + [(100, rows[0][1]), (None, rows[1][1]), (3, "another text of one id " * 12), (101, "a b " * 300)]


@pytest.mark.parametrize("seed, length", [(1, 20), (2, 7), (1, 2)])
def test_repeats_match_brute_force(spark, seed, length):
    rows = passages(seed)
    got = repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length=length).collect()
    want = brute(rows, length)
    assert plain(got) == plain((r[0], *want[r][:4]) for r in rows)


def test_any_rows(spark):
    rows = [(r[0], r[1]) for r in ROWS if r[1] is None or len(r[1]) < 5000]
    got = repeats.repeats(docs(spark, [(*r, "web") for r in rows])).collect()
    want = brute([(i, t or "") for i, t in rows], 20)
    assert plain(got) == plain((i, *want[i, t or ""][:4]) for i, t in rows)
    assert repeats.repeats(docs(spark, [])).count() == 0


def test_long_texts(spark):
    row = {r.doc_id: r for r in repeats.repeats(docs(spark, [(1, LONG, ""), (2, LONG + " tail", "")])).collect()}
    assert row[2].n_words == 30_001 and row[2].n_removed == 30_000 and row[2].kept_sha256 == sha256(b"tail").hexdigest()
    assert row[1].n_removed == 30_000 - 977 and row[1].longest == row[2].longest == 20 << 10


def test_dropped_repeats_keep_all_columns(spark):
    rows = passages(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("digest", "first", "uid", "left", "at", "row", "of", "judged", "key")})
    got, want = repeats.drop_repeats(df), brute(rows, 20)
    assert got.columns == df.columns
    left = [(r.doc_id, r.text) for r in got.collect()]
    assert plain(left) == plain((r[0], want[r][4] if want[r][1] else r[1]) for r in rows)


def test_anchors_are_the_first_smallest():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 6, 200).astype(np.uint64)
    assert repeats.anchors(keys, 11).tolist() == [i + int(np.argmin(keys[i : i + 11])) for i in range(190)]
    assert not len(repeats.anchors(keys[:5], 11))


def test_runs_cross_batches_and_double():
    uid, pos = np.repeat([3, 4, 9], [5, 1, 6]), np.array([0, 1, 2, 20, 22, 7, 0, 20, 40, 60, 80, 81])
    schema = pa.schema([("uid", pa.int64()), ("pos", pa.int32()), ("key", pa.int64())])
    batches = [pa.RecordBatch.from_arrays([pa.array(x[a : a + 4]).cast(f.type) for x, f in zip((uid, pos, pos * 7), schema, strict=True)], schema=schema) for a in range(0, 12, 4)]
    found = {u: (p.tolist(), k.tolist()) for u, p, k in repeats.runs(batches)}
    assert found == {u: (pos[uid == u].tolist(), (pos[uid == u] * 7).tolist()) for u in (3, 4, 9)}
    assert {u: repeats.doubled(np.array(p), np.array(k), 20)[0].tolist() for u, (p, k) in found.items()} == {3: [0, 2], 4: [], 9: [0, 20, 40, 60]}
