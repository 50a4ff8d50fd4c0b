"""Libraries listed by executors, and as streams."""

import os
import pickle
import time

import pytest

from deckhouse.plans import synthetic as s
from deckhouse.sources import decks as source
from deckhouse.sources import listing
from deckhouse.streaming import decks as streaming

from . import decks

NAMES = ["a.pptx", "_draft.pptx", "_dir/x.pptx", ".dot.pptx", ".folder/y.pptx", "~$lock.pptx", "._fork.pptx", "B.PPTX", "sub/deep/er/z.pptx", "sub/notes.txt", "sub/c.pptx"]


def fill(root, names=NAMES):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(decks.fixture() if name != "sub/c.pptx" else b"PK broken")


@pytest.mark.parametrize("hidden", ["audit", "export"])
@pytest.mark.parametrize("seeds", ["1", "2", "256"])
def test_executors_list_what_the_driver_lists(spark, tmp_path, hidden, seeds):
    fill(tmp_path)
    for only in ("", "sub"):
        got = listing.read_library(spark, str(tmp_path), hidden=hidden, seeds=seeds, only=only).collect()
        assert sorted((r.path, r.bytes) for r in got) == source.list_decks(str(tmp_path), hidden, only)
        assert all(abs(r.modified / 1e6 - time.time()) < 600 for r in got)


def test_sources_agree(spark, tmp_path):
    """The same rows whoever lists, and whatever the decks are dealt by."""
    fill(tmp_path)
    plain = lambda df: sorted(map(repr, df.collect()))
    for read, options in ((source.read_parts, {"content": r"\.(xml|rels)$"}), (source.read_decks, {"content": "true", "hidden": "export"}), (source.read_decks, {"only": "sub"})):
        assert plain(read(spark, str(tmp_path), **options)) == plain(read(spark, str(tmp_path), partition_bytes="2000", **options)) != []
    assert [r.path for r in listing.read_library(spark, str(tmp_path / "a.pptx")).collect()] == [str(tmp_path / "a.pptx")]
    (tmp_path / "none").mkdir()
    assert listing.read_library(spark, str(tmp_path / "none")).count() == 0 == source.read_parts(spark, str(tmp_path / "none")).count()
    for wrong, error in (("sub/notes.txt", ValueError), ("nowhere", FileNotFoundError)):
        with pytest.raises(error):
            listing.read_library(spark, str(tmp_path / wrong))


def test_the_driver_holds_folders_not_paths(tmp_path):
    for folder in range(30):
        (tmp_path / f"top{folder}/inner").mkdir(parents=True)
        for i in range(100):
            (tmp_path / f"top{folder}/inner/deck{i}.pptx").touch()
    reader = listing.LibraryReader({"path": str(tmp_path), "seeds": "16"})
    dealt = reader.partitions()
    assert len(dealt) == 16 and sum(len(p.deep) for p in dealt) == 30 and len(pickle.dumps(dealt)) < 30 * 150
    assert max(len(p.deep) for p in dealt) == 2
    assert sum(b.num_rows for p in dealt for b in reader.read(p)) == 3000


def test_stream_resumes_and_equals_the_batch(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    fill(root, NAMES[:4])

    def run(batch="2"):
        stream = streaming.deck_stream(spark, str(root), str(tmp_path / "log"), rows="decks", batch=batch)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    rows = lambda: sorted((r.path, r.bytes, r.status) for r in spark.read.parquet(out).collect())
    batch = lambda: sorted((r.path, r.bytes, r.status) for r in source.read_decks(spark, str(root)).collect())
    run()
    assert rows() == batch() and len(rows()) == 3 and any("_draft" in p for p, _, _ in rows())
    run()
    assert rows() == batch()  # nothing twice
    fill(root, NAMES[4:])
    run("3")
    assert rows() == batch() and len(rows()) == 6
    before = rows()
    (root / "a.pptx").write_bytes(s.deck([s.slide([s.shape(2, "A", "a")])]))
    os.utime(root / "a.pptx", (1, 1))
    run()
    assert sorted(set(rows()) - set(before)) == [x for x in batch() if x[0].endswith("/a.pptx")] and len(rows()) == 7


def test_an_increment_that_was_lost_is_the_same_again(tmp_path):
    root = tmp_path / "in"
    fill(root, NAMES[:2])
    options = {"path": str(root), "log": str(tmp_path / "log"), "rows": "decks"}
    reader = streaming.DeckStreamReader(options)
    start, end = reader.initialOffset(), reader.latestOffset()
    first = [sorted(p.decks) for p in reader.partitions(start, end)]
    fill(root, ["later.pptx"])
    again = streaming.DeckStreamReader(options)  # a query that is started anew, before it has committed
    assert [sorted(p.decks) for p in again.partitions(start, end)] == first
    assert again.latestOffset() == {"batch": 1} and [p.decks[0][0] for p in again.partitions(end, {"batch": 1})] == [str(root / "later.pptx")]
    assert again.latestOffset() == {"batch": 1}
