"""Functions of rows: an Arrow batch is never held whole as Python objects."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deckhouse.functions import binary, rows
from deckhouse.operators import builds, library
from deckhouse.plans import queries
from deckhouse.plans import synthetic as s

DECK = s.deck([s.slide([s.shape(2, "T", "t"), s.shape(3, "a", "b")], [s.click(3)])], extra={"ppt/fonts/font1.fntdata": b"font"})
SLIDE = s.slide([s.shape(3, "a", "b")], [s.click(3)]).encode()


@pytest.mark.parametrize(
    ("function", "value"),
    [(builds.click_effects, SLIDE), (builds.slide_states, SLIDE), (builds.expansion, DECK), (builds.deck_faults, DECK), (builds.without_fonts, DECK), (binary.gif_frame_count, s.gif(2)), (queries._deck_bytes, [1, 0, 2]), (queries._pdf_bytes, 2)],
)
def test_a_few_rows_at_a_time(function, value):
    """Every row has its result, in order, and no batch of results is longer than ROWS."""
    batch = pa.array([value, None if isinstance(value, bytes) else value] * 300)
    got = list(function.func(iter([batch, batch.slice(0, 1)])))
    assert max(map(len, got)) <= rows.ROWS and sum(map(len, got)) == 601
    assert all(x.to_pylist() == [got[0][i % 2].as_py() for i in range(len(x))] for x in got)


def test_large_rows_come_alone():
    large = pa.array([bytes(3 << 20)] * 5)
    assert [len(x) for x in binary.gif_frame_count.func(iter([large]))] == [1] * 5


def test_notes_and_two_columns():
    pdf, notes = pa.array([s.pdf(2), None, b"x"] * 100), pa.array([[(1, "one"), (2, "two")], None, [(1, "a")]] * 100, pa.map_(pa.int32(), pa.string()))
    got = list(builds.annotated.func(iter([(pdf, notes)])))
    assert max(map(len, got)) <= rows.ROWS
    all_rows = [r for x in got for r in x.to_pylist()]
    assert [(r["added"], r["error"] is None) for r in all_rows] == [(2, True), (0, False), (0, False)] * 100
    assert all_rows[0]["pdf"].startswith(s.pdf(2))


def test_one_python_function_a_part_in_the_audit(spark):
    """Slides and GIFs are opened by one function, beside the one of a deck's aspect."""
    parts = spark.createDataFrame(
        [("/a", "a", 1, "ppt/slides/slide1.xml", 10, SLIDE, 1, None), ("/a", "a", 1, "ppt/media/g.gif", 20, s.gif(3), 2, None), ("/a", "a", 1, "ppt/media/one.gif", 20, s.gif(1), 3, None), ("/a", "a", 1, "ppt/media/x.gif", 20, None, 4, None)],
        "path string, name string, bytes long, part string, part_bytes long, content binary, ordinal long, error string",
    )
    records = library.deck_records(parts, spark.createDataFrame([], "key string"))
    r = records.select("animated_slides", "build_states", "gifs", F.size("fonts").alias("n")).collect()[0]
    assert tuple(r) == (1, 1, 1, 0)
    assert records._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2
