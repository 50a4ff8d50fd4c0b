"""Functions of one row's values as Spark columns, by Arrow batches."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows, and bytes of their arguments, that are Python objects at a time.
ROWS, BYTES = 256, 4 << 20


def by_rows(returns: T.DataType):
    """Make a column function of a function of one row's values (null: None; maps: pairs; structs are returned as dicts).

    An Arrow batch holds up to 10,000 rows, whose packages and trees as Python objects, with what is made of them, would fill a worker. Only a
    few rows are that at a time, and their results go on before the next are made.
    """

    def column(of: Callable):
        kind = to_arrow_type(returns)

        def few(columns: tuple[pa.Array, ...]) -> Iterator[pa.Array]:
            n = len(columns[0])
            rows = max(1, min(ROWS, BYTES * n // (1 + sum(c.nbytes for c in columns))))
            for at in range(0, n, rows):
                yield pa.array([of(*row) for row in zip(*(c.slice(at, rows).to_pylist() for c in columns), strict=True)], kind)

        def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield from few((batch,))

        def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for batch in batches:
                yield from few(batch)

        return F.arrow_udf(one if len(inspect.signature(of).parameters) == 1 else several, returns)

    return column
