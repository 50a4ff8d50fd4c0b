"""What the operators of this subpackage share: table access, stored steps, Arrow helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts mean it: space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a parquet table; other columns are never read, so their names can't clash."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only for a local master without it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="deckhouse-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(where)
        return where
    return where


def _written(df: DataFrame, name: str, packed: bool, by: str | None = None) -> str:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/deckhouse/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    # What the write shuffled is read again by nobody: Spark removes it once the step is written. Kinds of rows go to files side by side, unsorted.
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "8"}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        writer = df.write.option("compression", "none" if packed else "snappy")
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    return path


def store(df: DataFrame, name: str, packed: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors.

    ``packed``: the columns are compressed already; readers then need no buffers to inflate large pages.
    """
    return df.sparkSession.read.schema(df.schema).parquet(_written(df, name, packed))


def store_kinds(df: DataFrame, name: str, by: str, kinds: list[str], packed: bool = False) -> list[DataFrame]:
    """``store`` in one go for rows of a few ``kinds`` (values of the column ``by``), each of which can be unstored by itself."""
    spark = df.sparkSession
    path = _written(df, name, packed, by)
    rest = df.drop(by).schema
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={kind}")) for kind in kinds]
    return [spark.read.schema(rest).parquet(f"{path}/{by}={kind}") if found else spark.createDataFrame([], rest) for kind, found in zip(kinds, there, strict=True)]


def unstore(df: DataFrame) -> None:
    """Delete a stored step that nothing will read again."""
    jvm = df.sparkSession.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete every step stored by this application; call it once the results have been written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/deckhouse/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the strings of one column hold about ``most`` bytes in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def low_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: exactly what bytes.lower and bytes.split do."""
    return text.lower().split()


def word_count(column: str):
    """Number of words in a text column, JVM-side; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(F.col(column), F.lit(f"({WORD_PATTERN})"), F.lit(1))), F.lit(0)).cast("long")
