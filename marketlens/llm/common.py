"""Helpers shared by the operators: written tables, word boundaries, byte batches."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.session import ensure_checkpoint_dir

#: Bytes of text one vectorised pass looks at; about ten arrays of eight times this size live at once.
PASS_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FOLDERS: dict[str, list[str]] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that does not exist yet, below the session's shared checkpoint folder."""
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    _FOLDERS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_written(spark: SparkSession) -> int:
    """Remove the intermediate tables (and unnamed ledgers) that this application wrote; returns how many.

    Results of the operators read them, so call it when those have been stored or are done with.
    """
    folders = _FOLDERS.pop(spark.sparkContext.applicationId, [])
    gone = 0
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder.

    Lineage ends there, and a lost executor takes nothing with it.  The files go
    with ``drop_written``, or when the folder of the session is cleared.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys with at least this number of rows may be broadcast, and at most this number of keys are.
HOT_ROWS, HOT_KEYS = 1000, 50_000


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined with ``table`` (one row for each ``key``), whatever a single key holds.

    Rows of keys with the most rows do not move: their part of ``table`` is broadcast.  A key counts as such from ``HOT_ROWS`` rows on, and from the
    ``HOT_KEYS``-th part of all rows on, so there are never more than ``HOT_KEYS`` of them.  Rows with a null key match nothing and do not move either.
    """
    some = rows.where(F.col(key).isNotNull())
    counts = written(some.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= HOT_ROWS), "key-counts")
    limit = max(HOT_ROWS, math.ceil((counts.agg(F.sum("__n")).first()[0] or 0) / HOT_KEYS))
    hot = counts.where(F.col("__n") >= limit).select(key)
    added = [c for c in table.columns if c != key]
    none = rows.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in added])
    if counts.isEmpty():
        return some.join(table, key, "left").unionByName(none)
    names = F.broadcast(hot)
    cold = some.join(names, key, "left_anti").join(table, key, "left")
    warm = some.join(F.broadcast(hot.join(table, key, "left")), key)
    return cold.unionByName(warm).unionByName(none)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once an application, as ``--py-files`` would."""
    sc = spark.sparkContext
    if getattr(sc, "_marketlens_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="marketlens-code-")) / f"{package.name}-code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(f.relative_to(package.parent)))
    sc.addPyFile(str(target))  # Spark's own file service hands it to every executor
    sc._marketlens_shipped = True


def tidied(result=None):
    """``result``, after Arrow's pool gave the system what it holds without use; workers wait between stages and would keep it."""
    pa.default_memory_pool().release_unused()
    return result


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand in the tasks."""
    ship(df.sparkSession)

    def run_tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidied()

    return df.mapInArrow(run_tidied, schema)


def parts_for(n_rows: int, per_part: int, least: int = 1) -> int:
    """Number of pieces of at most ``per_part`` rows on average; grows with the rows, without a cap."""
    return max(least, math.ceil(n_rows / per_part))


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string column without copying the text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset: column.offset + len(column) + 1].astype(np.int64)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def passes(offsets: np.ndarray, most: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) holding at most ``most`` bytes; a longer row is a run of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (Steele, Lea and Flood's finaliser)."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
