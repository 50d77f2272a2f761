"""The result set of a track, published at once.

A result set is several tables that belong together.  Each publication writes all of them below a folder of its own version, and then,
last, one manifest row naming the version and its tables.  Readers look at manifests only: they see a version when all its tables are
complete, and a job that dies halfway leaves files that no manifest names.  Old versions stay readable until ``drop_versions`` removes them.

Tables are Parquet, CSV or JSON.  A table that is looked up by a key can be *clustered* by it: range-partitioned and sorted, with a Parquet
bloom filter and row groups whose statistics are narrow, so that a lookup of one key reads a row group instead of the table.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = "version string, tables string"


@dataclass(frozen=True)
class Table:
    """How one table is written: ``parquet``, ``csv`` or ``json``; ``key``: clustered for lookups by that column (Parquet only)."""

    rows: DataFrame
    fmt: str = "parquet"
    key: str | None = None


def clustered(rows: DataFrame, key: str, path: str, row_group_bytes: int = 8 << 20, n_parts: int | None = None) -> None:
    """Parquet files sorted by ``key``, each over a range of it, with bloom filters for it."""
    ranged = rows.repartitionByRange(n_parts, key) if n_parts else rows.repartitionByRange(key)
    (ranged.sortWithinPartitions(key).write.option("parquet.block.size", row_group_bytes)
     .option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path))


def _write(table: Table, path: str) -> None:
    if table.key is not None:
        if table.fmt != "parquet":
            raise ValueError("only Parquet tables can be clustered")
        clustered(table.rows, table.key, path)
    elif table.fmt == "parquet":
        table.rows.write.parquet(path)
    elif table.fmt == "csv":
        table.rows.write.option("header", True).csv(path)
    elif table.fmt == "json":
        table.rows.write.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unknown format {table.fmt}")


def publish(spark: SparkSession, folder: str, tables: Mapping[str, Table | DataFrame]) -> str:
    """Write a new version of the result set and then its manifest; returns the version."""
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    listed = {}
    for name, table in tables.items():
        table = table if isinstance(table, Table) else Table(table)
        _write(table, f"{folder}/{version}/{name}")
        listed[name] = {"format": table.fmt, "key": table.key, "schema": table.rows.schema.jsonValue()}
    manifest = spark.createDataFrame([(version, json.dumps(listed))], _MANIFEST).coalesce(1)
    manifest.write.json(f"{folder}/_manifests/{version}")  # one file, which appears when it is complete
    return version


def versions(spark: SparkSession, folder: str) -> dict[str, dict]:
    """Complete versions and their tables, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_manifests")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    done = [str(f.getPath()) for f in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    if not done:
        return {}
    return {r["version"]: json.loads(r["tables"]) for r in sorted(spark.read.schema(_MANIFEST).json(done).collect())}


def read_result(spark: SparkSession, folder: str, name: str, version: str | None = None) -> DataFrame:
    """One table of the last complete version (or of ``version``)."""
    known = versions(spark, folder)
    if not known:
        raise FileNotFoundError(f"no complete result set in {folder}")
    version = version or max(known)
    about = known[version][name]
    schema, path = T.StructType.fromJson(about["schema"]), f"{folder}/{version}/{name}"
    if about["format"] == "csv":
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.schema(schema).format(about["format"]).load(path)


def lookup(spark: SparkSession, folder: str, name: str, value, version: str | None = None) -> DataFrame:
    """Rows of a clustered table with the given key; the filter reaches the files' statistics and bloom filters."""
    known = versions(spark, folder)
    if not known:
        raise FileNotFoundError(f"no complete result set in {folder}")
    version = version or max(known)
    key = known[version][name]["key"]
    if key is None:
        raise ValueError(f"{name} is not clustered by a key")
    return read_result(spark, folder, name, version).where(F.col(key) == F.lit(value))


def drop_versions(spark: SparkSession, folder: str, keep: int = 1) -> list[str]:
    """Remove all but the last ``keep`` complete versions: the manifest first, then the tables."""
    old = sorted(versions(spark, folder))[:-keep] if keep else sorted(versions(spark, folder))
    conf = spark._jsc.hadoopConfiguration()
    for version in old:
        for part in (f"{folder}/_manifests/{version}", f"{folder}/{version}"):
            path = spark._jvm.org.apache.hadoop.fs.Path(part)
            path.getFileSystem(conf).delete(path, True)
    return old
