"""S1 customer-file loader and S5/S6 sinks.

The loader reads a delimited customer file with an explicit schema (no
inference pass).  Like the published loader it tries tab first and falls back
to comma when the header line has no tab; only the first line is read to
decide.  Parquet is the main format.  Sinks write partitioned output with the
DataFrame writer; nothing passes through the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.schema import CUSTOMER_SCHEMA
from marketlens.session import ensure_checkpoint_dir


def sniff_separator(spark: SparkSession, path: str) -> str:
    header = spark.read.text(path).limit(1).collect()
    line = header[0][0] if header else ""
    return "\t" if "\t" in line else ","


def load_customers(spark: SparkSession, path: str, fmt: str | None = None, schema=CUSTOMER_SCHEMA) -> DataFrame:
    """Customer table from Parquet, TSV or CSV; NaN becomes NULL."""
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        sep = sniff_separator(spark, path)
        df = (spark.read.schema(schema).option("header", True).option("sep", sep)
              .option("mode", "PERMISSIVE").option("nanValue", "NaN").csv(path))
    # NaN is a value in Spark; the workflow treats it as missing.
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            df = df.withColumn(f.name, F.when(F.isnan(f.name), None).otherwise(F.col(f.name)))
    return df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint location."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    """Header CSV (one folder of part files)."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    return path


def write_json_rows(df: DataFrame, path: str) -> str:
    """JSON lines, one object per row."""
    df.write.mode("overwrite").json(path)
    return path


def write_json_documents(df: DataFrame, path: str, name: str) -> str:
    """One JSON file for each value of ``name`` (a report of each model, say), in folders ``name=value``."""
    df.select(name, F.to_json(F.struct(*[c for c in df.columns if c != name])).alias("value")) \
        .repartition(name).write.mode("overwrite").partitionBy(name).text(path)
    return path
