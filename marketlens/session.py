"""Spark session helpers.

The library never hard-codes a cluster layout.  ``get_spark`` is only a
convenience for tests, the bench and local runs; on a cluster the caller
brings its own session and every operator works with it unchanged.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable

from pyspark.sql import SparkSession

# Broadcast ceiling used by every size-checked broadcast in the library and by
# AQE when it converts a shuffle join at run time (bytes).
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "marketlens") -> SparkSession:
    """Create (or return) a session configured for the library's plans."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    shuffle_partitions = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", str(BROADCAST_LIMIT_BYTES))
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", str(BROADCAST_LIMIT_BYTES))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the deployment (a shared file system);
    it is read from the session.  Only a local master (one machine, as in tests) gets a
    scratch folder when it is unset; elsewhere that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="marketlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def files_state(spark: SparkSession, folder: str, names: Iterable[str]) -> tuple:
    """Sizes and change times of tables, read through Spark's file system: differs once a table was rewritten."""
    jvm, conf, state = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            state += [(name, f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)]
    return tuple(state)


def materialize(df):
    """Reliable checkpoint of ``df`` (cuts lineage; survives executor loss).

    Writes under the session's shared checkpoint folder; never a local
    checkpoint.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
