"""V1-V4: deterministic hash splits and folds keyed by customer id.

Row order inside a stratum is fixed by a portable integer mix of the key and the
seed (two rounds of the MINSTD generator), so the same split comes out on any
partitioning and in DuckDB.  ``test`` = the first ``ceil(frac * n)`` rows of
each stratum in (hash, key) order; fold = (rank - 1) mod k.

A global ``row_number`` per stratum would put a whole class into one task.
Instead the hash range is cut into 65,536 buckets: a grouped count per
(stratum, bucket) gives each bucket its starting offset, and ranks are numbered only inside a bucket.
The rank equals the stratum-wide row number exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODULUS = 2147483647  # 2^31 - 1
MULTIPLIER = 48271
BUCKET_SHIFT = 15  # hash < 2^31 -> 65,536 buckets
SEED = 42


def key_hash(key: str | Column, seed: int = SEED) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    h1 = (k.cast("bigint") * MULTIPLIER + seed) % MODULUS
    return (h1 * MULTIPLIER) % MODULUS


def key_hash_sql(key: str, seed: int = SEED) -> str:
    return f"(((CAST({key} AS BIGINT) * {MULTIPLIER} + {seed}) % {MODULUS}) * {MULTIPLIER}) % {MODULUS}"


def hash_rank(df: DataFrame, key: str = "ID", strata: Sequence[str] = (), seed: int = SEED) -> DataFrame:
    """Adds ``_rank`` (1-based row number in (hash, key) order per stratum) and ``_n``."""
    strata = list(strata)
    d = df.withColumn("_h", key_hash(key, seed)).withColumn("_b", F.shiftright(F.col("_h"), BUCKET_SHIFT))
    hist = d.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w_cum = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*strata)
    offsets = hist.select(*strata, "_b",
                          F.coalesce(F.sum("_cnt").over(w_cum), F.lit(0)).alias("_off"),
                          F.sum("_cnt").over(w_all).alias("_n"))
    ranked = d.join(offsets, [*strata, "_b"])  # keyed like the window that follows
    w_in = Window.partitionBy(*strata, "_b").orderBy("_h", key)
    return (ranked.withColumn("_rank", F.col("_off") + F.row_number().over(w_in))
            .drop("_h", "_b", "_off"))


def split_flag(df: DataFrame, test_size: float = 0.2, key: str = "ID", strata: Sequence[str] = (),
               seed: int = SEED, col: str = "is_test") -> DataFrame:
    """V1 (with strata) / V2 (without): boolean test flag, exact test counts.

    Only the place of the last test row is needed: counts by hash bucket say in which bucket it lies, and the rows
    of that bucket alone are ranked.  The rows of ``df`` meet one row for each stratum and are not shuffled by rank.
    """
    strata = list(strata)
    d = df.withColumn("_h", key_hash(key, seed)).withColumn("_b", F.shiftright(F.col("_h"), BUCKET_SHIFT))
    hist = d.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w_cum = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    placed = hist.select(*strata, "_b", "_cnt", F.coalesce(F.sum("_cnt").over(w_cum), F.lit(0)).alias("_off"),
                         F.ceil(F.sum("_cnt").over(Window.partitionBy(*strata)) * F.lit(test_size)).alias("_want"))
    cut = (placed.where((F.col("_off") < F.col("_want")) & (F.col("_want") <= F.col("_off") + F.col("_cnt")))
           .select(*strata, "_b", (F.col("_want") - F.col("_off")).alias("_need")))
    near = d.select(*strata, "_b", "_h", key).join(cut, [*strata, "_b"])
    rank = F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_h", key))
    last = (near.withColumn("_rank", rank).where(F.col("_rank") == F.col("_need"))
            .select(*[F.col(c).alias("_s_" + c) for c in strata], F.col("_h").alias("_last_h"), F.col(key).alias("_last_key")))
    same = F.lit(True)
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col("_s_" + c))
    h = key_hash(key, seed)
    test = (h < F.col("_last_h")) | ((h == F.col("_last_h")) & (F.col(key) <= F.col("_last_key")))
    return df.join(last, same, "left").select(*df.columns, F.coalesce(test, F.lit(False)).alias(col))


def fold_column(df: DataFrame, n_folds: int = 5, key: str = "ID", strata: Sequence[str] = (),
                seed: int = SEED, col: str = "fold") -> DataFrame:
    """V3 (with strata) / V4 (without): fold id 0..k-1 covering every row."""
    r = hash_rank(df, key, strata, seed)
    return r.withColumn(col, ((F.col("_rank") - 1) % n_folds).cast("int")).drop("_rank", "_n")


def split_sql(source: str, test_size: float = 0.2, key: str = "ID", strata: Sequence[str] = (),
              seed: int = SEED) -> str:
    part = f"PARTITION BY {', '.join(strata)} " if strata else ""
    return (f"SELECT *, row_number() OVER ({part}ORDER BY {key_hash_sql(key, seed)}, {key}) <= "
            f"ceil(count(*) OVER ({part.strip()}) * {test_size}) AS is_test FROM {source}")


def fold_sql(source: str, n_folds: int = 5, key: str = "ID", strata: Sequence[str] = (), seed: int = SEED) -> str:
    part = f"PARTITION BY {', '.join(strata)} " if strata else ""
    return (f"SELECT *, CAST((row_number() OVER ({part}ORDER BY {key_hash_sql(key, seed)}, {key}) - 1) % {n_folds} "
            f"AS INTEGER) AS fold FROM {source}")


def split_and_folds(df: DataFrame, test_size: float = 0.2, n_folds: int = 5, key: str = "ID",
                    strata: Sequence[str] = (), seed: int = SEED) -> DataFrame:
    """V1/V2 flag and V3/V4 fold from one hash rank (same values as the two separate calls)."""
    r = hash_rank(df, key, strata, seed)
    return (r.withColumn("is_test", F.col("_rank") <= F.ceil(F.col("_n") * F.lit(test_size)))
            .withColumn("fold", ((F.col("_rank") - 1) % n_folds).cast("int"))
            .drop("_rank", "_n"))
