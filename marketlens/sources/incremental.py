"""S2 kept up to date: the customer table from partial states, as files arrive in any order.

All order- and event-derived columns are minima, maxima and sums, so a batch of new rows becomes one partial row for each customer it concerns, and
partial rows of different batches merge.  The state is a folder of four Parquet tables, bucketed by the key they are read by:

* ``partials`` (customer key): what a batch adds to a customer;
* ``customers`` (customer key): customer rows;
* ``orders`` (order key): order and customer, to place line items that come after their order;
* ``spend`` (order key): money by order, to place orders that come after their line items.

A batch computes the part of ``orders x spend`` that is new -- new money of known orders, known money of new orders, and new with new -- so that each line is
counted once whenever it comes.  The known sides are read by bucket and are not exchanged; a batch with few orders reads their buckets only.
Building the profile aggregates ``partials`` and joins ``customers``, both by bucket, without any exchange of them.

A batch's rows carry its number and count only when its manifest row, written last, is there: a batch that died halfway is invisible and is
applied again under a new number.  ``compact`` replaces all partial rows by one for each customer in the same way.  One writer at a time.
"""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.schema import CAMPAIGN_COLUMNS, PRODUCT_COLUMNS
from marketlens.session import materialize
from marketlens.sources.profile import CHANNEL_COLUMNS, error_counts, order_aggregates, order_facts, order_product_spend, profile_columns

#: A batch with at most this number of orders names them to the scan, which then opens their buckets only.
PRUNE_KEYS = 1000

_SUMS = [*PRODUCT_COLUMNS, *CHANNEL_COLUMNS]
_MAXIMA = [*CAMPAIGN_COLUMNS, "Response"]
_PARTIAL = ", ".join(["custkey BIGINT", "first_order DATE", "last_order DATE", *[f"{c} BIGINT" for c in _SUMS], *[f"{c} INT" for c in _MAXIMA], "n_errors BIGINT", "batch BIGINT"])
_TABLES = {"partials": ("custkey", _PARTIAL),
           "customers": ("c_custkey", "c_custkey BIGINT, c_nationkey BIGINT, c_acctbal DOUBLE, c_mktsegment STRING, batch BIGINT"),
           "orders": ("o_orderkey", "o_orderkey BIGINT, o_custkey BIGINT, batch BIGINT"),
           "spend": ("l_orderkey", "l_orderkey BIGINT, " + ", ".join(f"{c} BIGINT" for c in PRODUCT_COLUMNS) + ", batch BIGINT")}
_MANIFEST = "batch long, compacted boolean"


class ProfileState:
    """State below ``folder`` with ``buckets`` buckets (fixed when the folder is new)."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        known = self._manifest("buckets", "buckets int")
        if known is None:
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(f"{self.folder}/_buckets")
        else:
            self.buckets = known.first()["buckets"]
        name = hashlib.sha256(self.folder.encode()).hexdigest()[:16]
        self.names = {t: f"marketlens_{t}_{name}" for t in _TABLES}
        for t, (key, columns) in _TABLES.items():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.names[t]} ({columns}) USING parquet CLUSTERED BY ({key}) INTO {self.buckets} BUCKETS "
                      f"LOCATION '{self.folder}/{t}'")

    # ---- batches that count ------------------------------------------------------------------------
    def _manifest(self, name: str, schema: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.schema(schema).json(str(path)) if fs.exists(path) else None

    def batches(self) -> list[tuple[int, bool]]:
        """Numbers of complete batches in order, and whether each is a compaction."""
        found = self._manifest("batches", _MANIFEST)
        return sorted((r["batch"], r["compacted"]) for r in found.collect()) if found is not None else []

    def _commit(self, batch: int, compacted: bool) -> None:
        self.spark.createDataFrame([(batch, compacted)], _MANIFEST).coalesce(1).write.mode("append").json(f"{self.folder}/_batches")

    def _visible(self, table: str) -> list[int]:
        known = self.batches()
        if table != "partials":
            return [b for b, compacted in known if not compacted]
        bases = [b for b, compacted in known if compacted]
        return [b for b, _ in known if not bases or b >= bases[-1]]

    def table(self, name: str) -> DataFrame:
        """Rows of complete batches."""
        self.spark.catalog.refreshTable(self.names[name])
        return self.spark.table(self.names[name]).where(F.col("batch").isin(self._visible(name)))

    def _add(self, name: str, rows: DataFrame, batch: int) -> None:
        key = _TABLES[name][0]
        columns = [c.split()[0] for c in _TABLES[name][1].split(", ")]
        rows.withColumn("batch", F.lit(batch)).select(*columns).repartition(self.buckets, key).write.insertInto(self.names[name])

    # ---- adding -----------------------------------------------------------------------------------
    def _known(self, name: str, keys: DataFrame, key: str) -> DataFrame:
        """Rows of an order-keyed table, cut to the buckets of ``keys`` when these are few."""
        rows = self.table(name).drop("batch")
        some = [r[0] for r in keys.select(key).distinct().limit(PRUNE_KEYS + 1).collect()]
        return rows if len(some) > PRUNE_KEYS else rows.where(F.col(_TABLES[name][0]).isin(some))

    def apply(self, part: DataFrame | None = None, customer: DataFrame | None = None, orders: DataFrame | None = None, lineitem: DataFrame | None = None,
              events: DataFrame | None = None) -> int:
        """Take in new rows of any of the tables (``lineitem`` needs ``part``); returns the batch number."""
        batch = max([time.time_ns(), *[b + 1 for b, _ in self.batches()]])
        spend_sums = [F.sum(c).alias(c) for c in PRODUCT_COLUMNS]
        new = []
        facts = materialize(order_facts(orders)) if orders is not None else None
        money = None
        if lineitem is not None:
            if part is None:
                raise ValueError("line items need the parts")
            money = materialize(order_product_spend(lineitem, part))
        placed = []
        if facts is not None:
            known = self._known("spend", facts, "o_orderkey")
            placed.append(facts.join(known, facts["o_orderkey"] == known["l_orderkey"]).select("o_custkey", *[known[c] for c in PRODUCT_COLUMNS]))
        if money is not None:
            known = self._known("orders", money, "l_orderkey")
            placed.append(money.join(known, money["l_orderkey"] == known["o_orderkey"]).select("o_custkey", *PRODUCT_COLUMNS))
        if facts is not None and money is not None:
            placed.append(facts.join(money, facts["o_orderkey"] == money["l_orderkey"]).select("o_custkey", *[money[c] for c in PRODUCT_COLUMNS]))
        for p in placed:
            new.append(p.groupBy(F.col("o_custkey").alias("custkey")).agg(*spend_sums))
        if facts is not None:
            rows = facts.groupBy(F.col("o_custkey").alias("custkey"))
            new.append(rows.agg(F.min("odate").alias("first_order"), F.max("odate").alias("last_order"), *[F.sum(c).alias(c) for c in CHANNEL_COLUMNS],
                                *[F.max(c).alias(c) for c in _MAXIMA]))
        if events is not None:
            new.append(error_counts(events).withColumnRenamed("user_id", "custkey"))
        if new:
            both = new[0]
            for n in new[1:]:
                both = both.unionByName(n, allowMissingColumns=True)
            for c, kind in (x.split() for x in _PARTIAL.split(", ")):
                if c not in both.columns and c != "batch":
                    both = both.withColumn(c, F.lit(None).cast(kind))
            self._add("partials", both, batch)
        if facts is not None:
            self._add("orders", facts.select("o_orderkey", "o_custkey"), batch)
        if money is not None:
            self._add("spend", money, batch)
        if customer is not None:
            self._add("customers", customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), batch)
        self._commit(batch, False)
        return batch

    def _merged(self) -> DataFrame:
        rows = self.table("partials")
        return rows.groupBy("custkey").agg(*order_aggregates("first_order", "last_order"), F.sum("n_errors").alias("n_errors"))

    def compact(self) -> int:
        """One partial row for each customer; earlier ones no longer count."""
        batch = max([time.time_ns(), *[b + 1 for b, _ in self.batches()]])
        self._add("partials", self._merged(), batch)
        self._commit(batch, True)
        return batch

    def profile(self) -> DataFrame:
        """The customer table of everything taken in so far."""
        merged, cust = self._merged(), self.table("customers").drop("batch")
        latest = self.table("partials").agg(F.max("last_order").alias("latest_order"))
        joined = cust.join(merged, cust["c_custkey"] == merged["custkey"], "left").crossJoin(F.broadcast(latest))
        return profile_columns(joined)
