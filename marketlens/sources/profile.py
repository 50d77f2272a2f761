"""S2 ``build_customer_profile``: the 29-column customer table from the star schema.

Plan shape (designed for lineitem in the tens of billions of rows):

1. ``lineitem`` keeps three columns and meets ``part`` (two columns) on the part
   key; AQE broadcasts ``part`` when its run-time size is under the broadcast
   ceiling and falls back to a shuffle join (with skew splitting) otherwise.
2. Line money is summed per ``(order, product type)`` as six conditional sums
   grouped by order key.  This partial aggregate is hash-partitioned by order key,
   so the following join with ``orders`` shuffles only ``orders``.
3. One grouped aggregate by customer builds every order-based column at once
   (dates, six spends, five channel counters, five campaigns, response).  Hash
   aggregation combines map-side, so a customer holding a third of all orders
   costs one partial row per task, not a hot reducer.
4. ``customer`` is left-joined to that aggregate and to the per-user error
   count from ``events``; the table-wide latest order date is a one-row
   aggregate, broadcast (its size is one row by construction).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.schema import CAMPAIGN_COLUMNS, PRODUCT_COLUMNS, PURCHASE_COLUMNS, RAW_COLUMNS
from marketlens.sources.tables import Tables

# Fixed values of the fixture derivation (FIXTURES.md section 2).
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]  # -> PRODUCT_COLUMNS order
ORDER_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
CHANNEL_COLUMNS = PURCHASE_COLUMNS + ["NumWebVisitsMonth"]  # one per priority, same order
CAMPAIGN_YEARS = [1996, 1997, 1998, 1999, 2000]  # AcceptedCmp1..5
RESPONSE_YEAR = 2001
CAMPAIGN_PRICE = 400000
COMPLAIN_ERRORS = 15
SEGMENT_TO_EDUCATION = {
    "AUTOMOBILE": "Graduation",
    "BUILDING": "PhD",
    "FURNITURE": "Master",
    "HOUSEHOLD": "2n Cycle",
    "MACHINERY": "Basic",
}
NATION_TO_MARITAL = ["Married", "Together", "Single", "Divorced", "Widow", "Alone", "Absurd", "YOLO"]


def _case(col: Column, mapping: dict) -> Column:
    expr = None
    for key, value in mapping.items():
        expr = F.when(col == key, F.lit(value)) if expr is None else expr.when(col == key, F.lit(value))
    return expr


def order_product_spend(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Per order: whole-unit money per product type (six columns, null when absent)."""
    money = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) / 100, 0).cast("bigint")
    lines = lineitem.select("l_orderkey", "l_partkey", money.alias("money"))
    types = part.select(F.col("p_partkey").alias("l_partkey"), "p_type")
    typed = lines.join(types, "l_partkey")
    return typed.groupBy("l_orderkey").agg(
        *[F.sum(F.when(F.col("p_type") == t, F.col("money"))).alias(c)
          for t, c in zip(PART_TYPES, PRODUCT_COLUMNS)]
    )


def order_facts(orders: DataFrame) -> DataFrame:
    """Per order: key, customer and what the customer's columns are made of (no spend)."""
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("odate"), "o_orderpriority")
    year = F.year("odate")
    cols = [F.col("o_orderpriority").eqNullSafe(p).cast("bigint").alias(c) for p, c in zip(ORDER_PRIORITIES, CHANNEL_COLUMNS)]
    cols += [((year == y) & (F.col("o_totalprice") > CAMPAIGN_PRICE)).cast("int").alias(c) for y, c in zip(CAMPAIGN_YEARS, CAMPAIGN_COLUMNS)]
    return o.select("o_orderkey", "o_custkey", "odate", *cols, ((year == RESPONSE_YEAR) & (F.col("o_orderstatus") == "F")).cast("int").alias("Response"))


def order_aggregates(first: str = "odate", last: str = "odate") -> list[Column]:
    """Aggregates of order rows or of partial results of theirs: smallest, largest and sums only, so partial results merge."""
    return [F.min(first).alias("first_order"), F.max(last).alias("last_order"), *[F.sum(c).alias(c) for c in [*PRODUCT_COLUMNS, *CHANNEL_COLUMNS]],
            *[F.max(c).alias(c) for c in [*CAMPAIGN_COLUMNS, "Response"]]]


def customer_order_facts(orders: DataFrame, order_spend: DataFrame) -> DataFrame:
    """One aggregate by customer for every order-derived column."""
    o = order_facts(orders)
    joined = o.join(order_spend, o["o_orderkey"] == order_spend["l_orderkey"], "left")
    return joined.groupBy("o_custkey").agg(*order_aggregates())


def error_counts(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") == "error").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_errors"))


def build_customer_profile(tables: Tables) -> DataFrame:
    """The wide 29-column customer table, one row per customer, keyed by ``ID``."""
    spend = order_product_spend(tables.lineitem, tables.part)
    facts = customer_order_facts(tables.orders, spend)
    latest = tables.orders.agg(F.max(F.col("o_orderdate").cast("date")).alias("latest_order"))
    errors = error_counts(tables.events)
    cust = tables.customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    joined = (cust.join(facts, cust["c_custkey"] == facts["o_custkey"], "left")
              .join(errors, cust["c_custkey"] == errors["user_id"], "left")
              .crossJoin(F.broadcast(latest)))
    return profile_columns(joined)


def profile_columns(joined: DataFrame) -> DataFrame:
    """The 29 columns from customer rows with their order facts, ``n_errors`` and ``latest_order``."""
    key = F.col("c_custkey")
    no_spend = (key % 211) == 9
    cols = {
        "ID": key,
        "Year_Birth": F.when(key % 499 == 3, F.lit(1890))
                       .otherwise(F.lit(1925) + (key * 37) % 60).cast("int"),
        "Education": _case(F.col("c_mktsegment"), SEGMENT_TO_EDUCATION),
        "Marital_Status": _case(F.col("c_nationkey") % 8, dict(enumerate(NATION_TO_MARITAL))),
        "Income": F.when(key % 97 == 0, F.lit(None).cast("double"))
                   .when(key % 501 == 7, F.lit(666666.0))
                   .otherwise(F.round(F.lit(20000.0) + 8 * (F.col("c_acctbal") + 1000), 0)),
        "Kidhome": (key % 3).cast("int"),
        "Teenhome": ((key % 7) % 3).cast("int"),
        "Dt_Customer": F.when(key % 751 == 5, F.lit("31-13-2000"))
                        .otherwise(F.date_format("first_order", "dd-MM-yyyy")),
        "Recency": F.datediff("latest_order", "last_order"),
    }
    for c in PRODUCT_COLUMNS:
        cols[c] = F.when(no_spend, F.lit(0).cast("bigint")).otherwise(F.coalesce(F.col(c), F.lit(0).cast("bigint")))
    for c in CHANNEL_COLUMNS:
        cols[c] = F.col(c)
    for c in CAMPAIGN_COLUMNS:
        cols[c] = F.col(c)
    cols["Complain"] = F.coalesce((F.col("n_errors") >= COMPLAIN_ERRORS).cast("int"), F.lit(0))
    cols["Z_CostContact"] = F.lit(3)
    cols["Z_Revenue"] = F.lit(11)
    cols["Response"] = F.coalesce(F.col("Response"), F.lit(0))
    return joined.select(*[cols[c].alias(c) for c in RAW_COLUMNS])


def customer_profile(spark, sf_dir: str) -> DataFrame:
    """Convenience: profile of the tables in ``sf_dir``."""
    return build_customer_profile(Tables(spark, sf_dir))
