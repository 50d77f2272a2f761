"""DuckDB oracle SQL, built from named CTE fragments.

Each query of the registry has an independent ANSI-SQL statement that starts
from the raw tables (``customer``, ``orders``, ``lineitem``, ``part``,
``events``, ``embeddings``) so the check does not trust any Spark output.
Fragments declare what they depend on; ``sql_with`` emits them in dependency
order as one ``WITH`` clause in front of the query body.
"""

from __future__ import annotations

from marketlens.schema import CAMPAIGN_COLUMNS, PRODUCT_COLUMNS, PURCHASE_COLUMNS, RAW_COLUMNS
from marketlens.sources.profile import (CAMPAIGN_PRICE, CAMPAIGN_YEARS, CHANNEL_COLUMNS,
                                        COMPLAIN_ERRORS, NATION_TO_MARITAL, ORDER_PRIORITIES,
                                        PART_TYPES, RESPONSE_YEAR, SEGMENT_TO_EDUCATION)

_FRAGMENTS: dict[str, tuple[str, tuple[str, ...]]] = {}


def fragment(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    _FRAGMENTS[name] = (sql, deps)


def sql_with(body: str, *needs: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _FRAGMENTS[n][1]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS (\n{_FRAGMENTS[n][0]}\n)" for n in order)
    return f"WITH {ctes}\n{body}"


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sql_str(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _case(expr: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {expr} = {sql_str(k) if isinstance(k, str) else k} THEN {sql_str(v)}"
                     for k, v in mapping.items())
    return f"CASE {whens} END"


# ---------------------------------------------------------------------------
# S2 customer profile
# ---------------------------------------------------------------------------
_money = "CAST(round(l.l_extendedprice * (1 - l.l_discount) / 100, 0) AS BIGINT)"
fragment("_order_spend", "SELECT l.l_orderkey,\n" + ",\n".join(
    f"  sum(CASE WHEN p.p_type = {sql_str(t)} THEN {_money} END) AS {c}"
    for t, c in zip(PART_TYPES, PRODUCT_COLUMNS))
    + "\nFROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey\nGROUP BY l.l_orderkey")

fragment("_customer_facts", "SELECT o.o_custkey,\n"
         "  min(CAST(o.o_orderdate AS DATE)) AS first_order,\n"
         "  max(CAST(o.o_orderdate AS DATE)) AS last_order,\n"
         + "".join(f"  CAST(sum(s.{c}) AS BIGINT) AS {c},\n" for c in PRODUCT_COLUMNS)
         + "".join(f"  CAST(count_if(o.o_orderpriority = {sql_str(p)}) AS BIGINT) AS {c},\n"
                   for p, c in zip(ORDER_PRIORITIES, CHANNEL_COLUMNS))
         + "".join(f"  max(CAST(year(o.o_orderdate) = {y} AND o.o_totalprice > {CAMPAIGN_PRICE} AS INTEGER)) AS {c},\n"
                   for y, c in zip(CAMPAIGN_YEARS, CAMPAIGN_COLUMNS))
         + f"  max(CAST(year(o.o_orderdate) = {RESPONSE_YEAR} AND o.o_orderstatus = 'F' AS INTEGER)) AS Response\n"
         "FROM orders o LEFT JOIN _order_spend s ON o.o_orderkey = s.l_orderkey\n"
         "GROUP BY o.o_custkey", ("_order_spend",))

fragment("_errors", "SELECT user_id, count(*) AS n_errors FROM events WHERE event_type = 'error' GROUP BY user_id")

_profile_cols = {
    "ID": "c.c_custkey",
    "Year_Birth": "CAST(CASE WHEN c.c_custkey % 499 = 3 THEN 1890 ELSE 1925 + (c.c_custkey * 37) % 60 END AS INTEGER)",
    "Education": _case("c.c_mktsegment", SEGMENT_TO_EDUCATION),
    "Marital_Status": _case("c.c_nationkey % 8", dict(enumerate(NATION_TO_MARITAL))),
    "Income": "CASE WHEN c.c_custkey % 97 = 0 THEN CAST(NULL AS DOUBLE) WHEN c.c_custkey % 501 = 7 "
              "THEN CAST(666666 AS DOUBLE) ELSE round(CAST(20000 AS DOUBLE) + 8 * (c.c_acctbal + 1000), 0) END",
    "Kidhome": "CAST(c.c_custkey % 3 AS INTEGER)",
    "Teenhome": "CAST((c.c_custkey % 7) % 3 AS INTEGER)",
    "Dt_Customer": "CASE WHEN c.c_custkey % 751 = 5 THEN '31-13-2000' ELSE strftime(f.first_order, '%d-%m-%Y') END",
    "Recency": "CAST(date_diff('day', f.last_order, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) AS INTEGER)",
}
for _c in PRODUCT_COLUMNS:
    _profile_cols[_c] = f"CASE WHEN c.c_custkey % 211 = 9 THEN CAST(0 AS BIGINT) ELSE coalesce(f.{_c}, CAST(0 AS BIGINT)) END"
for _c in CHANNEL_COLUMNS + CAMPAIGN_COLUMNS:
    _profile_cols[_c] = f"f.{_c}"
_profile_cols["Complain"] = f"coalesce(CAST(e.n_errors >= {COMPLAIN_ERRORS} AS INTEGER), 0)"
_profile_cols["Z_CostContact"] = "3"
_profile_cols["Z_Revenue"] = "11"
_profile_cols["Response"] = "coalesce(f.Response, 0)"
assert list(_profile_cols) == RAW_COLUMNS

fragment("customer_profile", "SELECT\n" + ",\n".join(f"  {v} AS {k}" for k, v in _profile_cols.items())
         + "\nFROM customer c\nLEFT JOIN _customer_facts f ON c.c_custkey = f.o_custkey\n"
         "LEFT JOIN _errors e ON c.c_custkey = e.user_id", ("_customer_facts", "_errors"))


# ---------------------------------------------------------------------------
# P1-P6 features and cleanings; the rules are written out here, not taken from the code under test
# ---------------------------------------------------------------------------
_RY = 2001  # fixed year of the clustering and recommendation tracks
RARE_SQL = "'Absurd', 'Alone', 'YOLO'"
PARTNER_SQL = "'Married', 'Together'"


def nz_sum(cols, cast="BIGINT") -> str:
    return f"CAST({' + '.join(f'coalesce({c}, 0)' for c in cols)} AS {cast})"


fragment("_dated", "SELECT * REPLACE (CAST(try_strptime(Dt_Customer, '%d-%m-%Y') AS DATE) AS Dt_Customer)\n"
         "FROM customer_profile", ("customer_profile",))
fragment("features",
         "SELECT d.* REPLACE (CASE WHEN d.Marital_Status IN (" + RARE_SQL + ") THEN 'Other' "
         "ELSE d.Marital_Status END AS Marital_Status),\n"
         "  CAST(date_diff('day', d.Dt_Customer, (SELECT max(Dt_Customer) FROM _dated)) AS INTEGER) AS CustomerTenure,\n"
         f"  CAST({_RY} - d.Year_Birth AS INTEGER) AS Age,\n"
         "  CAST(d.Kidhome + d.Teenhome AS INTEGER) AS TotalChildren,\n"
         f"  {nz_sum(PRODUCT_COLUMNS)} AS TotalSpending,\n"
         f"  {nz_sum(PURCHASE_COLUMNS)} AS TotalPurchases,\n"
         f"  {nz_sum(CAMPAIGN_COLUMNS, 'INTEGER')} AS CampaignAcceptedTotal\n"
         "FROM _dated d", ("_dated",))
CLS_KEEP = "Age BETWEEN 18 AND 100 AND (Income IS NULL OR Income <= 200000)"
# the classification track ages customers at the latest enrolment year of the table
fragment("cls_features", "SELECT * REPLACE (CAST((SELECT max(year(Dt_Customer)) FROM _dated) - Year_Birth AS INTEGER) AS Age) "
         "FROM features", ("features", "_dated"))
fragment("cls_clean", f"SELECT * FROM cls_features WHERE {CLS_KEEP}", ("cls_features",))
fragment("clu_clean", f"SELECT * FROM features WHERE {CLS_KEEP} AND CustomerTenure IS NOT NULL", ("features",))

fragment("_reg_base",
         "SELECT * REPLACE (CASE WHEN Marital_Status IN (" + RARE_SQL + ") THEN 'Other' "
         "ELSE Marital_Status END AS Marital_Status),\n"
         f"  CAST({_RY} - Year_Birth AS INTEGER) AS Age\n"
         "FROM customer_profile\n"
         f"WHERE {_RY} - Year_Birth BETWEEN 18 AND 100 AND (Income IS NULL OR Income <= 300000)",
         ("customer_profile",))
fragment("reg_prepared",
         "SELECT b.* REPLACE (coalesce(b.Marital_Status, (SELECT coalesce((SELECT Marital_Status FROM _reg_base "
         "WHERE Marital_Status IS NOT NULL GROUP BY Marital_Status ORDER BY count(*) DESC, Marital_Status LIMIT 1), "
         "'Other'))) AS Marital_Status),\n"
         "  CAST(coalesce(coalesce(b.Marital_Status, (SELECT Marital_Status FROM _reg_base WHERE Marital_Status IS NOT NULL "
         "GROUP BY Marital_Status ORDER BY count(*) DESC, Marital_Status LIMIT 1)) IN (" + PARTNER_SQL + "), false) AS INTEGER) AS HasPartner,\n"
         "  CAST(b.Kidhome + b.Teenhome AS INTEGER) AS TotalChildren\n"
         "FROM _reg_base b", ("_reg_base",))


# ---------------------------------------------------------------------------
# helpers for ranking / safe arithmetic
# ---------------------------------------------------------------------------
def sdiv(num: str, den: str) -> str:
    """``num / den`` with zero or NULL denominator -> 0 (DuckDB divides by zero to inf)."""
    return f"coalesce(({num}) / nullif({den}, 0), 0)"


def _scored_list(cols, names) -> str:
    items = ", ".join(f"{{'neg': -({c}), 'pos': {i}, 'product': {sql_str(n)}, 'score': {c}}}"
                      for i, (c, n) in enumerate(zip(cols, names)))
    return f"list_sort([{items}])"


def top1_sql(cols, names=None) -> str:
    return f"{_scored_list(cols, names or cols)}[1].product"


def banner_order_sql(cols, names=None) -> str:
    return f"array_to_string(list_transform({_scored_list(cols, names or cols)}, lambda x: x.product), ' > ')"


def banner_scores_sql(cols, names=None) -> str:
    return (f"array_to_string(list_transform({_scored_list(cols, names or cols)}, "
            f"lambda x: printf('%s:%.3f', x.product, x.score)), ' | ')")


# ---------------------------------------------------------------------------
# recommendation chain: shares -> split -> train prior -> relative scores
# ---------------------------------------------------------------------------
from marketlens.operators.split import fold_sql, split_sql  # noqa: E402

_TOT = nz_sum(PRODUCT_COLUMNS)
fragment("reg_shares", "SELECT ID, " + ", ".join(f"{c} / {_TOT} AS {c}" for c in PRODUCT_COLUMNS)
         + f" FROM reg_prepared WHERE {_TOT} > 0", ("reg_prepared",))
fragment("reg_split", split_sql("reg_shares"), ("reg_shares",))
fragment("reg_prior", "SELECT " + ", ".join(f"nullif(avg({c}), 0) AS prior_{c}" for c in PRODUCT_COLUMNS)
         + " FROM reg_split WHERE NOT is_test", ("reg_split",))
fragment("reg_relative", "SELECT s.ID, s.is_test, " + ", ".join(
    f"{sdiv('s.' + c, 'p.prior_' + c)} AS {c}" for c in PRODUCT_COLUMNS)
    + " FROM reg_split s CROSS JOIN reg_prior p", ("reg_split", "reg_prior"))
fragment("reg_top1", f"SELECT ID, is_test, {top1_sql(PRODUCT_COLUMNS)} AS Actual_Product FROM reg_relative",
         ("reg_relative",))
fragment("reg_baseline", "SELECT Actual_Product AS baseline_product FROM reg_top1 WHERE NOT is_test "
         "GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1", ("reg_top1",))
