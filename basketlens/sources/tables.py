"""Adapter from the order tables to shop sessions: one order is one session.

A folder that holds a stored ``sessions`` table is read from there instead, so every query
runs unchanged on the raw tables and on a built store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import SEASON_OF_MONTH, SOURCE_COLUMNS
from ..session import prepare
from .cleaning import complete
from .store import stored_sessions

# Channel code of each market segment; anything else is 4.
CHANNELS = {"AUTOMOBILE": 0, "BUILDING": 1, "FURNITURE": 2, "HOUSEHOLD": 3}
# Upper bounds (exclusive) of the session-length buckets.
DURATIONS = [(300, "Very Short"), (900, "Short"), (1500, "Long")]


def _cases(branches: list[tuple[str, object]], other: object) -> str:
    inner = " ".join(f"WHEN {test} THEN {value!r}" for test, value in branches)
    return f"CASE {inner} ELSE {other!r} END"


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    stored = stored_sessions(spark, folder)
    return stored if stored is not None else adapt_orders(spark, folder)


def adapt_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions from orders, line items and customers.

    Both lookups are aggregated to their join key first. Catalyst then knows the key is
    unique and drops the whole join from any query that reads none of its columns.
    """
    table = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    lines = table("lineitem").groupBy("l_orderkey").agg(*map(F.expr, [
        "count(1) AS n_lines", "min(l_partkey) AS part_id", "CAST(sum(l_quantity) AS BIGINT) AS qty_sum",
        "3 * CAST(round(min(l_discount) * 100) AS INT) AS disc", "CAST(max(l_shipdate) AS DATE) AS ship"]))
    customers = table("customer").groupBy("c_custkey").agg(*map(F.expr, [
        "max(c_nationkey) AS nation", "max(c_acctbal) AS balance", "max(c_mktsegment) AS market"]))
    orders = (table("orders")
              .join(lines, F.expr("l_orderkey = o_orderkey"), "left")
              .join(customers, F.expr("c_custkey = o_custkey"), "left"))
    channel = _cases([(f"market = {m!r}", c) for m, c in CHANNELS.items()], 4)
    length = _cases([(f"time_on_site_sec < {bound}", name) for bound, name in DURATIONS], "Very Long")
    season = _cases([(f"month(visit_date) = {m}", code) for m, code in SEASON_OF_MONTH.items()], 0)
    first = orders.selectExpr(
        "o_orderkey AS session_id", "o_custkey AS customer_id", "CAST(o_orderdate AS DATE) AS visit_date",
        "IF(o_orderstatus IN ('F', 'P'), 1, 0) AS added_to_cart",
        "IF(o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH'), 1, 0) AS purchased",
        "floor(o_totalprice / 2.5D) AS unit_cents", "coalesce(n_lines, 0L) AS quantity",
        "coalesce(disc, 0) AS discount_percent",
        "CAST(floor(coalesce(qty_sum, 0) / 10D) AS INT) AS pages_viewed",
        "greatest(coalesce(datediff(ship, CAST(o_orderdate AS DATE)), 0), 0) AS time_on_site_sec",
        "coalesce(part_id, -1L) AS product_id",
        "CAST(o_orderkey % 8 AS INT) AS product_category", "CAST(o_orderkey % 6 AS INT) AS payment_method",
        "CAST(o_orderkey % 3 AS INT) AS device_type",
        "CAST(o_orderkey % 7 AS INT) AS review_helpful_votes",
        "CAST(o_orderkey % 11 AS INT) AS review_code", "IF(balance >= 4500, 1, 0) AS user_type",
        f"{channel} AS marketing_channel", "nation AS location",
        "CAST(1 + o_orderkey % 5 AS INT) AS raw_rating")
    second = first.selectExpr(
        "*", "unit_cents * quantity AS gross_cents",
        "(unit_cents * quantity * discount_percent + 50) div 100 AS discount_cents",
        "added_to_cart - purchased AS cart_abandoned", "IF(purchased = 1, raw_rating, 4) AS rating",
        f"{season} AS season", f"{length} AS duration_bucket")
    third = second.selectExpr(
        "*", "IF(purchased = 1, gross_cents - discount_cents, 0L) AS revenue_cents",
        "IF(purchased = 1, gross_cents - discount_cents, 0L) / 1000000D AS revenue_normalized")
    return complete(third)


def _money_text(cents: str) -> str:
    return f"CAST(CAST(CAST({cents} AS DECIMAL(18,0)) / 100 AS DECIMAL(18,2)) AS STRING)"


def raw_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The same sessions as raw text rows in the source header, with planted defects.

    No row is left out. By session id, dates turn unreadable (every 97th), quantities go
    blank (89th), rows repeat (83rd) and discounts are off by five cents (79th).
    """
    every = lambda n, then, other: f"IF(session_id % {n} = 0, {then}, {other})"
    text = {
        "visit_date": every(97, "'bad-date'", "date_format(visit_date, 'dd-MM-yyyy')"),
        "quantity": every(89, "''", "CAST(quantity AS STRING)"),
        "unit_price": _money_text("unit_cents"),
        "discount_amount": _money_text("discount_cents + " + every(79, 5, 0)),
        "revenue": _money_text("revenue_cents"),
        "review_text": "CAST(review_code AS STRING)",
        "visit_weekday": "CAST(weekday AS STRING)", "visit_season": "CAST(season AS STRING)",
        "session_duration_bucket": "duration_bucket",
        "revenue_normalized": "CAST(CAST(CAST(revenue_cents AS DECIMAL(18,0)) / 1000000 AS DECIMAL(18,4)) AS STRING)",
    }
    rows = sessions(spark, folder).selectExpr(
        *[f"{text.get(c, f'CAST({c} AS STRING)')} AS {c}" for c in SOURCE_COLUMNS],
        f"explode({every(83, 'array(0, 1)', 'array(0)')}) AS copy")
    return rows.drop("copy")


def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The event stream read as a flag table: one event is one session of a user."""
    prepare(spark)
    kind = F.col("event_type")
    return spark.read.parquet(f"{folder}/events.parquet").select(
        F.col("event_id").alias("session_id"), F.col("user_id").alias("customer_id"),
        F.col("ts").cast("date").alias("visit_date"),
        F.when(kind.isin("click", "purchase"), 1).otherwise(0).alias("added_to_cart"),
        F.when(kind == "purchase", 1).otherwise(0).alias("purchased"),
        F.when(kind == "click", 1).otherwise(0).alias("cart_abandoned"),
        F.when(kind == "purchase", F.floor(F.col("value") * 100)).otherwise(0).alias("revenue_cents"))
