"""Customer-level work: rollup, revenue ranking, segments, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import div0, money, percent
from .ordering import row_numbers

# Segments in value order, and the share of buyers in the first two.
SEGMENTS = ["High value", "Mid value", "Core value", "Window shoppers"]
HIGH_SHARE, MID_SHARE = 0.2, 0.3


def rollup(df: DataFrame) -> DataFrame:
    """One row per customer. Every aggregate combines map-side, so busy customers are safe."""
    return df.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.coalesce(F.sum("purchased"), F.lit(0)).alias("purchases"),
        F.coalesce(F.sum("revenue_cents"), F.lit(0)).alias("revenue_cents"))


def ranked(customers: DataFrame) -> DataFrame:
    """Customers numbered by revenue, ties by id; spenders come first."""
    return row_numbers(customers, F.col("revenue_cents").desc(), F.col("customer_id").asc())


def segment_of(rn: Column, revenue: Column, buyers: Column) -> Column:
    high = F.ceil(buyers * F.lit(HIGH_SHARE))
    mid = F.ceil(buyers * F.lit(MID_SHARE))
    return (F.when(revenue <= 0, SEGMENTS[3]).when(rn <= high, SEGMENTS[0])
            .when(rn <= high + mid, SEGMENTS[1]).otherwise(SEGMENTS[2]))


def with_segments(customers: DataFrame) -> DataFrame:
    """Pareto segment of every customer, relative to the spenders in the same frame."""
    numbered = ranked(customers)
    buyers = numbered.agg(F.count_if(F.col("revenue_cents") > 0)).scalar()
    return numbered.withColumn(
        "segment", segment_of(F.col("rn"), F.col("revenue_cents"), buyers))


def assignments(segmented: DataFrame) -> DataFrame:
    """Customer, revenue, revenue rank (spenders only) and segment."""
    return segmented.select(
        "customer_id", money(F.col("revenue_cents")).alias("revenue"),
        F.when(F.col("revenue_cents") > 0, F.col("rn")).alias("rn"), "segment")


def _segment_order(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), name).cast("int")


def segment_sums(segmented: DataFrame) -> DataFrame:
    """At most four rows of additive segment sums."""
    return segmented.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("revenue_cents").alias("revenue_cents"),
        F.sum("purchases").alias("purchases"), F.sum("sessions").alias("sessions"),
        F.count_if(F.col("purchases") >= 2).alias("repeat"),
        F.count_if(F.col("purchases") >= 1).alias("purchasers"),
    ).withColumn("seg_ord", _segment_order(F.col("segment")))


def segments(sums: DataFrame) -> DataFrame:
    """Segment table from ``segment_sums``, to be read by seg_ord; the window spans its four rows."""
    every = Window.partitionBy()
    c = F.col
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    revenue = money(c("revenue_cents"))
    return sums.select(
        "segment", "seg_ord", "customers",
        zero(percent(c("customers"), F.sum("customers").over(every))).alias("customer_share"),
        revenue.alias("revenue"),
        zero(percent(revenue, money(F.sum("revenue_cents").over(every)))).alias("revenue_share"),
        div0(revenue, c("customers")).alias("avg_revenue"), "purchases", "sessions",
        zero(percent(c("purchases"), c("sessions"))).alias("conversion"),
        zero(div0(revenue, c("purchases"))).alias("aov"),
        div0(c("sessions"), c("customers")).alias("sessions_per_customer"), "repeat",
        percent(c("repeat"), c("customers")).alias("repeat_rate"))


def pareto_curve(sums: DataFrame) -> DataFrame:
    """Cumulative customer and revenue share in segment order (four rows)."""
    every, so_far = Window.partitionBy(), Window.partitionBy().orderBy("seg_ord").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)

    def share(name: str) -> Column:
        cumulated = percent(F.sum(name).over(so_far), F.sum(name).over(every))
        return F.round(F.coalesce(cumulated, F.lit(0.0)), 2)

    return sums.select("segment", "seg_ord", share("customers").alias("cum_customers"),
                       share("revenue_cents").alias("cum_revenue"))


def headline(sums: DataFrame) -> DataFrame:
    """Buyers, repeat buyers, never-purchased, and the high-value share by name."""
    is_high = F.col("segment") == SEGMENTS[0]
    one = sums.agg(
        F.coalesce(F.sum("customers"), F.lit(0)).alias("total_customers"),
        F.coalesce(F.sum("revenue_cents"), F.lit(0)).alias("_cents"),
        F.coalesce(F.sum("purchasers"), F.lit(0)).alias("buyers"),
        F.coalesce(F.sum("repeat"), F.lit(0)).alias("repeat_buyers"),
        F.max(F.when(is_high, F.col("customers"))).alias("high_customers"),
        F.max(F.when(is_high, F.col("revenue_cents"))).alias("_high_cents"))
    c = F.col
    never = c("total_customers") - c("buyers")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return one.select(
        "total_customers", money(c("_cents")).alias("total_revenue"), "buyers", "repeat_buyers",
        zero(percent(c("repeat_buyers"), c("buyers"))).alias("repeat_rate"),
        never.alias("never_purchased"),
        zero(percent(never, c("total_customers"))).alias("never_pct"),
        "high_customers", percent(c("high_customers"), c("total_customers")).alias("high_customer_share"),
        money(c("_high_cents")).alias("high_revenue"),
        percent(money(c("_high_cents")), money(c("_cents"))).alias("high_revenue_share"))


def purchase_frequency(customers: DataFrame) -> DataFrame:
    """Buying customers by number of purchases; four and more share one bar."""
    return (customers.filter(F.col("purchases") >= 1)
            .groupBy(F.least(F.col("purchases"), F.lit(4)).alias("n"))
            .agg(F.count(F.lit(1)).alias("customers"))
            .select("n", F.when(F.col("n") < 4, F.col("n").cast("string")).otherwise("4+").alias("label"),
                    "customers"))


def sessions_histogram(customers: DataFrame, bars: int = 12) -> DataFrame:
    """Customers by number of sessions, the lowest ``bars`` values."""
    return (customers.groupBy("sessions").agg(F.count(F.lit(1)).alias("customers"))
            .orderBy("sessions").limit(bars))
