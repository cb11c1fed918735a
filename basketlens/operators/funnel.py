"""Funnel steps and drop-offs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.dimensions import DIMENSIONS
from ..functions.numbers import percent
from .aggregate import base_aggregates

STEP_BASES = ["sessions", "carts", "purchases"]


def funnel_rows(bases: DataFrame, *keys: str) -> DataFrame:
    """Three rows per aggregated row: count, share of sessions, loss against the step before."""
    filled = bases.select(*keys, *[F.coalesce(f"b_{n}", F.lit(0)).alias(n) for n in STEP_BASES])
    steps = filled.select(*keys, F.stack(
        F.lit(3),
        F.lit(1), F.lit("Sessions"), F.col("sessions"), F.col("sessions"), F.lit(None).cast("bigint"),
        F.lit(2), F.lit("Added to cart"), F.col("carts"), F.col("sessions"), F.col("sessions"),
        F.lit(3), F.lit("Purchased"), F.col("purchases"), F.col("sessions"), F.col("carts"),
    ).alias("step_ord", "step", "value", "_all", "_before"))
    c = F.col
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    share = F.when(c("step_ord") == 1, 100.0).otherwise(zero(percent(c("value"), c("_all"))))
    later = c("step_ord") > 1
    return steps.select(
        *keys, "step_ord", "step", "value", share.alias("pct_of_sessions"),
        F.when(later, zero(percent(c("value"), c("_before")))).alias("pct_of_previous"),
        (c("_before") - c("value")).alias("lost"),
        F.when(later, zero(percent(c("_before") - c("value"), c("_before")))).alias("lost_pct"))


def funnel(df: DataFrame) -> DataFrame:
    return funnel_rows(base_aggregates(df, {}, STEP_BASES)).orderBy("step_ord")


def funnel_by(df: DataFrame, dim: str) -> DataFrame:
    bases = base_aggregates(df, {"key": DIMENSIONS[dim].key()}, STEP_BASES)
    rows = funnel_rows(bases, "key")
    label = DIMENSIONS[dim].label(F.col("key")).alias("label")
    return rows.select("key", label, *rows.columns[1:]).orderBy("key", "step_ord")
