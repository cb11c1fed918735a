"""Metrics over time in buckets that fit the span of the rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.metrics import closed, needed_bases
from .aggregate import base_aggregates

# Longest span in days shown daily, and weekly; beyond that monthly.
DAILY_UP_TO, WEEKLY_UP_TO = 40, 240


def bucket_key(granularity: Column, day: Column) -> Column:
    # Weeks start on Monday; days before the first Monday of a year are week 00.
    week = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / F.lit(7))
    return (F.when(granularity == "day", day.cast("string"))
            .when(granularity == "week", F.concat(F.date_format(day, "yyyy"), F.lit("-W"),
                                                  F.lpad(week.cast("string"), 2, "0")))
            .otherwise(F.date_format(day, "yyyy-MM")))


def fitting_granularity(df: DataFrame) -> Column:
    """Granularity as a scalar of the rows' own date span."""
    days = F.coalesce(F.datediff(F.max("visit_date"), F.min("visit_date")), F.lit(0))
    return df.agg(F.when(days <= DAILY_UP_TO, "day").when(days <= WEEKLY_UP_TO, "week")
                  .otherwise("month")).scalar()


def trend(df: DataFrame, metrics: Iterable[str] = ("revenue", "sessions", "purchases"),
          granularity: str | None = None) -> DataFrame:
    """Metrics per day, week or month, oldest first; the granularity follows the span."""
    metrics = list(metrics)
    unit = F.lit(granularity) if granularity else fitting_granularity(df)
    tagged = df.withColumn("unit", unit).withColumn(
        "_bucket", bucket_key(F.col("unit"), F.col("visit_date")))
    keys = {"granularity": F.col("unit"), "key": F.col("_bucket")}
    bases = base_aggregates(tagged, keys, needed_bases(metrics) | {"first_day"})
    return finish_trend(bases, metrics).orderBy("key")


def finish_trend(bases: DataFrame, metrics: Iterable[str]) -> DataFrame:
    start = F.col("b_first_day")
    label = F.when(F.col("granularity") == "month", F.date_format(start, "MMM yy")).otherwise(
        F.date_format(start, "d MMM"))
    return bases.select("granularity", "key", label.alias("label"), *closed(metrics))
