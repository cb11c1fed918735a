"""Totals, grouped metrics and slicer options."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dimensions import DIMENSIONS
from ..functions.metrics import (ADDITIVE, CUSTOMER_DISTINCT, METRICS, PRODUCT_DISTINCT, TOTALS,
                                 closed, merged, needed_bases)


def base_aggregates(df: DataFrame, keys: dict[str, Column], needs: Iterable[str],
                    costly_input: bool = False) -> DataFrame:
    """Base aggregates per key.

    Additive ones come from a single map-side-combined pass. Distinct customers come from a
    second, narrow pass that first shrinks the rows to one per (key, customer) with two
    flags; distinct products likewise. That replaces ``count(distinct)``, which would
    multiply every fact row by the number of distinct expressions before the shuffle.

    Where reading ``df`` again costs more than a wider shuffle (it holds a join), the additive
    ones ride along with the customer pass instead of taking their own.
    """
    needs = set(needs)
    names = list(keys)
    by = [key.alias(name) for name, key in keys.items()]
    additive = [n for n in ADDITIVE if n in needs]
    parts = []
    together = costly_input and additive and needs & CUSTOMER_DISTINCT
    if (additive or not needs) and not together:
        parts.append(df.groupBy(*by).agg(
            *[ADDITIVE[n]().alias(f"b_{n}") for n in additive or ["sessions"]]))
    if needs & CUSTOMER_DISTINCT:
        carried = additive if together else []
        known = F.col("customer_id").isNotNull()
        people = ((df if together else df.filter(known)).groupBy(*by, "customer_id")
                  .agg(*[ADDITIVE[n]().alias(f"b_{n}") for n in carried],
                       F.max(F.col("purchased") == 1).alias("_bought"),
                       F.max(F.col("purchased") == 0).alias("_browsed")))
        counts = {"customers": F.count("customer_id"), "buyers": F.count_if(known & F.col("_bought")),
                  "browsers": F.count_if(known & F.col("_browsed"))}
        parts.append(people.groupBy(*names).agg(
            *[merged(n) for n in carried],
            *[c.alias(f"b_{n}") for n, c in counts.items() if n in needs]))
    if needs & PRODUCT_DISTINCT:
        items = df.filter(F.col("product_id").isNotNull()).select(*by, "product_id").distinct()
        parts.append(items.groupBy(*names).agg(F.count(F.lit(1)).alias("b_products")))
    if len(parts) == 1:
        return parts[0]
    # The parts hold disjoint columns, so a grouped max lines them up without a join.
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    values = [c for c in stacked.columns if c not in names]
    return stacked.groupBy(*names).agg(*[F.max(c).alias(c) for c in values])


def fold(cube: DataFrame, *names: str) -> DataFrame:
    """Merge a frame of additive base aggregates down to fewer keys."""
    bases = [c[2:] for c in cube.columns if c.startswith("b_")]
    return cube.groupBy(*names).agg(*[merged(b) for b in bases])


def overall(df: DataFrame, metrics: Iterable[str]) -> DataFrame:
    """One row of metrics; nothing to measure reads as 0.0."""
    metrics = list(metrics)
    return zero_filled(base_aggregates(df, {}, needed_bases(metrics)), metrics)


def zero_filled(bases: DataFrame, metrics: Iterable[str], *keep: str) -> DataFrame:
    return bases.select(*keep, *[
        F.coalesce(METRICS[m].close().cast("double"), F.lit(0.0)).alias(m) for m in metrics])


def totals(df: DataFrame) -> DataFrame:
    return overall(df, TOTALS)


def finish_group(bases: DataFrame, dim: str, metrics: list[str], limit: int | None = None,
                 order: str = "revenue", asc: bool = False) -> DataFrame:
    """Close, label and order grouped base aggregates (key column ``key``)."""
    dimension = DIMENSIONS[dim]
    out = bases.select("key", dimension.label(F.col("key")).alias("label"), *closed(metrics),
                       *([METRICS[order].close().alias("_order")] if order != "key" else []))
    if dimension.by_key:
        ranked = out.orderBy(F.col("key").asc())
    else:
        target = F.col("key") if order == "key" else F.col("_order")
        ranked = out.orderBy(target.asc() if asc else target.desc(), F.col("key").asc())
    if limit:
        ranked = ranked.limit(limit)
    return ranked.drop("_order")


def group(df: DataFrame, dim: str, metrics: Iterable[str], limit: int | None = None,
          order: str = "revenue", asc: bool = False) -> DataFrame:
    """Metrics per value of a dimension, with its label; ties go to the smaller key."""
    metrics = list(metrics)
    ordered_by = [] if order == "key" or DIMENSIONS[dim].by_key else [order]
    bases = base_aggregates(df, {"key": DIMENSIONS[dim].key()}, needed_bases(metrics + ordered_by))
    return finish_group(bases, dim, metrics, limit, order if ordered_by else "key", asc)


def options(df: DataFrame, dim: str) -> DataFrame:
    """The values a slicer may offer, with label and session count."""
    counted = df.groupBy(DIMENSIONS[dim].key().alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return (counted.filter(F.col("value").isNotNull())
            .select("value", DIMENSIONS[dim].label(F.col("value")).alias("label"), "n")
            .orderBy("value"))


def discount_correlation(df: DataFrame) -> DataFrame:
    """Pearson correlation of discount depth and purchase, six decimals."""
    return df.agg(F.round(F.corr("discount_percent", "purchased"), 6).alias("pearson"))
