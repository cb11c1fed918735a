"""Metric registry.

A metric is a closing expression over *base* aggregates. Base aggregates are either
additive (they can be computed per group, stored, and merged again, which is what the
report cubes do) or distinct counts of customers or products, which are taken from a
narrow pre-aggregation instead of ``count(distinct)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .numbers import div0, money, percent

bought = lambda: F.col("purchased") == 1


def wide(name: str) -> Column:
    """A whole number whose square still fits."""
    return F.col(name).cast("bigint")


ADDITIVE: dict[str, Callable[[], Column]] = {
    "sessions": lambda: F.count(F.lit(1)),
    "purchases": lambda: F.sum("purchased"),
    "carts": lambda: F.sum("added_to_cart"),
    "abandoned": lambda: F.sum("cart_abandoned"),
    "revenue": lambda: F.sum("revenue_cents"),
    "gross": lambda: F.sum("gross_cents"),
    "discount": lambda: F.sum("discount_cents"),
    "units": lambda: F.sum("quantity"),
    "price": lambda: F.sum("unit_cents"),
    "percent": lambda: F.sum("discount_percent"),
    "rated": lambda: F.count_if(bought()),
    "stars": lambda: F.sum(F.when(bought(), F.col("rating"))),
    "votes": lambda: F.sum(F.when(bought(), F.col("review_helpful_votes"))),
    "seconds": lambda: F.sum("time_on_site_sec"),
    "pages": lambda: F.sum("pages_viewed"),
    # second moments of discount depth and purchase, for their correlation
    "percent_sq": lambda: F.sum(wide("discount_percent") * wide("discount_percent")),
    "percent_bought": lambda: F.sum(wide("discount_percent") * wide("purchased")),
    "purchases_sq": lambda: F.sum(wide("purchased") * wide("purchased")),
    "top_revenue": lambda: F.max("revenue_cents"),
    "first_day": lambda: F.min("visit_date"),
    "last_day": lambda: F.max("visit_date"),
}
MERGES = {"top_revenue": F.max, "first_day": F.min, "last_day": F.max}  # all others add up
CUSTOMER_DISTINCT = {"customers", "buyers", "browsers"}
PRODUCT_DISTINCT = {"products"}


def base(name: str) -> Column:
    """Column of a base aggregate inside an aggregated frame."""
    return F.col(f"b_{name}")


def merged(name: str) -> Column:
    """Aggregate that merges stored partial values of an additive base."""
    return MERGES.get(name, F.sum)(f"b_{name}").alias(f"b_{name}")


def correlation(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    """Pearson correlation from sums and sums of products."""
    return div0(n * xy - x * y, F.sqrt((n * xx - x * x) * (n * yy - y * y)))


@dataclass(frozen=True)
class Metric:
    kind: str
    needs: tuple[str, ...]
    close: Callable[[], Column]


def _plain(kind: str, name: str) -> Metric:
    return Metric(kind, (name,), lambda: base(name))


def _zeroed(kind: str, name: str) -> Metric:
    return Metric(kind, (name,), lambda: F.coalesce(base(name), F.lit(0)))


def _money0(name: str) -> Metric:
    return Metric("inr", (name,), lambda: money(F.coalesce(base(name), F.lit(0))))


def _ratio(kind: str, top: str, bottom: str, close) -> Metric:
    return Metric(kind, (top, bottom), lambda: close(base(top), base(bottom)))


METRICS: dict[str, Metric] = {
    "sessions": _plain("count", "sessions"),
    "customers": _plain("count", "customers"),
    "purchases": _plain("count", "purchases"),
    "buyers": _plain("count", "buyers"),
    "browsers": _plain("count", "browsers"),
    "revenue": _money0("revenue"),
    "gross": _money0("gross"),
    "discount_value": _money0("discount"),
    "units": _zeroed("count", "units"),
    "aov": _ratio("inr", "revenue", "purchases", lambda a, b: div0(money(a), b)),
    "avg_price": _ratio("inr", "price", "sessions", lambda a, b: div0(money(a), b)),
    "conversion": _ratio("pct", "purchases", "sessions", percent),
    "cart_rate": _ratio("pct", "carts", "sessions", percent),
    "abandon_rate": _ratio("pct", "abandoned", "carts", percent),
    "carts": _plain("count", "carts"),
    "abandoned": _plain("count", "abandoned"),
    "avg_discount": _ratio("pct", "percent", "sessions", div0),
    "rating": _ratio("num1", "stars", "rated", div0),
    "rating_count": _plain("count", "rated"),
    "helpful_votes": _zeroed("count", "votes"),
    "avg_time": _ratio("sec", "seconds", "sessions", div0),
    "avg_pages": _ratio("num1", "pages", "sessions", div0),
    "revenue_per_customer": _ratio("inr", "revenue", "customers", lambda a, b: div0(money(a), b)),
    "sessions_per_customer": _ratio("num1", "sessions", "customers", div0),
    "purchases_per_buyer": _ratio("num2", "purchases", "buyers", div0),
    "products": _plain("count", "products"),
    "max_revenue": Metric("inr", ("top_revenue",), lambda: money(base("top_revenue"))),
}

METRICS["discount_correlation"] = Metric(
    "num2", ("sessions", "percent", "purchases", "percent_sq", "purchases_sq", "percent_bought"),
    lambda: F.round(correlation(*[base(n).cast("double") for n in (
        "sessions", "percent", "purchases", "percent_sq", "purchases_sq", "percent_bought")]), 6))

# The headline totals (every metric but "browsers").
TOTALS = [m for m in METRICS if m not in ("browsers", "discount_correlation")]


def register_metric(name: str, kind: str, close: Callable[[], Column],
                    additive: dict[str, Callable[[], Column]] | None = None,
                    needs: Iterable[str] = ()) -> None:
    """Add a metric; ``additive`` may bring new sum-merged base aggregates with it."""
    extra = additive or {}
    ADDITIVE.update(extra)
    METRICS[name] = Metric(kind, (*needs, *extra), close)


def needed_bases(metrics: Iterable[str]) -> set[str]:
    return {need for m in metrics for need in METRICS[m].needs}


GROUP_METRICS = [*TOTALS, "browsers"]


def closed(metrics: Iterable[str]) -> list[Column]:
    return [METRICS[m].close().alias(m) for m in metrics]
