"""Dimension registry: how to compute a group key, and how to label a finished key.

Labels depend on the key alone, so they are computed on the few grouped rows rather than
carried through the aggregation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .numbers import case
from ..model import CODE_LABELS, SEASON_NAMES, WEEKDAY_NAMES

# Labels of the discount and price buckets, by key 0..3.
DISCOUNT_LABELS = ["0% (no discount)", "5–10%", "11–20%", "21–30%"]
PRICE_LABELS = ["≤ ₹500", "₹501–1,000", "₹1,001–1,500", "₹1,501–2,000"]
# Upper bounds of buckets 0..2 (percent; cents).
DISCOUNT_BOUNDS = [0, 10, 20]
PRICE_BOUNDS = [50_000, 100_000, 150_000]


@dataclass(frozen=True)
class Dimension:
    key: Callable[[], Column]
    label: Callable[[Column], Column]
    by_key: bool = False  # natural order is the key, not the size


def month_name(month: Column) -> Column:
    return F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMM")


def weekday_name(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), day + 1)


def season_name(season: Column) -> Column:
    return case([(season == code, name) for code, name in SEASON_NAMES.items()], "Season NA")


def code_label(column: str) -> Callable[[Column], Column]:
    return lambda key: F.concat(F.lit(CODE_LABELS[column] + " "), key.cast("string"))


def _text(key: Column) -> Column:
    return key.cast("string")


def _floor_to(column: str, step: int) -> Column:
    return (F.floor(F.col(column) / F.lit(step)) * F.lit(step)).cast("int")


def _stepped(column: str, bounds: list[int]) -> Column:
    col = F.col(column)
    return case([(col == b if b == 0 else col <= b, i) for i, b in enumerate(bounds)], len(bounds))


def _listed(labels: list[str]) -> Callable[[Column], Column]:
    return lambda key: F.element_at(F.array(*[F.lit(v) for v in labels]), key + 1)


def _code(column: str) -> Dimension:
    return Dimension(lambda: F.col(column), code_label(column))


DIMENSIONS: dict[str, Dimension] = {
    "category": _code("product_category"),
    "payment": _code("payment_method"),
    "device": _code("device_type"),
    "user_type": _code("user_type"),
    "channel": _code("marketing_channel"),
    "location": _code("location"),
    "month": Dimension(lambda: F.col("visit_month"), month_name, True),
    "weekday": Dimension(lambda: F.col("weekday"), weekday_name, True),
    "season": Dimension(lambda: F.col("season"), season_name, True),
    "duration": Dimension(lambda: F.col("duration_bucket"), _text, True),
    "rating": Dimension(lambda: F.col("rating"),
                        lambda k: F.concat(_text(k), F.lit(" star")), True),
    "date": Dimension(lambda: _text(F.col("visit_date")), _text, True),
    "product": Dimension(lambda: F.col("product_id"),
                         lambda k: F.concat(F.lit("Product #"), _text(k))),
    "discount_band": Dimension(
        lambda: _floor_to("discount_percent", 5),
        lambda k: F.when(k == 0, "No discount").otherwise(
            F.concat(_text(k), F.lit("%-"), _text(k + 4), F.lit("%"))), True),
    "discount_bucket": Dimension(lambda: _stepped("discount_percent", DISCOUNT_BOUNDS),
                                 _listed(DISCOUNT_LABELS), True),
    "price_band": Dimension(lambda: _stepped("unit_cents", PRICE_BOUNDS),
                            _listed(PRICE_LABELS), True),
    "time_band": Dimension(
        lambda: _floor_to("time_on_site_sec", 300),
        lambda k: F.concat(_text((k / 60).cast("int")), F.lit("m")), True),
    # The shown range starts one above the key: the key 5 reads "6-10 pages".
    "pages_band": Dimension(
        lambda: _floor_to("pages_viewed", 5),
        lambda k: F.concat(_text(k + 1), F.lit("-"), _text(k + 5), F.lit(" pages")), True),
}


def register_dimension(name: str, key: Callable[[], Column],
                       label: Callable[[Column], Column] = _text, by_key: bool = False) -> None:
    DIMENSIONS[name] = Dimension(key, label, by_key)
