"""The four report pages and the computed findings.

A page reads the sliced sessions at most twice: once for a cube of additive base aggregates
over the page's few coded dimensions (hundreds of rows, checkpointed), and once for the
customer rollup or the products where those are shown. Every tile and chart is folded from
those. All four pages together read them twice as well (``every_page``).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dimensions import DIMENSIONS
from ..functions.metrics import ADDITIVE, closed, merged, needed_bases
from ..functions.numbers import percent
from ..model import DURATION_ORDER
from ..operators import customers as C
from ..operators.aggregate import base_aggregates, fold, zero_filled
from ..operators.funnel import funnel_rows
from ..operators.quality import split_products
from ..operators.trend import bucket_key, finish_trend, fitting_granularity
from ..session import literal, prepare
from . import frames

# Captions of the tiles, here and in the pages below, and the note of an empty page.
NO_ROWS = "No rows match these filters"
TREND_METRICS = ["revenue", "sessions", "purchases", "conversion"]


# Rows of a cube up to which one task folds it.
SMALL_CUBE = 100_000


def small_piece(cube: DataFrame) -> DataFrame:
    """The cube, pinned; a small one in one piece, as every fold reads it again."""
    cube = cube.checkpoint()
    return cube.coalesce(1).checkpoint() if cube.count() <= SMALL_CUBE else cube


def by_bucket(df: DataFrame) -> DataFrame:
    """Add the granularity that fits the span of the rows, and each row's bucket."""
    return df.withColumn("granularity", fitting_granularity(df)).withColumn(
        "bucket", bucket_key(F.col("granularity"), F.col("visit_date")))


class Cube:
    """Additive base aggregates over some dimensions of the sliced sessions.

    It holds one row per combination of codes shown on a page. While that is a small number it is
    brought together, and everything folded from it runs without a shuffle; a cube that free codes
    or texts made large stays distributed. ``times`` holds the buckets of the trend, if the cube
    itself does not.
    """

    def __init__(self, rows: DataFrame, times: DataFrame | None = None):
        self.rows, self.times = rows, rows if times is None else times

    @classmethod
    def over(cls, df: DataFrame, dims: Iterable[str], metrics: Iterable[str], by_time: bool = False) -> Cube:
        prepare(df.sparkSession)
        keys = {d: DIMENSIONS[d].key() for d in dims}
        needs = needed_bases(metrics) | {"sessions"}
        if by_time:
            df = by_bucket(df)
            keys |= {"granularity": F.col("granularity"), "bucket": F.col("bucket")}
            needs |= {"first_day"}
        return cls(small_piece(base_aggregates(df, keys, needs)))

    def empty(self) -> bool:
        return self.rows.isEmpty()

    def totals(self, metrics: Iterable[str]) -> DataFrame:
        return zero_filled(fold(self.rows), metrics)

    def by(self, dim: str, metrics: list[str]) -> DataFrame:
        """Metrics per key of a dimension, labelled."""
        return fold(self.rows, dim).select(
            F.col(dim).alias("key"), DIMENSIONS[dim].label(F.col(dim)).alias("label"), *closed(metrics))

    def by_size(self, dim: str, metrics: list[str], order: str = "revenue") -> DataFrame:
        return frames.numbered(self.by(dim, metrics), F.col(order).desc(), F.col("key"))

    def by_key(self, dim: str, metrics: list[str], *order: Column) -> DataFrame:
        return frames.numbered(self.by(dim, metrics), *(order or [F.col("key").asc_nulls_last()]))

    def trend(self, metrics: list[str]) -> DataFrame:
        buckets = fold(self.times, "granularity", "bucket").withColumnRenamed("bucket", "key")
        return frames.numbered(finish_trend(buckets, metrics), F.col("key"))

    def funnel(self) -> DataFrame:
        return funnel_rows(fold(self.rows))


class People:
    """Segmented customers of the sliced sessions and their four-row summary."""

    def __init__(self, df: DataFrame):
        self.rows = C.with_segments(C.rollup(df))
        self.sums = literal(C.segment_sums(self.rows))

    def headline(self) -> DataFrame:
        return C.headline(self.sums)

    def segments(self) -> DataFrame:
        return C.segments(self.sums).selectExpr("*", "seg_ord AS ord", "seg_ord AS key", "segment AS label")

    def pareto(self) -> DataFrame:
        return C.pareto_curve(self.sums).selectExpr("*", "seg_ord AS ord", "seg_ord AS key", "segment AS label")


# Dimensions and metrics of each page's cube, and whether it has a trend.
CUBES: dict[str, tuple[list[str], list[str], bool]] = {
    "overview": (["category", "user_type"], ["revenue", "purchases", "conversion", "aov", "abandon_rate"], True),
    "customers": (["user_type"], ["conversion", "abandon_rate", "revenue"], False),
    "conversion": (["user_type", "duration", "discount_bucket"],
                   ["purchases", "carts", "abandoned", "revenue", "discount_correlation"], False),
    "categories": (["category", "price_band", "payment"],
                   ["revenue", "purchases", "avg_price", "avg_discount"], False),
}


class Facts:
    """The sliced sessions behind a page; cube, customers and products take a pass each."""

    def __init__(self, df: DataFrame):
        self.df, self.spark = df, df.sparkSession

    def cube(self, page: str) -> Cube:
        dims, metrics, by_time = CUBES[page]
        return Cube.over(self.df, dims, metrics, by_time)

    @cached_property
    def people(self) -> People:
        return People(self.df)

    def products(self) -> DataFrame:
        return split_products(self.df)


class SharedFacts(Facts):
    """The sliced sessions behind all pages, read once for the customers and once for all else.

    The cubes are grouping sets of one aggregation, combined map-side. Days are a set of their own:
    they give the span as well as the buckets of the trend. So are products, of which a second
    step leaves two counts, so that the cubes stay as small as the pages' codes.
    """

    DAY, PRODUCT = ["visit_date"], ["product_id"]

    def __init__(self, df: DataFrame):
        super().__init__(df)
        prepare(self.spark)
        shown = [dims for dims, _, _ in CUBES.values()]
        # A set inside another one is folded from that.
        self.sets = [dims for dims in shown if not any(set(dims) < set(other) for other in shown)]
        self.dims = [d for d in DIMENSIONS if any(d in dims for dims in self.sets)]
        needs = {"sessions", "first_day"}.union(*[needed_bases(metrics) for _, metrics, _ in CUBES.values()])
        self.bases = [n for n in ADDITIVE if n in needs]
        self.rows = small_piece(self._aggregated())

    @property
    def _names(self) -> list[str]:
        return [*self.dims, *self.DAY, *self.PRODUCT]

    def _aggregated(self) -> DataFrame:
        keys = {f"k_{d}": DIMENSIONS[d].key() for d in self.dims}
        keys |= {f"k_{n}": F.col(n) for n in [*self.DAY, *self.PRODUCT]}
        sets = [[f"k_{n}" for n in names] for names in [*self.sets, self.DAY, self.PRODUCT]]
        low, high, product = F.col("_low"), F.col("_high"), F.col("k_product_id")
        cubes = self.df.withColumns(keys).groupingSets(sets, *keys).agg(
            *[ADDITIVE[n]().alias(f"b_{n}") for n in self.bases],
            F.min("product_category").alias("_low"), F.max("product_category").alias("_high"),
            F.grouping_id().alias("_set"))
        return cubes.groupBy("_set", *[k for k in keys if k != "k_product_id"]).agg(
            *[merged(n) for n in self.bases], F.count(product).alias("products"),
            F.count_if(product.isNotNull() & (low < high)).alias("split"))

    def _of(self, names: list[str]) -> DataFrame:
        """Rows of one grouping set; its id has a bit for each column left out, the first one highest."""
        left_out = int("".join("0" if n in names else "1" for n in self._names), 2)
        return self.rows.filter(F.col("_set") == left_out)

    def _bases(self) -> list[str]:
        return [f"b_{n}" for n in self.bases]

    def cube(self, page: str) -> Cube:
        dims, _, by_time = CUBES[page]
        held = next(names for names in self.sets if set(dims) <= set(names))
        rows = self._of(held).select(*[F.col(f"k_{d}").alias(d) for d in held], *self._bases())
        if not by_time:
            return Cube(rows)
        days = self._of(self.DAY).select(F.col("k_visit_date").alias("visit_date"), *self._bases())
        return Cube(rows, by_bucket(days))

    def products(self) -> DataFrame:
        return self._of(self.PRODUCT).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("products", "split")])


def _duration_order() -> Column:
    place = F.array_position(F.array(*[F.lit(d) for d in DURATION_ORDER]), F.col("key"))
    return F.when(place == 0, 9).otherwise(place)


# --------------------------------------------------------------------------- findings
# Cells over People.headline().
def never_purchased(section: int) -> list:
    return frames.finding(section, "never_purchased", [
        ("share", None, "never_pct", "pct2"), ("customers", None, "never_purchased", "count"),
        ("of_customers", None, "total_customers", "count")])


def high_value(section: int) -> list:
    return frames.finding(section, "high_value", [
        ("customer_share", None, "high_customer_share", "pct2"),
        ("revenue_share", None, "high_revenue_share", "pct2"),
        ("customers", None, "high_customers", "count"), ("revenue", None, "high_revenue", "inr")])


def repeat_rate(section: int) -> list:
    return frames.finding(section, "repeat_rate", [
        ("rate", None, "repeat_rate", "pct2"), ("repeat_buyers", None, "repeat_buyers", "count"),
        ("buyers", None, "buyers", "count")])


def _one(df: DataFrame, *aggregates: str) -> DataFrame:
    return df.agg(*map(F.expr, aggregates))


def user_type_gap(cube: Cube, page: str, section: int) -> DataFrame:
    """Best and worst user type by conversion, and the gaps in points."""
    one = _one(cube.by("user_type", ["conversion", "abandon_rate"]),
               "max_by(label, struct(conversion, -key)) AS best",
               "max_by(label, struct(-conversion, -key)) AS worst",
               "max(conversion) AS high", "min(conversion) AS low",
               "max(conversion) - min(conversion) AS gap",
               "max(abandon_rate) - min(abandon_rate) AS abandon_gap")
    return frames.rows(one, page, frames.finding(section, "user_type_gap", [
        ("best_conversion", "best", "high", "pct2"), ("worst_conversion", "worst", "low", "pct2"),
        ("gap_points", None, "gap", "num2"), ("abandonment_gap_points", None, "abandon_gap", "num2")]))


def leading_categories(cube: Cube, page: str, section: int) -> DataFrame:
    """Category with the most revenue and category with the best conversion."""
    one = _one(cube.by("category", ["revenue", "conversion"]),
               "max_by(label, struct(revenue, -key)) AS rich", "max(revenue) AS rich_revenue",
               "max_by(conversion, struct(revenue, -key)) AS rich_conversion",
               "max_by(label, struct(conversion, -key)) AS keen", "max(conversion) AS keen_conversion",
               "max_by(revenue, struct(conversion, -key)) AS keen_revenue")
    return frames.rows(one, page, frames.finding(section, "leading_categories", [
        ("most_revenue", "rich", "rich_revenue", "inr"),
        ("most_revenue_conversion", "rich", "rich_conversion", "pct2"),
        ("best_conversion", "keen", "keen_conversion", "pct2"),
        ("best_conversion_revenue", "keen", "keen_revenue", "inr")]))


def duration_effect(cube: Cube, page: str, section: int) -> DataFrame:
    """Conversion of the shortest and the longest session bucket present."""
    placed = cube.by("duration", ["conversion"]).withColumn("place", _duration_order())
    one = _one(placed, "min_by(label, struct(place, key)) AS short", "max_by(label, struct(place, key)) AS long",
               "min_by(conversion, struct(place, key)) AS short_rate",
               "max_by(conversion, struct(place, key)) AS long_rate")
    return frames.rows(one, page, frames.finding(section, "duration_effect", [
        ("shortest", "short", "short_rate", "pct2"), ("longest", "long", "long_rate", "pct2")]))


def discount_effect(cube: Cube, page: str, section: int) -> DataFrame:
    """Order value without and with the deepest discount, conversion spread, correlation."""
    one = _one(cube.by("discount_bucket", ["aov", "conversion"]),
               "min_by(label, key) AS none", "min_by(aov, key) AS none_aov",
               "max_by(label, key) AS deep", "max_by(aov, key) AS deep_aov",
               "max(conversion) - min(conversion) AS spread",
               ).withColumn("pearson", cube.totals(["discount_correlation"]).scalar())
    return frames.rows(one, page, frames.finding(section, "discount_effect", [
        ("aov_shallow", "none", "none_aov", "rupee"), ("aov_deep", "deep", "deep_aov", "rupee"),
        ("conversion_spread_points", None, "spread", "num2"), ("pearson", None, "pearson", "num2")]))


def price_window(cube: Cube, page: str, section: int) -> DataFrame:
    """Revenue share of unit prices from 501 to 1,500."""
    inside = F.when(F.col("price_band").isin(1, 2), F.col("b_revenue")).otherwise(0)
    one = cube.rows.agg(F.coalesce(percent(F.sum(inside), F.sum("b_revenue")), F.lit(0.0)).alias("share"))
    return frames.rows(one, page, frames.finding(section, "price_window", [
        ("revenue_share", "'₹501–1,500'", "share", "pct")]))


def funnel_leak(cube: Cube, page: str, section: int) -> DataFrame:
    """Share lost before and after the cart, and where more sessions are lost."""
    one = _one(cube.funnel(),
               "max(IF(step_ord = 2, lost_pct, NULL)) AS before", "max(IF(step_ord = 3, lost_pct, NULL)) AS after",
               "max_by(step_ord, struct(lost, -step_ord)) AS worst", "max(lost) AS most")
    return frames.rows(one, page, frames.finding(section, "funnel_leak", [
        ("before_cart", None, "before", "pct"), ("after_cart", None, "after", "pct"),
        ("largest", "IF(worst = 2, 'before the cart', 'after the cart')", "most", "count")]))


def conversion_stability(rates: DataFrame, page: str, section: int) -> DataFrame:
    """Range and deviation of conversion over the trend buckets."""
    one = _one(rates, "min(conversion) AS low", "max(conversion) AS high", "stddev_samp(conversion) AS deviation")
    return frames.rows(one, page, frames.finding(section, "conversion_stability", [
        ("lowest", None, "low", "pct2"), ("highest", None, "high", "pct2"),
        ("deviation_points", None, "deviation", "num2")]))


def product_note(facts: Facts, page: str, section: int) -> DataFrame:
    """Why the page has no products: how many of their ids occur in several categories."""
    one = facts.products().withColumn("share", percent(F.col("split"), F.col("products")))
    return frames.rows(one, page, frames.finding(section, "product_ids", [
        ("in_several_categories", None, "split", "count"), ("of_products", None, "products", "count"),
        ("share", None, "share", "pct2")], "note"))


# ------------------------------------------------------------------------------ pages
def overview(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    name, facts = "overview", facts or Facts(df)
    cube = facts.cube(name)
    if cube.empty():
        return frames.note(facts.spark, name, NO_ROWS)
    people = facts.people
    trend = cube.trend(TREND_METRICS)
    return frames.assemble([
        frames.rows(cube.totals(["revenue", "sessions", "conversion", "aov", "abandon_rate"]), name, frames.tiles(1, [
            (1, "Total Revenue", "revenue", "inr_m"), (2, "Total Sessions", "sessions", "count"),
            (4, "Conversion Rate", "conversion", "pct2"), (5, "AOV", "aov", "inr"),
            (6, "Cart Abandonment", "abandon_rate", "pct2")])),
        frames.rows(people.headline(), name, frames.tiles(1, [(3, "Customers", "total_customers", "count")]),
                    never_purchased(5), high_value(5), repeat_rate(5)),
        frames.rows(trend, name, frames.chart(2, "trend", [
            ("revenue", "revenue", "inr"), ("conversion", "conversion", "pct2")])),
        frames.rows(people.segments(), name, frames.chart(2, "segments", [("customers", "customers", "count")])),
        frames.rows(cube.by_size("category", ["revenue", "conversion"]), name,
                    frames.chart(3, "category_revenue", [("revenue", "revenue", "inr")]),
                    frames.chart(3, "category_conversion", [("conversion", "conversion", "pct2")])),
        frames.funnel(cube.funnel(), name, 4),
        user_type_gap(cube, name, 5),
        leading_categories(cube, name, 6), conversion_stability(trend, name, 6),
    ])


# Columns and display kinds of the two report tables.
SEGMENT_TABLE = [
    ("customers", "customers", "count"), ("share", "customer_share", "pct2"),
    ("revenue", "revenue", "inr"), ("revenue_share", "revenue_share", "pct2"),
    ("aov", "aov", "rupee"), ("conversion", "conversion", "pct2"), ("repeat_rate", "repeat_rate", "pct")]
CATEGORY_TABLE = [
    ("revenue", "revenue", "inr"), ("conversion", "conversion", "pct2"), ("aov", "aov", "rupee"),
    ("avg_price", "avg_price", "rupee"), ("sessions", "sessions", "count")]
USER_TYPE_SERIES = [("conversion", "conversion", "pct2"), ("abandonment", "abandon_rate", "pct2")]


def customers(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    name, facts = "customers", facts or Facts(df)
    cube = facts.cube(name)
    if cube.empty():
        return frames.note(facts.spark, name, NO_ROWS)
    people = facts.people
    head = people.headline().withColumns({
        "revenue_per_customer": F.col("total_revenue") / F.col("total_customers"),
        "sessions_per_customer": people.sums.agg(F.expr("sum(sessions) / sum(customers)")).scalar()})
    visits = frames.numbered(C.sessions_histogram(people.rows), F.col("sessions"))
    return frames.assemble([
        frames.rows(head, name, frames.tiles(1, [
            (1, "Customers", "total_customers", "count"), (2, "Never purchased", "never_purchased", "count"),
            (3, "Buyers", "buyers", "count"), (4, "Repeat buyers", "repeat_buyers", "count"),
            (5, "Revenue / customer", "revenue_per_customer", "inr"),
            (6, "Sessions / customer", "sessions_per_customer", "num1")]),
            never_purchased(6), high_value(6)),
        frames.rows(people.segments(), name,
                    frames.chart(2, "segment_mix", [("customers", "customers", "count"), ("share", "customer_share", "pct2")]),
                    frames.chart(2, "segment_revenue", [("revenue", "revenue", "inr")]),
                    frames.chart(2, "segment_count", [("customers", "customers", "count")]),
                    frames.chart(5, "segment_table", SEGMENT_TABLE, "table")),
        frames.rows(C.purchase_frequency(people.rows).selectExpr("*", "n AS ord", "n AS key"), name,
                    frames.chart(3, "purchase_frequency", [("buyers", "customers", "count")])),
        frames.rows(visits.selectExpr("*", "sessions AS key", "CAST(sessions AS STRING) AS label"), name,
                    frames.chart(3, "sessions_per_customer", [("customers", "customers", "count")])),
        frames.rows(cube.by_key("user_type", ["conversion", "abandon_rate"]), name,
                    frames.chart(3, "user_type", USER_TYPE_SERIES)),
        frames.rows(people.pareto(), name, frames.chart(4, "pareto", [
            ("cumulative_revenue", "cum_revenue", "pct2"), ("cumulative_customers", "cum_customers", "pct2")])),
        user_type_gap(cube, name, 6),
    ])


def conversion(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    name, facts = "conversion", facts or Facts(df)
    cube = facts.cube(name)
    if cube.empty():
        return frames.note(facts.spark, name, NO_ROWS)
    totals = cube.totals(["sessions", "carts", "purchases", "abandoned", "conversion", "abandon_rate"])
    return frames.assemble([
        frames.rows(totals, name, frames.tiles(1, [
            (1, "Sessions", "sessions", "count"), (2, "Added to cart", "carts", "count"),
            (3, "Purchases", "purchases", "count"), (4, "Abandoned", "abandoned", "count"),
            (5, "Conversion", "conversion", "pct2"), (6, "Abandonment", "abandon_rate", "pct2")])),
        frames.funnel(cube.funnel(), name, 2),
        frames.rows(cube.by_key("user_type", ["conversion", "abandon_rate"]), name,
                    frames.chart(3, "user_type", USER_TYPE_SERIES)),
        frames.rows(cube.by_key("duration", ["conversion"], _duration_order(), F.col("key")), name,
                    frames.chart(3, "duration", [("conversion", "conversion", "pct2")])),
        frames.rows(cube.by_key("discount_bucket", ["sessions", "conversion", "aov"]), name,
                    frames.chart(4, "discount_conversion", [
                        ("sessions", "sessions", "count"), ("conversion", "conversion", "pct2")]),
                    frames.chart(4, "discount_aov", [("aov", "aov", "inr")])),
        user_type_gap(cube, name, 5), duration_effect(cube, name, 5),
        discount_effect(cube, name, 5), funnel_leak(cube, name, 5),
    ])


def categories(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    name, facts = "categories", facts or Facts(df)
    cube = facts.cube(name)
    if cube.empty():
        return frames.note(facts.spark, name, NO_ROWS)
    totals = cube.totals(["revenue", "conversion", "aov", "avg_price", "avg_discount"]).withColumn(
        "categories", cube.rows.agg(F.count_distinct("category")).scalar())
    return frames.assemble([
        frames.rows(totals, name, frames.tiles(1, [
            (1, "Total Revenue", "revenue", "inr_m"), (2, "Categories", "categories", "count"),
            (3, "Conversion", "conversion", "pct2"), (4, "AOV", "aov", "inr"),
            (5, "Avg price", "avg_price", "inr"), (6, "Avg discount", "avg_discount", "pct")])),
        frames.rows(cube.by_size("category", ["revenue", "conversion", "aov", "avg_price", "sessions"]), name,
                    frames.chart(2, "category_revenue", [("revenue", "revenue", "inr")]),
                    frames.chart(2, "category_revenue_conversion", [
                        ("revenue", "revenue", "inr"), ("conversion", "conversion", "pct2")]),
                    frames.chart(3, "category_price", [("avg_price", "avg_price", "inr")]),
                    frames.chart(5, "category_table", CATEGORY_TABLE, "table")),
        frames.rows(cube.by_key("price_band", ["revenue", "conversion", "aov"]), name,
                    frames.chart(3, "price_revenue", [("revenue", "revenue", "inr")]),
                    frames.chart(4, "price_conversion_aov", [
                        ("conversion", "conversion", "pct2"), ("aov", "aov", "inr")])),
        frames.rows(cube.by_size("payment", ["purchases"], "purchases"), name,
                    frames.chart(4, "payment_mix", [("purchases", "purchases", "count")])),
        product_note(facts, name, 5),
        leading_categories(cube, name, 6), price_window(cube, name, 6),
    ])


PAGES = {"overview": overview, "customers": customers, "conversion": conversion,
         "categories": categories}


def every_page(df: DataFrame) -> DataFrame:
    """All pages, from two passes over the sessions."""
    facts = SharedFacts(df)
    return reduce(DataFrame.unionByName, [page(df, facts) for page in PAGES.values()])


def findings(df: DataFrame) -> DataFrame:
    """Every computed finding, from two cubes and the segments.

    Time has its own cube: crossed with five code dimensions it would approach one row per
    session.
    """
    name = "findings"
    cube = Cube.over(df, ["category", "user_type", "duration", "discount_bucket", "price_band"],
                     ["revenue", "purchases", "carts", "abandoned", "discount_correlation"])
    if cube.empty():
        return frames.note(df.sparkSession, name, NO_ROWS)
    people = People(df)
    return frames.assemble([
        frames.rows(people.headline(), name, never_purchased(1), high_value(1), repeat_rate(1)),
        *[f(cube, name, 2) for f in (user_type_gap, leading_categories, duration_effect,
                                     discount_effect, price_window, funnel_leak)],
        conversion_stability(Cube.over(df, [], ["conversion"], by_time=True).trend(["conversion"]), name, 2),
    ])
