"""Rules that are easy to get wrong, on hand-written rows."""

import datetime

import pytest

from basketlens.functions import display as D
from basketlens.functions.metrics import METRICS, register_metric
from basketlens.operators import aggregate as A
from basketlens.operators import customers as C
from basketlens.operators import slicers as S
from basketlens.operators.trend import trend
from pyspark.sql import functions as F

FIELDS = ("session_id long, customer_id long, visit_date date, product_id long, product_category int, "
          "payment_method int, device_type int, user_type int, marketing_channel int, location int, "
          "visit_month int, duration_bucket string, unit_cents long, quantity long, gross_cents long, "
          "discount_percent int, discount_cents long, revenue_cents long, pages_viewed int, "
          "time_on_site_sec int, added_to_cart int, purchased int, cart_abandoned int, rating int, "
          "review_helpful_votes int")


def row(i, customer, bought=0, revenue=0, **over):
    base = dict(session_id=i, customer_id=customer, visit_date=datetime.date(2024, 3, 5), product_id=1,
                product_category=1, payment_method=1, device_type=0, user_type=0, marketing_channel=0,
                location=0, visit_month=3, duration_bucket="Short", unit_cents=100, quantity=1, gross_cents=100,
                discount_percent=0, discount_cents=0, revenue_cents=revenue, pages_viewed=5,
                time_on_site_sec=300, added_to_cart=bought, purchased=bought, cart_abandoned=0,
                rating=5 if bought else 4, review_helpful_votes=2)
    return tuple((base | over).values())


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows: spark.createDataFrame(rows, FIELDS)


def slicer(key):
    return next(s for s in S.SLICERS if s.key == key)


@pytest.mark.parametrize("key, raw, value", [
    ("cat", "2", 2), ("cat", " 2.9 ", 2), ("cat", "x", None), ("cat", "inf", None), ("cat", "nan", None),
    ("cat", "", None), ("cat", None, None), ("purch", "1", 1),
    ("from", "2024-03-01", datetime.date(2024, 3, 1)), ("from", "01/03/2024", datetime.date(2024, 3, 1)),
    ("from", "31-02-2024", datetime.date(2024, 3, 1)), ("to", "31-02-2024", datetime.date(2024, 2, 29)),
    ("to", "2024-13-01", None), ("to", "32-01-2024", None), ("to", "1-1-1989", None), ("to", "soon", None),
    ("bucket", "y" * 80, "y" * 64), ("seg", "high", "high"), ("seg", "HIGH", None), ("dbucket", "3", "3"),
    ("dbucket", "4", None), ("pband", "0", "0")])
def test_coercion(key, raw, value):
    assert S.coerce(slicer(key), raw) == value


def test_absent_code_is_empty_but_unknown_text_is_ignored(make):
    df = make([row(1, 1), row(2, 2, duration_bucket="Long")])
    assert S.apply_slicers(df, {"cat": "99"}).count() == 0
    assert S.apply_slicers(df, {"cat": str(10**30)}).count() == 0
    assert S.apply_slicers(df, {"dmax": str(10**30)}).count() == 2
    assert S.apply_slicers(df, {"bucket": "xyz"}).count() == 2
    assert S.apply_slicers(df, {"bucket": "Long"}).count() == 1


def test_last_bucket_is_open_as_dimension_and_closed_as_slicer(make):
    df = make([row(1, 1, discount_percent=25), row(2, 1, discount_percent=35), row(3, 1, unit_cents=250_000)])
    keys = {r.key: r.sessions for r in A.group(df, "discount_bucket", ["sessions"]).collect()}
    assert keys == {0: 1, 3: 2}
    assert S.apply_slicers(df, {"dbucket": "3"}).count() == 1
    assert S.apply_slicers(df, {"pband": "3"}).count() == 0


def test_zero_revenue_buyers(make):
    df = make([row(1, 1, 1, 500), row(2, 2, 1, 0), row(3, 3)])
    assert A.totals(df).first().aov == 2.5
    assigned = {r.customer_id: r.segment for r in C.with_segments(C.rollup(df)).collect()}
    assert assigned == {1: "High value", 2: "Window shoppers", 3: "Window shoppers"}
    assert C.headline(C.segment_sums(C.with_segments(C.rollup(df)))).first().buyers == 2
    in_slice = {k: sorted(r.customer_id for r in S.apply_slicers(df, {"seg": k}).collect())
                for k in ("high", "mid", "core", "window")}
    assert in_slice == {"high": [1], "mid": [], "core": [], "window": [3]}


def test_segments_rank_filtered_rows_but_the_slicer_ranks_all(make):
    rich_elsewhere = [row(i, i, 1, 1000 * i) for i in range(1, 6)]
    in_two = [row(10, 1, 1, 99_999, product_category=2), row(11, 2, 1, 10, product_category=2)]
    df = make(rich_elsewhere + in_two)
    assert {r.customer_id for r in S.apply_slicers(df, {"seg": "high", "cat": "2"}).collect()} == {1}
    two = S.apply_slicers(df, {"cat": "2"})
    assert {r.customer_id: r.segment for r in C.with_segments(C.rollup(two)).collect()} == {
        1: "High value", 2: "Mid value"}


def test_seg_is_ignored_when_nobody_bought(make):
    df = make([row(1, 1), row(2, 2)])
    for key in S.SEGMENT_KEYS:
        assert S.apply_slicers(df, {"seg": key}).count() == 2
    assert S.slice_totals(df, {"a": {"seg": "high"}}, ["sessions"]).first().sessions == 2.0


def test_headline_names_high_value_even_without_buyers(make):
    head = C.headline(C.segment_sums(C.with_segments(C.rollup(make([row(1, 1)]))))).first()
    assert head.high_customers is None and head.never_pct == 100.0


def test_frequency_merges_four_and_more(make):
    df = make([row(i, 1, 1, 5) for i in range(4)] + [row(10 + i, 2, 1, 5) for i in range(7)] + [row(30, 3, 1, 5)])
    got = {r.label: r.customers for r in C.purchase_frequency(C.rollup(df)).collect()}
    assert got == {"1": 1, "4+": 2}


def test_totals_of_nothing_are_zero_and_groups_keep_null(make):
    df = make([row(1, 1)])
    empty = A.totals(df.filter("session_id < 0")).first()
    assert set(empty.asDict().values()) == {0.0}
    only = A.group(df, "category", ["aov", "rating", "helpful_votes"]).first()
    assert only.aov is None and only.rating is None and only.helpful_votes == 0


def test_one_pass_and_separate_passes_agree(make):
    rows = [row(i, i % 3, i % 2, 10 * i, product_category=i % 4) for i in range(30)]
    df = make(rows + [row(99, None), row(98, None, 1, 7)])
    needs = {"sessions", "revenue", "rated", "top_revenue", "customers", "buyers", "browsers", "products"}
    for keys in ({}, {"key": F.col("product_category")}):
        got = [sorted(map(tuple, A.base_aggregates(df, keys, needs, costly).select(
            *keys, *sorted(f"b_{n}" for n in needs)).collect())) for costly in (False, True)]
        assert got[0] == got[1]


def test_rating_uses_purchases_only(make):
    df = make([row(1, 1, 1, 5, rating=2), row(2, 1), row(3, 1)])
    assert A.totals(df).first().rating == 2.0


def test_group_order_and_ties(make):
    df = make([row(1, 1, 1, 5, product_category=3), row(2, 1, 1, 5, product_category=2),
               row(3, 1, 1, 9, product_category=1)])
    keys = lambda **kw: [r.key for r in A.group(df, "category", ["revenue"], **kw).collect()]
    assert keys() == [1, 2, 3]
    assert keys(asc=True) == [2, 3, 1]
    assert keys(order="key") == [3, 2, 1]
    assert keys(limit=2) == [1, 2]


def test_pages_band_label_is_shifted(make):
    got = A.group(make([row(1, 1, pages_viewed=7)]), "pages_band", ["sessions"]).first()
    assert (got.key, got.label) == (5, "6-10 pages")


def test_trend_granularity_follows_the_span(make):
    start = datetime.date(2024, 1, 1)
    def unit(days):
        df = make([row(1, 1, visit_date=start), row(2, 1, visit_date=start + datetime.timedelta(days=days))])
        return {r.granularity for r in trend(df).collect()}
    assert [unit(d) for d in (0, 40, 41, 240, 241)] == [{"day"}, {"day"}, {"week"}, {"week"}, {"month"}]
    assert trend(make([])).collect() == []


def test_monday_weeks_match_strftime(spark):
    from basketlens.operators.trend import bucket_key
    days = spark.sql("SELECT explode(sequence(DATE '1998-01-01', DATE '2005-12-31')) AS d")
    for r in days.select("d", bucket_key(F.lit("week"), F.col("d")).alias("w")).collect():
        assert r.w == r.d.strftime("%Y-W%W")


def test_a_registered_metric_is_usable_everywhere(make):
    register_metric("long_visits", "count", lambda: F.col("b_long"),
                    {"long": lambda: F.count_if(F.col("time_on_site_sec") >= 600)})
    try:
        df = make([row(1, 1, time_on_site_sec=900), row(2, 1)])
        assert A.overall(df, ["long_visits"]).first().long_visits == 1.0
        assert A.group(df, "device", ["long_visits"]).first().long_visits == 1
    finally:
        del METRICS["long_visits"]


def test_display_matches_exact_decimal_rounding(spark):
    import random
    random.seed(5)
    values = [0.0, 0.125, 2.675, 1.005, 2.5, 3.5, 0.5, 999.995, 999.999, 1e6, 0.045, -2.675, 123456789.125]
    values += [random.randint(0, 10**9) / 1000 for _ in range(2000)]
    x = F.col("x")
    df = spark.createDataFrame([(float(v),) for v in values], "x double").select(
        "x", D.pct(x, 2).alias("p2"), D.pct(x).alias("p1"), D.number(x).alias("n"),
        D.number(x, 2, "west").alias("w"), D.inr_m(x).alias("m"))
    for r in df.collect():
        sign = "-" if r.x < 0 else ""
        assert r.p2 == f"{r.x:.2f}%" and r.p1 == f"{r.x:.1f}%"
        assert r.n.replace(",", "") == sign + f"{abs(r.x):.0f}"
        assert r.w == sign + f"{abs(r.x):,.2f}" and r.m == f"₹{r.x / 1e6:.2f}M"


@pytest.mark.parametrize("make_text, text", [
    (lambda: D.number(F.lit(1234567.0)), "12,34,567"), (lambda: D.inr(F.lit(10116169.06), 2), "₹1,01,16,169.06"),
    (lambda: D.inr_short(F.lit(-1801.31)), "-₹1,801"), (lambda: D.inr_short(F.lit(837.826)), "₹837.83"),
    (lambda: D.compact(F.lit(12345678.0)), "1.2Cr"), (lambda: D.compact(F.lit(-250000.0)), "-2.5L"),
    (lambda: D.compact(F.lit(1500.0)), "1.5k"), (lambda: D.compact(F.lit(12.4)), "12"),
    (lambda: D.pct(F.lit(-3.25), 1, signed=True), "▼ 3.2%"), (lambda: D.mmss(F.lit(187.9)), "3m 07s"),
    (lambda: D.date_label(F.lit(datetime.date(2024, 3, 5))), "5 Mar 2024"),
    (lambda: D.number(F.lit(None).cast("double")), "n/a"), (lambda: D.mmss(F.lit(None).cast("double")), "n/a"),
    (lambda: D.number(F.lit(float("nan"))), "n/a"), (lambda: D.fmt(F.lit(22.464), "pct2"), "22.46%")])
def test_display_examples(spark, make_text, text):
    assert spark.range(1).select(make_text()).first()[0] == text


def test_large_values_do_not_abort(spark, make):
    df = make([row(1, 1, 1, 100, discount_percent=60000), row(2, 2, discount_percent=1)])
    assert A.discount_correlation(df).count() == 1
    assert A.overall(df, ["discount_corr"] if "discount_corr" in METRICS else ["revenue"]).count() == 1
    values = spark.sql("SELECT * FROM VALUES (1e19D), (double('Infinity')), (double('NaN')), (-3e25D), (1e300D), (1.5D) AS t(x)")
    shown = [tuple(r) for r in values.select(*[D.fmt(F.col("x"), k) for k in D.KINDS[:-1]]).collect()]
    assert all(None not in r for r in shown) and set(shown[1]) == set(shown[2]) == {"n/a"}
    assert D.number and values.select(D.number(F.col("x"), 0, "west")).first()[0] == "10,000,000,000,000,000,000"


def test_profile_mean_of_any_size(spark):
    from basketlens.operators.quality import numeric_profile
    counts = spark.sql("SELECT 'a' AS name, x AS value, n, CAST(x AS DOUBLE) AS num FROM VALUES ('4e-7', 20000000000L), ('1e30', 20000000000L) AS t(x, n)")
    assert numeric_profile(counts).first().mean_num == pytest.approx(5e29)
    small = spark.sql("SELECT 'a' AS name, x AS value, n, CAST(x AS DOUBLE) AS num FROM VALUES ('0.1', 3L), ('0.2', 1L), ('4e-7', 1L) AS t(x, n)")
    assert numeric_profile(small).first().mean_num == pytest.approx((0.5 + 4e-7) / 5)


def test_a_dimension_of_ones_own(make):
    from basketlens.functions.dimensions import DIMENSIONS, register_dimension
    register_dimension("parity", lambda: F.col("product_id") % 2, lambda k: F.concat(F.lit("p"), k.cast("string")))
    try:
        got = {r.label: r.sessions for r in A.group(make([row(1, 1), row(2, 2, product_id=2), row(3, 3, product_id=3)]), "parity", ["sessions"]).collect()}
        assert got == {"p0": 1, "p1": 2}
    finally:
        del DIMENSIONS["parity"]


def test_large_cubes_stay_distributed(make, monkeypatch):
    from basketlens.plans import pages
    monkeypatch.setattr(pages, "SMALL_CUBE", 3)
    df = make([row(i, i, 1, 100, duration_bucket=f"text {i % 40}", product_category=i % 7) for i in range(300)])
    few, many = pages.PAGES["conversion"](df), None
    monkeypatch.undo()
    many = pages.PAGES["conversion"](df)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
