"""Oracles of the report pages and findings, as long frames."""

from __future__ import annotations

from .base import (HIGH, DIMENSIONS, SESSIONS, big, dbl, metrics, pct, segmented, show)


def rows(page, section, kind, item, ord_, series, key, label, value, how, source):
    """One cell per row of ``source``; ord_, key and label are SQL, the rest literals."""
    text = lambda v: "CAST(NULL AS VARCHAR)" if v is None else f"'{v}'"
    return (f"SELECT {text(page)} AS page, CAST({section} AS INT) AS section_ord, {text(kind)} AS kind, "
            f"{text(item)} AS item, CAST({ord_} AS INT) AS ord, {text(series)} AS series, "
            f"CAST({key} AS VARCHAR) AS key, {label} AS label, ROUND({dbl(value)},4) AS value, "
            f"{show(value, how)} AS display FROM {source}")


def tiles(page, section, source, specs):
    return [rows(page, section, "kpi", col, i, None, "NULL", f"'{label}'", col, how, source)
            for i, label, col, how in specs]


def chart(page, section, item, source, series, kind="chart"):
    return [rows(page, section, kind, item, "ord", name, "key", "label", col, how, source)
            for name, col, how in series]


def finding(page, section, item, source, cells, kind="finding"):
    return [rows(page, section, kind, item, i, name, "NULL", label or "CAST(NULL AS VARCHAR)", col, how, source)
            for i, (name, label, col, how) in enumerate(cells, 1)]


def group_cte(name, dim, names, order, source="sl"):
    key, label = DIMENSIONS[dim]
    return (f", {name}0 AS (SELECT {key} AS key, {metrics(names)} FROM {source} GROUP BY 1), "
            f"{name} AS (SELECT key, {label} AS label, {', '.join(names)}, "
            f"ROW_NUMBER() OVER (ORDER BY {order}) AS ord FROM {name}0)")


DURATION_PLACE = "CASE key WHEN 'Very Short' THEN 1 WHEN 'Short' THEN 2 WHEN 'Long' THEN 3 WHEN 'Very Long' THEN 4 ELSE 9 END"
GRAIN = {"day": ("CAST(visit_date AS VARCHAR)", "day(MIN(visit_date)) || ' ' || strftime(MIN(visit_date), '%b')"),
         "week": ("strftime(visit_date, '%Y-W%W')", "day(MIN(visit_date)) || ' ' || strftime(MIN(visit_date), '%b')"),
         "month": ("strftime(visit_date, '%Y-%m')", "strftime(MIN(visit_date), '%b %y')")}

ALL = ["revenue", "sessions", "purchases", "carts", "abandoned", "conversion", "aov", "abandon_rate",
       "avg_price", "avg_discount"]


def ctes(grain="month", where="TRUE"):
    """Slice, totals, groups, trend, funnel and segments every page draws from."""
    key, label = GRAIN[grain]
    totals = ", ".join(f"COALESCE({m},0) AS {m}" for m in ALL)
    return (SESSIONS + f", sl AS (SELECT * FROM sessions WHERE {where})"
            + f", t0 AS (SELECT {metrics(ALL)}, {big('COUNT(DISTINCT product_category)')} AS categories FROM sl)"
            + f", t AS (SELECT {totals}, categories FROM t0)"
            + group_cte("cat", "category", ALL, "revenue DESC, key")
            + group_cte("ut", "user_type", ALL, "key") + group_cte("band", "price_band", ALL, "key")
            + group_cte("disc", "discount_bucket", ALL, "key")
            + group_cte("pay", "payment", ALL, "purchases DESC, key")
            + group_cte("dur", "duration", ALL, f"{DURATION_PLACE}, key")
            + f", tr0 AS (SELECT {key} AS key, {label} AS label, {metrics(ALL)} FROM sl GROUP BY 1)"
            + ", tr AS (SELECT *, ROW_NUMBER() OVER (ORDER BY key) AS ord FROM tr0)"
            + f""", fun AS (
  SELECT 1 AS ord, NULL AS key, 'Sessions' AS label, sessions AS value, CAST(100 AS DOUBLE) AS share, NULL AS lost, NULL AS lost_pct FROM t
  UNION ALL SELECT 2, NULL, 'Added to cart', carts, {pct('carts', 'sessions')}, sessions-carts, {pct('sessions-carts', 'sessions')} FROM t
  UNION ALL SELECT 3, NULL, 'Purchased', purchases, {pct('purchases', 'sessions')}, carts-purchases, {pct('carts-purchases', 'carts')} FROM t),
lost AS (SELECT * FROM fun WHERE ord>1)""" + segmented("sl") + f""",
segs AS (SELECT *, seg_ord AS ord, seg_ord AS key, segment AS label FROM segments),
par AS (SELECT seg_ord AS ord, seg_ord AS key, segment AS label,
  ROUND({pct('SUM(s.customers) OVER w', 't.customers')},2) AS cum_customers,
  ROUND(COALESCE({pct('SUM(s.revenue_cents) OVER w', 't.revenue_cents')},0),2) AS cum_revenue
  FROM sums s, total t WINDOW w AS (ORDER BY seg_ord ROWS UNBOUNDED PRECEDING)),
freq AS (SELECT {big('LEAST(purchases,4)')} AS ord, {big('LEAST(purchases,4)')} AS key,
  CASE WHEN LEAST(purchases,4)<4 THEN CAST(LEAST(purchases,4) AS VARCHAR) ELSE '4+' END AS label,
  {big('COUNT(*)')} AS customers FROM cust WHERE purchases>=1 GROUP BY 1,2,3),
hist AS (SELECT sessions AS key, CAST(sessions AS VARCHAR) AS label, {big('COUNT(*)')} AS customers,
  ROW_NUMBER() OVER (ORDER BY sessions) AS ord FROM cust GROUP BY 1 ORDER BY 1 LIMIT 12),
head2 AS (SELECT h.*, h.total_revenue/h.total_customers AS revenue_per_customer,
  {dbl('t.sessions')}/{dbl('t.customers')} AS sessions_per_customer FROM head h, total t),
utgap AS (SELECT (SELECT label FROM ut ORDER BY conversion DESC, key LIMIT 1) AS best,
  (SELECT label FROM ut ORDER BY conversion, key LIMIT 1) AS worst, MAX(conversion) AS high, MIN(conversion) AS low,
  MAX(conversion)-MIN(conversion) AS gap, MAX(abandon_rate)-MIN(abandon_rate) AS abandon_gap FROM ut),
lead AS (SELECT r.label AS rich, r.revenue AS rich_revenue, r.conversion AS rich_conversion, k.label AS keen,
  k.conversion AS keen_conversion, k.revenue AS keen_revenue
  FROM (SELECT * FROM cat ORDER BY revenue DESC, key LIMIT 1) r, (SELECT * FROM cat ORDER BY conversion DESC, key LIMIT 1) k),
deff AS (SELECT a.label AS short, a.conversion AS short_rate, b.label AS long, b.conversion AS long_rate
  FROM (SELECT * FROM dur ORDER BY ord LIMIT 1) a, (SELECT * FROM dur ORDER BY ord DESC LIMIT 1) b),
ceff AS (SELECT a.label AS none, a.aov AS none_aov, b.label AS deep, b.aov AS deep_aov,
  (SELECT MAX(conversion)-MIN(conversion) FROM disc) AS spread,
  (SELECT COALESCE(ROUND(corr(discount_percent, purchased),6),0) FROM sl) AS pearson
  FROM (SELECT * FROM disc ORDER BY key LIMIT 1) a, (SELECT * FROM disc ORDER BY key DESC LIMIT 1) b),
win AS (SELECT COALESCE({pct('SUM(CASE WHEN unit_cents>50000 AND unit_cents<=150000 THEN revenue_cents ELSE 0 END)', 'SUM(revenue_cents)')},0) AS share FROM sl),
leak AS (SELECT {pct('sessions-carts', 'sessions')} AS before, {pct('carts-purchases', 'carts')} AS after,
  GREATEST(sessions-carts, carts-purchases) AS most,
  CASE WHEN sessions-carts>=carts-purchases THEN 'before the cart' ELSE 'after the cart' END AS worst FROM t),
sku AS (SELECT {big('COUNT(*)')} AS products, {big('COUNT(*) FILTER (WHERE kinds > 1)')} AS split FROM
  (SELECT COUNT(DISTINCT product_category) AS kinds FROM sl WHERE product_id IS NOT NULL GROUP BY product_id)),
stab AS (SELECT MIN(conversion) AS low, MAX(conversion) AS high, stddev_samp(conversion) AS deviation FROM tr)
""")


def funnel(page, section):
    return (chart(page, section, "funnel", "fun", [("sessions", "value", "count"), ("share", "share", "pct")], "funnel")
            + chart(page, section, "funnel", "lost", [("lost", "lost", "count"), ("lost_share", "lost_pct", "pct")], "dropoff"))


FINDINGS = {
    "never_purchased": ("head", [("share", None, "never_pct", "pct2"), ("customers", None, "never_purchased", "count"),
                                 ("of_customers", None, "total_customers", "count")]),
    "high_value": ("head", [("customer_share", None, "high_customer_share", "pct2"),
                            ("revenue_share", None, "high_revenue_share", "pct2"),
                            ("customers", None, "high_customers", "count"), ("revenue", None, "high_revenue", "inr")]),
    "repeat_rate": ("head", [("rate", None, "repeat_rate", "pct2"), ("repeat_buyers", None, "repeat_buyers", "count"),
                             ("buyers", None, "buyers", "count")]),
    "user_type_gap": ("utgap", [("best_conversion", "best", "high", "pct2"), ("worst_conversion", "worst", "low", "pct2"),
                                ("gap_points", None, "gap", "num2"), ("abandonment_gap_points", None, "abandon_gap", "num2")]),
    "leading_categories": ("lead", [("most_revenue", "rich", "rich_revenue", "inr"),
                                    ("most_revenue_conversion", "rich", "rich_conversion", "pct2"),
                                    ("best_conversion", "keen", "keen_conversion", "pct2"),
                                    ("best_conversion_revenue", "keen", "keen_revenue", "inr")]),
    "duration_effect": ("deff", [("shortest", "short", "short_rate", "pct2"), ("longest", "long", "long_rate", "pct2")]),
    "discount_effect": ("ceff", [("aov_shallow", "none", "none_aov", "rupee"), ("aov_deep", "deep", "deep_aov", "rupee"),
                                 ("conversion_spread_points", None, "spread", "num2"), ("pearson", None, "pearson", "num2")]),
    "price_window": ("win", [("revenue_share", "'₹501–1,500'", "share", "pct")]),
    "funnel_leak": ("leak", [("before_cart", None, "before", "pct"), ("after_cart", None, "after", "pct"),
                             ("largest", "worst", "most", "count")]),
    "conversion_stability": ("stab", [("lowest", None, "low", "pct2"), ("highest", None, "high", "pct2"),
                                      ("deviation_points", None, "deviation", "num2")]),
}


def found(page, section, *names):
    return [sql for n in names for sql in finding(page, section, n, *FINDINGS[n])]


CONVERSION_AND_ABANDONMENT = [("conversion", "conversion", "pct2"), ("abandonment", "abandon_rate", "pct2")]


def overview():
    p = "overview"
    return [
        *tiles(p, 1, "t", [(1, "Total Revenue", "revenue", "inr_m"), (2, "Total Sessions", "sessions", "count"),
                           (4, "Conversion Rate", "conversion", "pct2"), (5, "AOV", "aov", "inr"),
                           (6, "Cart Abandonment", "abandon_rate", "pct2")]),
        *tiles(p, 1, "head", [(3, "Customers", "total_customers", "count")]),
        *chart(p, 2, "trend", "tr", [("revenue", "revenue", "inr"), ("conversion", "conversion", "pct2")]),
        *chart(p, 2, "segments", "segs", [("customers", "customers", "count")]),
        *chart(p, 3, "category_revenue", "cat", [("revenue", "revenue", "inr")]),
        *chart(p, 3, "category_conversion", "cat", [("conversion", "conversion", "pct2")]),
        *funnel(p, 4), *found(p, 5, "never_purchased", "high_value", "user_type_gap", "repeat_rate"),
        *found(p, 6, "leading_categories", "conversion_stability")]


def customers():
    p = "customers"
    return [
        *tiles(p, 1, "head2", [(1, "Customers", "total_customers", "count"), (2, "Never purchased", "never_purchased", "count"),
                               (3, "Buyers", "buyers", "count"), (4, "Repeat buyers", "repeat_buyers", "count"),
                               (5, "Revenue / customer", "revenue_per_customer", "inr"),
                               (6, "Sessions / customer", "sessions_per_customer", "num1")]),
        *chart(p, 2, "segment_mix", "segs", [("customers", "customers", "count"), ("share", "customer_share", "pct2")]),
        *chart(p, 2, "segment_revenue", "segs", [("revenue", "revenue", "inr")]),
        *chart(p, 2, "segment_count", "segs", [("customers", "customers", "count")]),
        *chart(p, 3, "purchase_frequency", "freq", [("buyers", "customers", "count")]),
        *chart(p, 3, "sessions_per_customer", "hist", [("customers", "customers", "count")]),
        *chart(p, 3, "user_type", "ut", CONVERSION_AND_ABANDONMENT),
        *chart(p, 4, "pareto", "par", [("cumulative_revenue", "cum_revenue", "pct2"),
                                       ("cumulative_customers", "cum_customers", "pct2")]),
        *chart(p, 5, "segment_table", "segs", [
            ("customers", "customers", "count"), ("share", "customer_share", "pct2"), ("revenue", "revenue", "inr"),
            ("revenue_share", "revenue_share", "pct2"), ("aov", "aov", "rupee"), ("conversion", "conversion", "pct2"),
            ("repeat_rate", "repeat_rate", "pct")], "table"),
        *found(p, 6, "never_purchased", "high_value", "user_type_gap")]


def conversion():
    p = "conversion"
    return [
        *tiles(p, 1, "t", [(1, "Sessions", "sessions", "count"), (2, "Added to cart", "carts", "count"),
                           (3, "Purchases", "purchases", "count"), (4, "Abandoned", "abandoned", "count"),
                           (5, "Conversion", "conversion", "pct2"), (6, "Abandonment", "abandon_rate", "pct2")]),
        *funnel(p, 2), *chart(p, 3, "user_type", "ut", CONVERSION_AND_ABANDONMENT),
        *chart(p, 3, "duration", "dur", [("conversion", "conversion", "pct2")]),
        *chart(p, 4, "discount_conversion", "disc", [("sessions", "sessions", "count"), ("conversion", "conversion", "pct2")]),
        *chart(p, 4, "discount_aov", "disc", [("aov", "aov", "inr")]),
        *found(p, 5, "user_type_gap", "duration_effect", "discount_effect", "funnel_leak")]


def categories():
    p = "categories"
    return [
        *tiles(p, 1, "t", [(1, "Total Revenue", "revenue", "inr_m"), (2, "Categories", "categories", "count"),
                           (3, "Conversion", "conversion", "pct2"), (4, "AOV", "aov", "inr"),
                           (5, "Avg price", "avg_price", "inr"), (6, "Avg discount", "avg_discount", "pct")]),
        *chart(p, 2, "category_revenue", "cat", [("revenue", "revenue", "inr")]),
        *chart(p, 2, "category_revenue_conversion", "cat", [("revenue", "revenue", "inr"), ("conversion", "conversion", "pct2")]),
        *chart(p, 3, "category_price", "cat", [("avg_price", "avg_price", "inr")]),
        *chart(p, 3, "price_revenue", "band", [("revenue", "revenue", "inr")]),
        *chart(p, 4, "price_conversion_aov", "band", [("conversion", "conversion", "pct2"), ("aov", "aov", "inr")]),
        *chart(p, 4, "payment_mix", "pay", [("purchases", "purchases", "count")]),
        *chart(p, 5, "category_table", "cat", [
            ("revenue", "revenue", "inr"), ("conversion", "conversion", "pct2"), ("aov", "aov", "rupee"),
            ("avg_price", "avg_price", "rupee"), ("sessions", "sessions", "count")], "table"),
        *finding(p, 5, "product_ids", f"(SELECT *, {pct('split', 'products')} AS share FROM sku)", [
            ("in_several_categories", None, "split", "count"), ("of_products", None, "products", "count"),
            ("share", None, "share", "pct2")], "note"),
        *found(p, 6, "leading_categories", "price_window")]


def _union(parts, **kw):
    return ctes(**kw) + " UNION ALL ".join(parts)


EMPTY = ("CAST(1 AS INT) AS section_ord, 'note' AS kind, 'empty' AS item, CAST(1 AS INT) AS ord, "
         "CAST(NULL AS VARCHAR) AS series, CAST(NULL AS VARCHAR) AS key, 'No rows match these filters' AS label, "
         "CAST(NULL AS DOUBLE) AS value, 'No rows match these filters' AS display")
WEEKS = dict(grain="week", where="product_category=2 AND visit_date>=DATE '1997-03-01' AND visit_date<=DATE '1997-09-30'")
EVERY = [*overview(), *customers(), *conversion(), *categories()]
REPORTS = {
    "pages_all": _union(EVERY), "pages_all_sliced": _union(EVERY, **WEEKS),
    "page_overview": _union(overview()), "page_customers": _union(customers()),
    "page_conversion": _union(conversion()), "page_categories": _union(categories()),
    "page_overview_sliced": _union(overview(), **WEEKS),
    "page_overview_seg": _union(overview(), where=HIGH),
    "page_empty": SESSIONS + f"SELECT 'overview' AS page, {EMPTY} WHERE (SELECT COUNT(*) FROM sessions WHERE product_category=99)=0",
    "findings": _union([*found("findings", 1, "never_purchased", "high_value", "repeat_rate"),
                        *found("findings", 2, "user_type_gap", "leading_categories", "duration_effect",
                               "discount_effect", "price_window", "funnel_leak", "conversion_stability")]),
}
