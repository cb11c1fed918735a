"""Shared SQL text: the session tables, the metrics and the display formats in DuckDB terms."""

from __future__ import annotations

SESSIONS = """
WITH li AS (
  SELECT l_orderkey, COUNT(*) AS n_lines, MIN(l_partkey) AS part_id, CAST(SUM(l_quantity) AS BIGINT) AS qty_sum,
         3*CAST(ROUND(MIN(l_discount)*100) AS INT) AS disc, CAST(MAX(l_shipdate) AS DATE) AS ship
  FROM lineitem GROUP BY l_orderkey),
b AS (
  SELECT o.o_orderkey AS session_id, o.o_custkey AS customer_id, CAST(o.o_orderdate AS DATE) AS visit_date,
    CASE WHEN o.o_orderstatus IN ('F','P') THEN 1 ELSE 0 END AS added_to_cart,
    CASE WHEN o.o_orderstatus='F' AND o.o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END AS purchased,
    CAST(FLOOR(o.o_totalprice/CAST(2.5 AS DOUBLE)) AS BIGINT) AS unit_cents,
    CAST(COALESCE(li.n_lines,0) AS BIGINT) AS quantity, COALESCE(li.disc,0) AS discount_percent,
    CAST(FLOOR(COALESCE(li.qty_sum,0)/CAST(10 AS DOUBLE)) AS INT) AS pages_viewed,
    CAST(GREATEST(COALESCE(date_diff('day', CAST(o.o_orderdate AS DATE), li.ship),0),0) AS INT) AS time_on_site_sec,
    COALESCE(li.part_id,-1) AS product_id,
    CAST(o.o_orderkey % 8 AS INT) AS product_category, CAST(o.o_orderkey % 6 AS INT) AS payment_method,
    CAST(o.o_orderkey % 3 AS INT) AS device_type, CAST(CASE WHEN c.c_acctbal>=4500 THEN 1 ELSE 0 END AS INT) AS user_type,
    CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS marketing_channel,
    c.c_nationkey AS location, CAST(1 + o.o_orderkey % 5 AS INT) AS raw_rating, CAST(o.o_orderkey % 7 AS INT) AS review_helpful_votes,
    CAST(o.o_orderkey % 11 AS INT) AS review_code
  FROM orders o LEFT JOIN li ON li.l_orderkey=o.o_orderkey LEFT JOIN customer c ON c.c_custkey=o.o_custkey),
s AS (
  SELECT b.*, unit_cents*quantity AS gross_cents, added_to_cart-purchased AS cart_abandoned,
    (unit_cents*quantity*discount_percent+50) // 100 AS discount_cents,
    CASE WHEN purchased=1 THEN raw_rating ELSE 4 END AS rating,
    CASE WHEN time_on_site_sec<300 THEN 'Very Short' WHEN time_on_site_sec<900 THEN 'Short'
         WHEN time_on_site_sec<1500 THEN 'Long' ELSE 'Very Long' END AS duration_bucket,
    CAST(month(visit_date) AS INT) AS visit_month, CAST(isodow(visit_date)-1 AS INT) AS weekday,
    CASE WHEN month(visit_date) IN (3,4,5) THEN 1 WHEN month(visit_date) IN (6,7,8) THEN 2
         WHEN month(visit_date) IN (9,10,11) THEN 0 ELSE 3 END AS season
  FROM b),
sessions AS (SELECT s.*, CASE WHEN purchased=1 THEN gross_cents-discount_cents ELSE 0 END AS revenue_cents FROM s)
"""

SEASON_NAME = ("CASE {0} WHEN 1 THEN 'Spring (Mar-May)' WHEN 2 THEN 'Summer (Jun-Aug)' "
               "WHEN 0 THEN 'Autumn (Sep-Nov)' WHEN 3 THEN 'Winter (Dec-Feb)' ELSE 'Season NA' END")

# Raw text rows with the planted defects, and the rows the cleaning must produce from them.
RAW = SESSIONS + """,
raw AS (
  SELECT CAST(customer_id AS VARCHAR) AS customer_id, CAST(session_id AS VARCHAR) AS session_id,
    CASE WHEN session_id%97=0 THEN 'bad-date' ELSE strftime(visit_date,'%d-%m-%Y') END AS visit_date,
    CAST(device_type AS VARCHAR) AS device_type, CAST(user_type AS VARCHAR) AS user_type,
    CAST(marketing_channel AS VARCHAR) AS marketing_channel, CAST(product_id AS VARCHAR) AS product_id,
    CAST(product_category AS VARCHAR) AS product_category,
    printf('%d.%02d', unit_cents//100, unit_cents%100) AS unit_price,
    CASE WHEN session_id%89=0 THEN '' ELSE CAST(quantity AS VARCHAR) END AS quantity,
    CAST(discount_percent AS VARCHAR) AS discount_percent,
    printf('%d.%02d', (discount_cents+CASE WHEN session_id%79=0 THEN 5 ELSE 0 END)//100,
           (discount_cents+CASE WHEN session_id%79=0 THEN 5 ELSE 0 END)%100) AS discount_amount,
    printf('%d.%02d', revenue_cents//100, revenue_cents%100) AS revenue,
    CAST(pages_viewed AS VARCHAR) AS pages_viewed, CAST(time_on_site_sec AS VARCHAR) AS time_on_site_sec,
    CAST(added_to_cart AS VARCHAR) AS added_to_cart, CAST(purchased AS VARCHAR) AS purchased,
    CAST(cart_abandoned AS VARCHAR) AS cart_abandoned, CAST(rating AS VARCHAR) AS rating,
    CAST(review_code AS VARCHAR) AS review_text, CAST(review_helpful_votes AS VARCHAR) AS review_helpful_votes,
    CAST(payment_method AS VARCHAR) AS payment_method, CAST(day(visit_date) AS VARCHAR) AS visit_day,
    CAST(visit_month AS VARCHAR) AS visit_month, CAST(weekday AS VARCHAR) AS visit_weekday,
    CAST(season AS VARCHAR) AS visit_season, duration_bucket AS session_duration_bucket,
    printf('%d.%04d', ((revenue_cents+50)//100)//10000, ((revenue_cents+50)//100)%10000) AS revenue_normalized,
    CAST(location AS VARCHAR) AS location
  FROM sessions, (VALUES (0),(1)) AS copies(copy) WHERE copy=0 OR session_id%83=0)
"""
CLEAN = RAW + """,
typed AS (
  SELECT CAST(session_id AS BIGINT) AS session_id, CAST(customer_id AS BIGINT) AS customer_id,
    CAST(TRY_STRPTIME(visit_date,'%d-%m-%Y') AS DATE) AS day, visit_date AS raw_date,
    CAST(visit_season AS INT) AS season, CAST(device_type AS INT) AS device_type, CAST(user_type AS INT) AS user_type,
    CAST(marketing_channel AS INT) AS marketing_channel, CAST(product_id AS BIGINT) AS product_id,
    CAST(product_category AS INT) AS product_category,
    CAST(ROUND(CAST(unit_price AS DECIMAL(18,2))*100) AS BIGINT) AS unit_cents,
    COALESCE(TRY_CAST(quantity AS BIGINT),0) AS quantity, CAST(discount_percent AS INT) AS discount_percent,
    CAST(ROUND(CAST(discount_amount AS DECIMAL(18,2))*100) AS BIGINT) AS discount_cents,
    CAST(ROUND(CAST(revenue AS DECIMAL(18,2))*100) AS BIGINT) AS revenue_cents,
    CAST(pages_viewed AS INT) AS pages_viewed, CAST(time_on_site_sec AS INT) AS time_on_site_sec,
    session_duration_bucket AS duration_bucket, CAST(added_to_cart AS INT) AS added_to_cart,
    CAST(purchased AS INT) AS purchased, CAST(cart_abandoned AS INT) AS cart_abandoned, CAST(rating AS INT) AS rating,
    CAST(review_text AS INT) AS review_code, CAST(review_helpful_votes AS INT) AS review_helpful_votes,
    CAST(payment_method AS INT) AS payment_method, CAST(location AS INT) AS location,
    CAST(revenue_normalized AS DOUBLE) AS revenue_normalized
  FROM raw),
clean AS (SELECT *, unit_cents*quantity AS gross_cents FROM typed WHERE day IS NOT NULL)
"""


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def ratio(top: str, bottom: str) -> str:
    return f"({dbl(top)}/NULLIF({dbl(bottom)},0))"


def pct(top: str, bottom: str) -> str:
    return f"((100*{dbl(top)})/NULLIF({dbl(bottom)},0))"


def rupees(cents: str) -> str:
    return f"({dbl(cents)}/100)"


CUSTOMERS = "COUNT(DISTINCT customer_id)"
BUYERS = "COUNT(DISTINCT CASE WHEN purchased=1 THEN customer_id END)"
METRICS = {
    "sessions": big("COUNT(*)"), "customers": big(CUSTOMERS), "purchases": big("SUM(purchased)"),
    "buyers": big(BUYERS),
    "browsers": big("COUNT(DISTINCT CASE WHEN purchased=0 THEN customer_id END)"),
    "revenue": rupees("COALESCE(SUM(revenue_cents),0)"), "gross": rupees("COALESCE(SUM(gross_cents),0)"),
    "discount_value": rupees("COALESCE(SUM(discount_cents),0)"),
    "units": big("COALESCE(SUM(quantity),0)"),
    "aov": ratio(rupees("SUM(revenue_cents)"), "SUM(purchased)"),
    "avg_price": ratio(rupees("SUM(unit_cents)"), "COUNT(*)"),
    "conversion": pct("SUM(purchased)", "COUNT(*)"), "cart_rate": pct("SUM(added_to_cart)", "COUNT(*)"),
    "abandon_rate": pct("SUM(cart_abandoned)", "SUM(added_to_cart)"),
    "carts": big("SUM(added_to_cart)"), "abandoned": big("SUM(cart_abandoned)"),
    "avg_discount": ratio("SUM(discount_percent)", "COUNT(*)"),
    "rating": ratio("SUM(CASE WHEN purchased=1 THEN rating END)", "COUNT(CASE WHEN purchased=1 THEN 1 END)"),
    "rating_count": big("COUNT(CASE WHEN purchased=1 THEN 1 END)"),
    "helpful_votes": big("COALESCE(SUM(CASE WHEN purchased=1 THEN review_helpful_votes END),0)"),
    "avg_time": ratio("SUM(time_on_site_sec)", "COUNT(*)"),
    "avg_pages": ratio("SUM(pages_viewed)", "COUNT(*)"),
    "revenue_per_customer": ratio(rupees("SUM(revenue_cents)"), CUSTOMERS),
    "sessions_per_customer": ratio("COUNT(*)", CUSTOMERS),
    "purchases_per_buyer": ratio("SUM(purchased)", BUYERS),
    "products": big("COUNT(DISTINCT product_id)"), "max_revenue": rupees("MAX(revenue_cents)"),
}
TOTALS = [m for m in METRICS if m != "browsers"]


def metrics(names, zero: bool = False) -> str:
    if zero:
        return ", ".join(f"COALESCE({dbl(METRICS[m])},0) AS {m}" for m in names)
    return ", ".join(f"{METRICS[m]} AS {m}" for m in names)


def _code(column: str, word: str) -> tuple[str, str]:
    return column, f"'{word} ' || key"


DISCOUNT_BUCKET = ("CASE WHEN discount_percent=0 THEN 0 WHEN discount_percent<=10 THEN 1 "
                   "WHEN discount_percent<=20 THEN 2 ELSE 3 END")
PRICE_BAND = "CASE WHEN unit_cents<=50000 THEN 0 WHEN unit_cents<=100000 THEN 1 WHEN unit_cents<=150000 THEN 2 ELSE 3 END"
DISCOUNT_LABEL = "CASE key WHEN 0 THEN '0% (no discount)' WHEN 1 THEN '5–10%' WHEN 2 THEN '11–20%' ELSE '21–30%' END"
PRICE_LABEL = "CASE key WHEN 0 THEN '≤ ₹500' WHEN 1 THEN '₹501–1,000' WHEN 2 THEN '₹1,001–1,500' ELSE '₹1,501–2,000' END"
MONTH_LABEL = "strftime(make_date(2000, key, 1), '%b')"
# dimension -> (key expression, label over the key)
DIMENSIONS = {
    "category": _code("product_category", "Category"), "payment": _code("payment_method", "Payment"),
    "device": _code("device_type", "Device"), "user_type": _code("user_type", "User type"),
    "channel": _code("marketing_channel", "Channel"), "location": _code("location", "Location"),
    "month": ("visit_month", MONTH_LABEL),
    "weekday": ("weekday", "['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][key+1]"),
    "season": ("season", SEASON_NAME.format("key")), "duration": ("duration_bucket", "key"),
    "rating": ("rating", "key || ' star'"), "date": ("CAST(visit_date AS VARCHAR)", "key"),
    "product": ("product_id", "'Product #' || key"),
    "discount_band": ("(discount_percent//5)*5",
                      "CASE WHEN key=0 THEN 'No discount' ELSE key || '%-' || (key+4) || '%' END"),
    "discount_bucket": (DISCOUNT_BUCKET, DISCOUNT_LABEL), "price_band": (PRICE_BAND, PRICE_LABEL),
    "time_band": ("(time_on_site_sec//300)*300", "(key//60) || 'm'"),
    "pages_band": ("(pages_viewed//5)*5", "(key+1) || '-' || (key+5) || ' pages'"),
}


def grouped(dim: str, names, tail: str = "", source: str = "sessions", prefix: str = SESSIONS) -> str:
    key, label = DIMENSIONS[dim]
    return (f"{prefix}, g AS (SELECT {key} AS key, {metrics(names)} FROM {source} GROUP BY 1) "
            f"SELECT key, {label} AS label, {', '.join(names)} FROM g {tail}")


# ------------------------------------------------------------------------- customers
def segmented(source: str = "sessions") -> str:
    """CTEs cust, ranked, seg, total over a session relation."""
    return f""",
cust AS (SELECT customer_id, {big('COUNT(*)')} AS sessions, {big('SUM(purchased)')} AS purchases,
         {big('SUM(revenue_cents)')} AS revenue_cents FROM {source} GROUP BY 1),
ranked AS (SELECT *, {big('ROW_NUMBER() OVER (ORDER BY revenue_cents DESC, customer_id)')} AS rn,
           COUNT(*) FILTER (WHERE revenue_cents>0) OVER () AS nb FROM cust),
seg AS (SELECT *, CASE WHEN revenue_cents<=0 THEN 'Window shoppers' WHEN rn<=CEIL(nb*CAST(0.2 AS DOUBLE)) THEN 'High value'
        WHEN rn<=CEIL(nb*CAST(0.2 AS DOUBLE))+CEIL(nb*CAST(0.3 AS DOUBLE)) THEN 'Mid value' ELSE 'Core value' END AS segment FROM ranked),
sums AS (SELECT segment, CASE segment WHEN 'High value' THEN 1 WHEN 'Mid value' THEN 2 WHEN 'Core value' THEN 3 ELSE 4 END AS seg_ord,
         {big('COUNT(*)')} AS customers, {big('SUM(revenue_cents)')} AS revenue_cents, {big('SUM(purchases)')} AS purchases,
         {big('SUM(sessions)')} AS sessions, {big('COUNT(CASE WHEN purchases>=2 THEN 1 END)')} AS repeat,
         {big('COUNT(CASE WHEN purchases>=1 THEN 1 END)')} AS purchasers FROM seg GROUP BY 1),
total AS (SELECT SUM(customers) AS customers, SUM(revenue_cents) AS revenue_cents, SUM(purchasers) AS purchasers,
          SUM(repeat) AS repeat, SUM(sessions) AS sessions FROM sums),
segments AS (SELECT segment, seg_ord, s.customers, COALESCE({pct('s.customers', 't.customers')},0) AS customer_share,
  {rupees('s.revenue_cents')} AS revenue, COALESCE({pct(rupees('s.revenue_cents'), rupees('t.revenue_cents'))},0) AS revenue_share,
  {ratio(rupees('s.revenue_cents'), 's.customers')} AS avg_revenue, s.purchases, s.sessions,
  COALESCE({pct('s.purchases', 's.sessions')},0) AS conversion,
  COALESCE({ratio(rupees('s.revenue_cents'), 's.purchases')},0) AS aov,
  {ratio('s.sessions', 's.customers')} AS sessions_per_customer, s.repeat,
  {pct('s.repeat', 's.customers')} AS repeat_rate FROM sums s, total t),
head AS (SELECT {big('t.customers')} AS total_customers, {rupees('t.revenue_cents')} AS total_revenue,
  {big('t.purchasers')} AS buyers, {big('t.repeat')} AS repeat_buyers,
  COALESCE({pct('t.repeat', 't.purchasers')},0) AS repeat_rate,
  {big('t.customers-t.purchasers')} AS never_purchased,
  COALESCE({pct('t.customers-t.purchasers', 't.customers')},0) AS never_pct,
  h.customers AS high_customers, {pct('h.customers', 't.customers')} AS high_customer_share,
  {rupees('h.revenue_cents')} AS high_revenue,
  {pct(rupees('h.revenue_cents'), rupees('t.revenue_cents'))} AS high_revenue_share
  FROM total t LEFT JOIN sums h ON h.segment='High value')
"""


BUYER_SEGMENTS = """,
br AS (SELECT customer_id, SUM(revenue_cents) AS r FROM sessions WHERE purchased=1 GROUP BY 1 HAVING SUM(revenue_cents)>0),
bk AS (SELECT customer_id, ROW_NUMBER() OVER (ORDER BY r DESC, customer_id) AS rn, COUNT(*) OVER () AS nb FROM br),
bs AS (SELECT customer_id, CASE WHEN rn<=CEIL(nb*CAST(0.2 AS DOUBLE)) THEN 'high'
       WHEN rn<=CEIL(nb*CAST(0.2 AS DOUBLE))+CEIL(nb*CAST(0.3 AS DOUBLE)) THEN 'mid' ELSE 'core' END AS seg FROM bk)
"""

# Sessions of the best fifth of the spenders, as a condition over sessions.
HIGH = """customer_id IN (SELECT customer_id FROM (
  SELECT customer_id, ROW_NUMBER() OVER (ORDER BY r DESC, customer_id) AS rn, COUNT(*) OVER () AS nb FROM (
    SELECT customer_id, SUM(revenue_cents) AS r FROM sessions WHERE purchased=1 GROUP BY 1 HAVING SUM(revenue_cents)>0))
  WHERE rn<=CEIL(nb*CAST(0.2 AS DOUBLE)))"""


# --------------------------------------------------------------------------- display
def indian(text: str) -> str:
    head = f"left({text}, length({text})-3)"
    pairs = f"ltrim(reverse(regexp_replace(reverse({head}), '(..)', '\\1,', 'g')), ',')"
    return f"CASE WHEN length({text})<=3 THEN {text} ELSE {pairs} || ',' || right({text}, 3) END"


def show(x: str, kind: str) -> str:
    """Display text of a column ``x``."""
    minus = f"CASE WHEN {x}<0 THEN '-' ELSE '' END"
    whole = indian(f"printf('%.0f', abs({dbl(x)}))")
    body = {
        "inr": f"{minus} || '₹' || CASE WHEN abs({x})>=1e6 THEN printf('%.2f', abs({dbl(x)})/1e6) || 'M' "
               f"WHEN abs({x})>=1000 THEN {whole} ELSE format('{{:,.2f}}', abs({dbl(x)})) END",
        "inr_m": f"'₹' || {minus} || printf('%.2f', abs({dbl(x)})/1e6) || 'M'",
        "rupee": f"'₹' || {minus} || {whole}", "count": f"{minus} || {whole}",
        "pct": f"{minus} || printf('%.1f', abs({dbl(x)})) || '%'",
        "pct2": f"{minus} || printf('%.2f', abs({dbl(x)})) || '%'",
        "num1": f"{minus} || format('{{:,.1f}}', abs({dbl(x)}))",
        "num2": f"{minus} || format('{{:,.2f}}', abs({dbl(x)}))",
        "sec": f"printf('%dm %02ds', {big(f'trunc({dbl(x)})')}//60, {big(f'trunc({dbl(x)})')}%60)",
    }[kind]
    return f"CASE WHEN {x} IS NULL THEN 'n/a' ELSE {body} END"
