"""Oracles of everything but the report pages."""

from __future__ import annotations

import json

from basketlens.model import (NUMERIC_COLUMNS, SEASON_NAMES, SOURCE_COLUMNS,
                              WEEKDAY_NAMES, column_role, column_type)

from .base import (BUYER_SEGMENTS, CLEAN, DIMENSIONS, HIGH, METRICS, RAW, SEASON_NAME, SESSIONS, TOTALS, big, dbl, grouped,
                   indian, metrics, pct, rupees, segmented, show)

# ------------------------------------------------------------------------- slices
# request -> condition over sessions; "seg" conditions use BUYER_SEGMENTS.
IN_SEGMENT = "customer_id IN (SELECT customer_id FROM bs WHERE seg='{}')"
NEVER = "customer_id NOT IN (SELECT customer_id FROM sessions WHERE purchased=1)"
SLICES = {
    "slice_cat": "product_category=2", "slice_pay": "payment_method=1", "slice_dev": "device_type=0",
    "slice_utype": "user_type=1", "slice_chan": "marketing_channel=4", "slice_loc": "location=16",
    "slice_bucket": "duration_bucket='Long'", "slice_purch": "purchased=1", "slice_purch_0": "purchased=0",
    "slice_month": "visit_month=11", "slice_dbucket_0": "discount_percent=0",
    "slice_dbucket": "discount_percent>20 AND discount_percent<=30",
    "slice_pband": "unit_cents>100000 AND unit_cents<=150000",
    "slice_pband_3": "unit_cents>150000 AND unit_cents<=200000",
    "slice_from": "visit_date>=DATE '1997-03-01'", "slice_to": "visit_date<=DATE '1998-06-15'",
    "slice_combo": "product_category=2 AND payment_method=1 AND visit_month=6",
    "slice_empty": "product_category=99", "slice_unknown_text": "TRUE", "slice_month_0": "visit_month=0",
    "slice_seg_unknown": "TRUE", "slice_rmin": "rating>=4", "slice_dmin": "discount_percent>=10",
    "slice_dmax": "discount_percent<=15",
    "seg_semi_high": IN_SEGMENT.format("high"), "seg_semi_mid": IN_SEGMENT.format("mid"),
    "seg_semi_core": IN_SEGMENT.format("core"), "seg_anti_window": NEVER,
}
BATCH = [n for n in SLICES if n not in ("slice_pband_3", "slice_rmin", "slice_dmin", "slice_dmax",
                                        "seg_semi_mid", "seg_semi_core")]
SPRING_TO_AUTUMN = "visit_date>=DATE '1997-03-01' AND visit_date<=DATE '1997-09-30'"
DATE_FORMS = {"iso": SPRING_TO_AUTUMN, "dmy": SPRING_TO_AUTUMN, "slashes": SPRING_TO_AUTUMN,
              "past_month_end": SPRING_TO_AUTUMN, "unusable": "TRUE"}


def per_request(requests: dict[str, str], names) -> str:
    return SESSIONS + BUYER_SEGMENTS + " UNION ALL ".join(
        f"SELECT '{rid}' AS request_id, {metrics(names, True)} FROM sessions WHERE {where}"
        for rid, where in requests.items())


LABELS = """,
asked AS (SELECT * FROM (VALUES
  ('coded','cat','Category','2'), ('coded','pay','Payment method','1'), ('coded','month','Month','6'),
  ('text','bucket','Session length','Long'), ('text','purch','Outcome','1'),
  ('bands','dbucket','Discount bucket','3'), ('bands','pband','Price band','2'),
  ('dates','from','From','1997-03-01'), ('dates','seg','Customer segment','high'),
  ('absent','cat','Category','99'), ('absent','loc','Location','16'), ('absent','utype','User type','1.0')
) AS a(request_id, key, label, raw)),
known AS (SELECT DISTINCT 'cat' AS key, CAST(product_category AS VARCHAR) AS raw, 'Category ' || product_category AS display FROM sessions
  UNION SELECT DISTINCT 'pay', CAST(payment_method AS VARCHAR), 'Payment ' || payment_method FROM sessions
  UNION SELECT DISTINCT 'month', CAST(visit_month AS VARCHAR), strftime(visit_date, '%b') FROM sessions
  UNION SELECT DISTINCT 'loc', CAST(location AS VARCHAR), 'Location ' || location FROM sessions
  UNION VALUES ('purch','1','Purchased'), ('dbucket','3','21–30%'), ('pband','2','₹1,001–1,500'), ('seg','high','High value'))
SELECT request_id, asked.key AS key, label, raw,
  COALESCE(display, CASE WHEN asked.key='cat' THEN 'Category ' || raw ELSE raw END) AS display
FROM asked LEFT JOIN known USING (key, raw)
"""

# -------------------------------------------------------------------------- trend
MONTH, SHORT = "strftime(MIN(visit_date), '%b %y')", "day(MIN(visit_date)) || ' ' || strftime(MIN(visit_date), '%b')"
GRAIN = {"day": ("CAST(visit_date AS VARCHAR)", SHORT), "week": ("strftime(visit_date, '%Y-W%W')", SHORT),
         "month": ("strftime(visit_date, '%Y-%m')", MONTH)}


def trend(grain, names=("revenue", "sessions", "purchases"), where="TRUE", prefix=SESSIONS, source="sessions"):
    key, label = GRAIN[grain]
    return (f"{prefix} SELECT '{grain}' AS granularity, {key} AS key, {label} AS label, {metrics(names)} "
            f"FROM {source} WHERE {where} GROUP BY {key}")


TREND = ["revenue", "sessions", "purchases", "conversion"]
EVENTS = """WITH ev AS (SELECT CAST(ts AS DATE) AS visit_date, user_id AS customer_id,
  CASE WHEN event_type IN ('click','purchase') THEN 1 ELSE 0 END AS added_to_cart,
  CASE WHEN event_type='purchase' THEN 1 ELSE 0 END AS purchased,
  CASE WHEN event_type='purchase' THEN CAST(FLOOR(value*100) AS BIGINT) ELSE 0 END AS revenue_cents FROM events)"""


def funnel(source, prefix, keys="", group=""):
    k = f"{keys}, " if keys else ""
    names = "key, label, " if keys else ""
    return f"""{prefix}, f AS (SELECT {k}{big('COUNT(*)')} AS n, {big('SUM(added_to_cart)')} AS c,
      {big('SUM(purchased)')} AS p FROM {source} {group})
    SELECT {names}CAST(1 AS INT) AS step_ord, 'Sessions' AS step, n AS value, CAST(100 AS DOUBLE) AS pct_of_sessions,
      CAST(NULL AS DOUBLE) AS pct_of_previous, CAST(NULL AS BIGINT) AS lost, CAST(NULL AS DOUBLE) AS lost_pct FROM f
    UNION ALL SELECT {names}2, 'Added to cart', c, {pct('c', 'n')}, {pct('c', 'n')}, n-c, {pct('n-c', 'n')} FROM f
    UNION ALL SELECT {names}3, 'Purchased', p, {pct('p', 'n')}, {pct('p', 'c')}, c-p, {pct('c-p', 'c')} FROM f"""


# ------------------------------------------------------------------------- ingest
CLEAN_COLUMNS = f"""SELECT session_id, customer_id, CAST(day AS VARCHAR) AS visit_date,
  CAST(year(day) AS INT) AS visit_year, CAST(month(day) AS INT) AS visit_month, strftime(day,'%b') AS month_name,
  CAST(day(day) AS INT) AS visit_day, CAST(isodow(day)-1 AS INT) AS weekday, strftime(day,'%a') AS weekday_name,
  season, {SEASON_NAME.format('season')} AS season_name, device_type, 'Device ' || device_type AS device_label,
  user_type, 'User type ' || user_type AS user_type_label, marketing_channel, 'Channel ' || marketing_channel AS channel_label,
  product_id, product_category, 'Category ' || product_category AS category_label, unit_cents, quantity, gross_cents,
  discount_percent, discount_cents, revenue_cents, pages_viewed, time_on_site_sec, duration_bucket, added_to_cart,
  purchased, cart_abandoned, rating, review_code, review_helpful_votes, payment_method,
  'Payment ' || payment_method AS payment_label, location, 'Location ' || location AS location_label, revenue_normalized"""


def facts(source, day="visit_date"):
    return {"rows": f"(SELECT COUNT(*) FROM {source})",
            "unique_customers": f"(SELECT COUNT(DISTINCT customer_id) FROM {source})",
            "unique_products": f"(SELECT COUNT(DISTINCT product_id) FROM {source})",
            "date_min": f"(SELECT MIN({day}) FROM {source})", "date_max": f"(SELECT MAX({day}) FROM {source})"}


def key_values(pairs: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS key, CAST({v} AS VARCHAR) AS value" for k, v in pairs.items())


def _json(mapping) -> str:
    return "'" + json.dumps({str(k): v for k, v in mapping.items()}, separators=(",", ":")) + "'"


DUPLICATE_ROWS = "(SELECT COUNT(*) FROM raw) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM raw))"
META = facts("clean", "day") | {
    "rows": "(SELECT COUNT(DISTINCT session_id) FROM clean)",
    "repeated_rows": "(SELECT COUNT(*)-COUNT(DISTINCT session_id) FROM clean)",
    "findings": """(SELECT to_json(list({'severity': severity, 'column': "column", 'title': title, 'detail': detail} ORDER BY ord)) FROM said)""",
    "unparsed_rows": "(SELECT COUNT(*) FROM typed WHERE day IS NULL)", "duplicate_rows": f"({DUPLICATE_ROWS})",
    "csv_columns": "29", "weekday_mapping": _json(dict(enumerate(WEEKDAY_NAMES))), "season_mapping": _json(SEASON_NAMES)}

# ------------------------------------------------------------------------ quality
NUMERIC_LIST = ", ".join(f"'{c}'" for c in NUMERIC_COLUMNS)
LONG = RAW + f""",
long AS (SELECT name, value FROM (UNPIVOT (SELECT * FROM raw) ON COLUMNS(*) INTO NAME name VALUE value)),
cnt AS (SELECT name, value, {big('COUNT(*)')} AS n FROM long GROUP BY 1,2),
counts AS (SELECT name, {big("SUM(CASE WHEN trim(value)='' THEN 0 ELSE n END)")} AS not_nulls,
  {big("SUM(CASE WHEN trim(value)='' THEN n ELSE 0 END)")} AS nulls, {big('COUNT(*)')} AS distinct_n FROM cnt GROUP BY 1),
nums AS (SELECT name, TRY_CAST(value AS DOUBLE) AS num, TRY_CAST(value AS DECIMAL(28,6)) AS exact FROM long
  WHERE name IN ({NUMERIC_LIST}) AND TRY_CAST(value AS DOUBLE) IS NOT NULL),
stats AS (SELECT name, MIN(num) AS min_num, MAX(num) AS max_num, {dbl('SUM(exact)')}/{dbl('COUNT(*)')} AS mean_num,
  {big('COUNT(*)')} AS size FROM nums GROUP BY 1),
ordered AS (SELECT name, num, ROW_NUMBER() OVER (PARTITION BY name ORDER BY num) AS rn,
  COUNT(*) OVER (PARTITION BY name) AS size FROM nums),
quart AS (SELECT name, MAX(CASE WHEN rn=(size-1)//4+1 THEN num END) AS q1,
  MAX(CASE WHEN rn=(size-1)*3//4+1 THEN num END) AS q3,
  (MAX(CASE WHEN rn=(size-1)//2+1 THEN num END)+MAX(CASE WHEN rn=size//2+1 THEN num END))/2 AS median_num
  FROM ordered GROUP BY 1),
fence AS (SELECT q.name, q1-(q3-q1)*CAST(1.5 AS DOUBLE) AS outlier_low, q3+(q3-q1)*CAST(1.5 AS DOUBLE) AS outlier_high
  FROM quart q JOIN stats USING (name) WHERE size>=100),
outl AS (SELECT f.name, outlier_low, outlier_high,
  {big('SUM(CASE WHEN num<outlier_low OR num>outlier_high THEN 1 ELSE 0 END)')} AS outliers
  FROM fence f JOIN nums USING (name) GROUP BY 1,2,3),
top3 AS (SELECT name, CAST(rank AS INT) AS rank, left(value,40) AS value, n FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY n DESC, value) AS rank FROM cnt) WHERE rank<=3)
"""
FACT_ROWS = ", ".join(f"('{c}',{i},'{column_type(c)}','{column_role(c)}')" for i, c in enumerate(SOURCE_COLUMNS))
PROFILE = LONG + f""",
listed AS (SELECT name, CAST(to_json(list({{'value': value, 'count': n}} ORDER BY rank)) AS VARCHAR) AS top_values,
  MAX(CASE WHEN rank=1 THEN value END) AS top FROM top3 GROUP BY 1),
info AS (SELECT * FROM (VALUES {FACT_ROWS}) AS i(name, position, dtype, role))
SELECT name, CAST(position AS INT) AS position, dtype, not_nulls, nulls, distinct_n, min_num, max_num, mean_num, median_num,
  CASE WHEN dtype='text' THEN top END AS min_str, CAST(NULL AS VARCHAR) AS max_str, top_values, outlier_low, outlier_high,
  COALESCE(outliers,0) AS outliers, role
FROM info LEFT JOIN counts USING (name) LEFT JOIN stats USING (name) LEFT JOIN quart USING (name)
  LEFT JOIN listed USING (name) LEFT JOIN outl USING (name)"""

RULE_TESTS = {
    "zero_revenue_purchase": "purchased=1 AND revenue_cents=0",
    "revenue_without_purchase": "purchased=0 AND revenue_cents>0",
    "discount_mismatch": "abs(discount_cents-(gross_cents*discount_percent+50)//100)>2",
    "purchase_without_cart": "purchased=1 AND added_to_cart=0",
    "cart_not_ended_once": "added_to_cart=1 AND purchased+cart_abandoned<>1",
    "price_not_positive": "unit_cents<=0",
}
RATING_MODE = (f"SELECT rating, {big('COUNT(*)')} AS n FROM {{}} WHERE purchased=0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
RULE_COUNTS = CLEAN + ", rules AS (" + " UNION ALL ".join([
    f"SELECT 'rows' AS rule, {big('COUNT(*)')} AS n, CAST(NULL AS INT) AS value FROM clean",
    *[f"SELECT '{r}', {big('COUNT(*)')}, NULL FROM clean WHERE {t}" for r, t in RULE_TESTS.items()],
    f"SELECT 'duplicate_session_id', {big('COUNT(*)-COUNT(DISTINCT session_id)')}, NULL FROM clean",
    f"SELECT 'placeholder_rating', n, rating FROM ({RATING_MODE.format('clean')})"]) + ")"


def _quoted(text):
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


# The texts a reader must see, written out here on their own.
RULES = {
    "zero_revenue_purchase": ("revenue", "{n} purchases carry no revenue",
                              "They count as purchases, so they lower the average order value.", None, None, None),
    "revenue_without_purchase": ("revenue", "{n} sessions without a purchase carry revenue",
                                 "Revenue belongs to completed purchases only.", "info", "No revenue outside purchases",
                                 "Revenue averages are taken over purchases, not over sessions."),
    "placeholder_rating": ("rating", "{n} sessions without a purchase are rated {value}",
                           "The rating is a placeholder there; rating metrics use purchases only.", None, None, None),
    "discount_mismatch": ("discount_amount", "{n} discounts differ from price, quantity and percent",
                          "The two discount fields are more than two cents apart.", "ok",
                          "Discounts agree with price, quantity and percent", "Checked for every row within two cents."),
    "purchase_without_cart": ("purchased", "{n} purchases skipped the cart",
                              "A session can reach the purchase without the cart stage.", None, None, None),
    "cart_not_ended_once": ("cart_abandoned", "{n} carts were not ended exactly once",
                            "A cart should be either purchased or abandoned.", "ok", "Every cart was purchased or abandoned",
                            "The funnel adds up."),
    "duplicate_session_id": ("session_id", "{n} repeated session ids", "Only one row per session id enters the store.",
                             "ok", "Session ids are unique", "One row is one session."),
    "price_not_positive": ("unit_price", "{n} prices are zero or less", "Averages per order include such lines.", None, None, None),
}
CODES = ["device_type", "location", "marketing_channel", "payment_method", "product_category", "review_code", "user_type"]
RANGES = " || ', ' || ".join(f"(SELECT '{c} ' || MIN({c}) || '-' || MAX({c}) FROM clean)" for c in CODES)
TEXTS = ", ".join(f"({i},'{rule}',{', '.join(_quoted(t) for t in texts)})"
                  for i, (rule, texts) in enumerate(RULES.items(), 1))
FINDINGS = RULE_COUNTS + f""",
texts AS (SELECT * FROM (VALUES {TEXTS}) AS x(ord, rule, col, bad_title, bad_detail, good_severity, good_title, good_detail)),
judged AS (SELECT *, CASE WHEN rule='placeholder_rating' THEN n>(SELECT n FROM rules WHERE rule='rows')*0.2 ELSE n>0 END AS broken
  FROM rules JOIN texts USING (rule)),
said AS (SELECT CAST(ord AS INT) AS ord, CASE WHEN broken THEN 'warning' ELSE good_severity END AS severity, col AS "column",
  CASE WHEN broken THEN replace(replace(bad_title,'{{n}}',format('{{:,}}',n)),'{{value}}',COALESCE(CAST(value AS VARCHAR),'')) ELSE good_title END AS title,
  CASE WHEN broken THEN bad_detail ELSE good_detail END AS detail, n
FROM judged WHERE broken OR good_severity IS NOT NULL
UNION ALL SELECT 9, 'info', 'codes', 'Codes have no names', 'Only their ranges are known: ' || {RANGES}, {len(CODES)})
"""

# ------------------------------------------------------------------------ display
KINDS = {"sessions": "count", "customers": "count", "purchases": "count", "buyers": "count", "revenue": "inr",
         "gross": "inr", "discount_value": "inr", "units": "count", "aov": "inr", "avg_price": "inr",
         "conversion": "pct", "cart_rate": "pct", "abandon_rate": "pct", "carts": "count", "abandoned": "count",
         "avg_discount": "pct", "rating": "num1", "rating_count": "count", "helpful_votes": "count",
         "avg_time": "sec", "avg_pages": "num1", "revenue_per_customer": "inr", "sessions_per_customer": "num1",
         "purchases_per_buyer": "num2", "products": "count", "max_revenue": "inr"}
X = "o_totalprice"
MATRIX = f"""SELECT o_orderkey, {indian(f"printf('%.0f', {X})")} AS number0, format('{{:,.2f}}', {X}) AS number2_west,
  '₹' || {indian(f"left(printf('%.2f', {X}), length(printf('%.2f', {X}))-3)")} || right(printf('%.2f', {X}), 3) AS inr2,
  {show(X, 'inr_m')} AS inr_m, {show(X, 'inr')} AS inr_short,
  CASE WHEN {X}>=1e7 THEN printf('%.1fCr', {X}/1e7) WHEN {X}>=1e5 THEN printf('%.1fL', {X}/1e5)
       WHEN {X}>=1000 THEN printf('%.1fk', {X}/1000) ELSE printf('%.0f', {X}) END AS compact,
  printf('%.2f%%', {X}/1e5) AS pct2,
  CASE WHEN {X}/1e5-1>0 THEN '▲ ' WHEN {X}/1e5-1<0 THEN '▼ ' ELSE '' END || printf('%.1f%%', abs({X}/1e5-1)) AS pct_signed,
  printf('%dm %02ds', {big(f'trunc({X}/100)')}//60, {big(f'trunc({X}/100)')}%60) AS mmss,
  day(o_orderdate) || ' ' || strftime(o_orderdate, '%b %Y') AS date_label FROM orders"""
TABLE_KINDS = {"revenue": "inr", "conversion": "pct2", "aov": "rupee", "avg_price": "rupee", "sessions": "count"}
SEGMENTS = SESSIONS + segmented()
OPTION_DIMS = {"cat": "category", "utype": "user_type", "pay": "payment", "month": "month", "bucket": "duration",
               "dev": "device", "chan": "channel", "loc": "location"}


def options(dim):
    key, label = DIMENSIONS[dim]
    return (f"{SESSIONS}, g AS (SELECT {key} AS key, {big('COUNT(*)')} AS n FROM sessions GROUP BY 1) "
            f"SELECT key AS value, {label} AS label, n FROM g")


# The digest: the text's bytes as one number in base 256, remainders by two primes.
DIGESTED = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
            "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
            "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]}
LINES = " UNION ALL ".join(f"SELECT '{t}' AS name, {c[0]} AS k, concat_ws('|', {', '.join(c)}) || chr(10) AS t FROM {t}" for t, c in DIGESTED.items())


def remainder(prime: int) -> str:
    line = f"list_reduce([0::HUGEINT] || b, lambda a, x: (a*256 + x) % {prime})"
    shift = f"list_reduce([1::HUGEINT] || b, lambda a, x: (a*256) % {prime})"
    return (f"list_reduce([{{'r': 0::HUGEINT, 's': 1::HUGEINT}}] || list({{'r': {line}, 's': {shift}}} ORDER BY k), "
            f"lambda a, x: {{'r': (a.r*x.s + x.r) % {prime}, 's': x.s}}).r")


FINGERPRINT = f"""WITH l AS ({LINES}),
  c AS (SELECT name, k, [('0x' || substr(hex(encode(t)), 2*i+1, 2))::HUGEINT FOR i IN range(strlen(t))] AS b FROM l),
  h AS (SELECT name, {big('SUM(len(b))')} AS bytes, {remainder(2305843009213691579)} AS r0, {remainder(2305843009213690799)} AS r1 FROM c GROUP BY name)
  SELECT name, bytes, format('{{:016x}}', r0::BIGINT) || format('{{:016x}}', r1::BIGINT) AS digest FROM h"""
CSV_QUOTED = RAW + """, k AS (SELECT *, CAST(session_id AS BIGINT) AS k FROM raw)
  SELECT session_id, CASE WHEN k%13=0 THEN 'two "lines",' || chr(10) ELSE '' END || session_duration_bucket AS bucket, CAST(NULL AS VARCHAR) AS malformed FROM k
  UNION ALL SELECT NULL, NULL, array_to_string([customer_id, session_id, visit_date, device_type, user_type, marketing_channel, product_id, product_category,
    unit_price, quantity, discount_percent, discount_amount, revenue, pages_viewed, time_on_site_sec, added_to_cart, purchased, cart_abandoned, rating,
    review_text, review_helpful_votes, payment_method, visit_day, visit_month, visit_weekday, visit_season, session_duration_bucket,
    revenue_normalized, location, 'surplus'], ',') FROM k WHERE k%101=5
  UNION ALL SELECT session_id, session_duration_bucket, NULL FROM k WHERE k%103=7 AND k%101<>5
  UNION ALL SELECT NULL, NULL, 'too,few' FROM k WHERE k%103=7 AND k%101<>5"""


# Requests of a table, as what their texts mean; null where a request does not ask or its text cannot be used.
ASKED = """
q AS (SELECT 'r' || i AS request_id, CASE WHEN i%3=0 THEN i%9 END AS cat, CASE WHEN i%5=1 THEN i%7 END AS pay, CASE WHEN i%4=2 THEN i%14 END AS month,
  CASE WHEN i%6=3 THEN DATE '1992-01-01' + CAST(i*37%2500 AS INT) END AS lo,
  CASE WHEN i%49=4 THEN DATE '1997-02-28' WHEN i%7=4 THEN DATE '1993-01-01' + CAST(i*53%2200 AS INT) END AS hi,
  CASE WHEN i%11=5 AND i%2=1 THEN 1 END AS utype, CASE WHEN i%13=6 AND i%5<4 THEN ['high','mid','core','window'][i%5+1] END AS seg,
  CASE WHEN i%10=7 AND i%6<4 THEN i%6 END AS dbucket, CASE WHEN i%10=8 THEN i%4 END AS pband,
  CASE WHEN i%12=9 AND i%5<3 THEN ['Long','Short','Very Long'][i%5+1] END AS bucket, CASE WHEN i%8=1 THEN i%3 END AS purch,
  CASE WHEN i%9=2 THEN i%6 END AS rmin, CASE WHEN i%14=3 THEN i%30 END AS dmin, CASE WHEN i%15=4 AND i%2=1 THEN i%30 END AS dmax,
  CASE WHEN i%17=2 THEN i%30 END AS loc, CASE WHEN i%19=1 THEN i%4 END AS dev, CASE WHEN i%21=3 THEN i%5 END AS chan FROM range(5000) r(i)),
known AS (SELECT * REPLACE (CASE WHEN bucket IN (SELECT duration_bucket FROM sessions) THEN bucket END AS bucket) FROM q),
people AS (SELECT customer_id, CASE WHEN COUNT(*) FILTER (purchased=1)=0 THEN 'window' ELSE MIN(seg) END AS seg FROM sessions LEFT JOIN bs USING (customer_id) GROUP BY 1),
ss AS (SELECT s.*, p.seg, CASE WHEN discount_percent=0 THEN 0 WHEN discount_percent>0 AND discount_percent<=10 THEN 1 WHEN discount_percent>10 AND discount_percent<=20 THEN 2
    WHEN discount_percent>20 AND discount_percent<=30 THEN 3 END AS dbucket,
  CASE WHEN unit_cents<=50000 THEN 0 WHEN unit_cents<=100000 THEN 1 WHEN unit_cents<=150000 THEN 2 WHEN unit_cents<=200000 THEN 3 END AS pband
  FROM sessions s LEFT JOIN people p ON p.customer_id IS NOT DISTINCT FROM s.customer_id)"""
ASKS = " AND ".join([*[f"(q.{k} IS NULL OR {c}=q.{k})" for k, c in {
    "cat": "product_category", "pay": "payment_method", "month": "visit_month", "utype": "user_type", "seg": "ss.seg", "dbucket": "ss.dbucket", "pband": "ss.pband",
    "bucket": "duration_bucket", "purch": "purchased", "loc": "location", "dev": "device_type", "chan": "marketing_channel"}.items()],
    *[f"(q.{k} IS NULL OR {c}{op}q.{k})" for k, c, op in [
        ("lo", "visit_date", ">="), ("hi", "visit_date", "<="), ("rmin", "rating", ">="), ("dmin", "discount_percent", ">="), ("dmax", "discount_percent", "<=")]]])
SLICE_TABLE = SESSIONS + BUYER_SEGMENTS + f""",{ASKED},
got AS (SELECT request_id, {metrics(TOTALS, True)} FROM known q JOIN ss ON {ASKS} GROUP BY request_id)
SELECT q.request_id, {', '.join(f'COALESCE({m},0) AS {m}' for m in TOTALS)} FROM q LEFT JOIN got USING (request_id)"""


TABLES = {
    "ingest_clean": CLEAN + CLEAN_COLUMNS + " FROM clean",
    "ingest_store_rows": CLEAN + CLEAN_COLUMNS.replace("SELECT", "SELECT DISTINCT", 1) + " FROM clean",
    "ingest_rejects": CLEAN + "SELECT session_id, raw_date AS visit_date, 'unparseable visit_date' AS reason FROM typed WHERE day IS NULL",
    "load_balance": CLEAN + f""", twice AS (SELECT *, session_id AS k FROM typed UNION ALL SELECT *, session_id FROM typed WHERE session_id%79=3),
        judged AS (SELECT k, CASE WHEN day IS NULL THEN 'unparseable visit_date' WHEN k%97=0 THEN 'out of range unit_price'
            WHEN k%89=1 AND abs(unit_cents)>1 THEN 'out of range gross_value' ELSE 'stored' END AS ending FROM twice),
        kept AS (SELECT k, k%83=2 AS blank, COUNT(*) AS n FROM judged WHERE ending='stored' GROUP BY 1)
        SELECT ending, {big('COUNT(*)')} AS n FROM judged WHERE ending<>'stored' GROUP BY 1
        UNION ALL SELECT 'stored', {big('SUM(CASE WHEN blank THEN n ELSE 1 END)')} FROM kept
        UNION ALL SELECT 'repeated session_id', {big('SUM(n-1)')} FROM kept WHERE NOT blank HAVING SUM(n-1)>0""",
    "source_fingerprint": FINGERPRINT,
    "csv_quoted": CSV_QUOTED,
    "meta_summary": FINDINGS + key_values(META),
    "store_status": SESSIONS + f"SELECT {big('COUNT(*)')} AS rows, CAST(40 AS BIGINT) AS columns, COUNT(*)>0 AS ready FROM sessions",
    "export_totals": SESSIONS + f"SELECT COUNT(*)>0 AS ready, {metrics(TOTALS, True)} FROM sessions",
    "export_segments": SEGMENTS + "SELECT * FROM segments",
    "totals": SESSIONS + f"SELECT {metrics(TOTALS, True)} FROM sessions",
    **{f"group_{d}": grouped(d, list(METRICS)) for d in DIMENSIONS},
    **{f"options_{k}": options(d) for k, d in OPTION_DIMS.items()},
    "top_categories": grouped("category", ["revenue", "aov"], "ORDER BY revenue DESC, key LIMIT 3"),
    "top_products": grouped("product", ["revenue", "units", "sessions"], "ORDER BY revenue DESC, key LIMIT 10"),
    "bottom_locations": grouped("location", ["conversion", "sessions"], "ORDER BY conversion, key LIMIT 5"),
    "payment_by_key_desc": grouped("payment", ["purchases"], "ORDER BY key DESC LIMIT 4"),
    **{n: SESSIONS + (BUYER_SEGMENTS if n.startswith("seg_") else "")
       + f"SELECT {metrics(TOTALS, True)} FROM sessions WHERE {w}" for n, w in SLICES.items()},
    "slice_batch": per_request({n: SLICES[n] for n in BATCH}, TOTALS),
    "slice_table": SLICE_TABLE,
    "slice_date_forms": per_request(DATE_FORMS, ["sessions", "purchases", "revenue"]),
    "slice_labels": SESSIONS + LABELS,
    "segments": SEGMENTS + "SELECT * FROM segments",
    "segments_sliced": SESSIONS + BUYER_SEGMENTS + ", sl AS (SELECT * FROM sessions WHERE product_category=2 AND "
                       + IN_SEGMENT.format("high") + ")" + segmented("sl") + "SELECT * FROM segments",
    "segment_assign": SEGMENTS + f"SELECT customer_id, {rupees('revenue_cents')} AS revenue, CASE WHEN revenue_cents>0 THEN rn END AS rn, segment FROM seg",
    "segment_headline": SEGMENTS + "SELECT * FROM head",
    "pareto_curve": SEGMENTS + f"""SELECT segment, seg_ord, ROUND({pct('SUM(s.customers) OVER w', 't.customers')},2) AS cum_customers,
        ROUND({pct('SUM(s.revenue_cents) OVER w', 't.revenue_cents')},2) AS cum_revenue
        FROM sums s, total t WINDOW w AS (ORDER BY seg_ord ROWS UNBOUNDED PRECEDING)""",
    "freq_hist": SEGMENTS + f"""SELECT LEAST(purchases,4) AS n, CASE WHEN LEAST(purchases,4)<4 THEN CAST(LEAST(purchases,4) AS VARCHAR) ELSE '4+' END AS label,
        {big('COUNT(*)')} AS customers FROM cust WHERE purchases>=1 GROUP BY 1,2""",
    "sessions_hist": SEGMENTS + f"SELECT sessions, {big('COUNT(*)')} AS customers FROM cust GROUP BY 1 ORDER BY 1 LIMIT 12",
    "funnel": funnel("sessions", SESSIONS),
    "funnel_by_user_type": funnel("sessions", SESSIONS, "user_type AS key, 'User type ' || user_type AS label", "GROUP BY user_type"),
    "funnel_events": funnel("ev", EVENTS),
    "trend_day": trend("day"), "trend_week": trend("week"), "trend_month": trend("month"),
    "trend_auto": trend("month", TREND), "trend_auto_week": trend("week", TREND, SPRING_TO_AUTUMN),
    "trend_auto_day": trend("day", TREND, "visit_date>=DATE '1997-03-01' AND visit_date<=DATE '1997-04-05'"),
    "trend_seg": trend("month", TREND, HIGH),
    "group_category_seg": grouped("category", list(METRICS), source=f"(SELECT * FROM sessions WHERE {HIGH}) AS s"),
    "trend_events": trend("day", prefix=EVENTS, source="ev"),
    "discount_corr": SESSIONS + "SELECT ROUND(corr(discount_percent, purchased),6) AS pearson FROM sessions",
    "dq_profile_counts": LONG + "SELECT * FROM counts",
    "dq_profile_numeric": LONG + "SELECT * FROM stats",
    "quartiles": LONG + "SELECT * FROM quart",
    "dq_outliers": LONG + "SELECT * FROM outl",
    "dq_top_values": LONG + "SELECT * FROM top3",
    "dq_columns": PROFILE,
    "dq_rules": RULE_COUNTS + "SELECT * FROM rules",
    "dq_findings": FINDINGS + "SELECT * FROM said",
    "dq_duplicates": CLEAN + f"SELECT session_id, {big('COUNT(*)')} AS copies FROM clean GROUP BY 1 HAVING COUNT(*)>1",
    "dq_duplicate_rows": RAW + f"SELECT {big(DUPLICATE_ROWS)} AS duplicate_rows",
    "dq_facts": SESSIONS + key_values(facts("sessions")),
    "dq_sku_stability": SESSIONS + f""", p AS (SELECT product_id, {big('COUNT(DISTINCT product_category)')} AS categories FROM sessions GROUP BY 1)
        SELECT categories, {big('COUNT(*)')} AS products FROM p GROUP BY 1""",
    "dq_code_crosstab": CLEAN + f""", d AS (SELECT TRY_STRPTIME(visit_date,'%d-%m-%Y') AS day, CAST(visit_weekday AS INT) AS w, CAST(visit_season AS INT) AS s FROM raw),
        c AS (SELECT 'weekday' AS code, w AS shipped, CAST(isodow(day)-1 AS INT) AS derived FROM d WHERE day IS NOT NULL
        UNION ALL SELECT 'season', s, CAST(CASE WHEN month(day) IN (3,4,5) THEN 1 WHEN month(day) IN (6,7,8) THEN 2 WHEN month(day) IN (9,10,11) THEN 0 ELSE 3 END AS INT) FROM d WHERE day IS NOT NULL)
        SELECT code, shipped, derived, {big('COUNT(*)')} AS n, shipped=derived AS agrees FROM c GROUP BY 1,2,3""",
    "rating_mode": SESSIONS + RATING_MODE.format("sessions"),
    "fmt_totals": SESSIONS + f", t AS (SELECT {metrics(TOTALS, True)} FROM sessions) " + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, '{KINDS[m]}' AS kind, {show(m, KINDS[m])} AS display FROM t" for m in TOTALS),
    "fmt_category_table": (f"{SESSIONS}, g AS (SELECT 'Category ' || product_category AS label, {metrics(TABLE_KINDS)} FROM sessions GROUP BY 1) "
                           f"SELECT label, {', '.join(f'{show(m, k)} AS {m}' for m, k in TABLE_KINDS.items())} FROM g"),
    "fmt_segment_table": SEGMENTS + "SELECT segment, " + ", ".join(f"{show(c, k)} AS {n}" for n, c, k in [
        ("customers", "customers", "count"), ("share", "customer_share", "pct2"), ("revenue", "revenue", "inr"),
        ("revenue_share", "revenue_share", "pct2"), ("aov", "aov", "rupee"), ("conversion", "conversion", "pct2"),
        ("repeat_rate", "repeat_rate", "pct")]) + " FROM segments",
    "fmt_matrix": MATRIX,
}
