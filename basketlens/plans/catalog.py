"""Registered queries: name -> (spark, folder) -> DataFrame, all over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import display as D
from ..functions.dimensions import DIMENSIONS
from ..functions.metrics import GROUP_METRICS, METRICS, TOTALS
from ..operators import aggregate as A
from ..operators import customers as C
from ..operators import quality as Q
from ..operators import slicers as S
from ..operators.funnel import funnel, funnel_by
from ..operators.requests import table_totals
from ..operators.trend import trend
from ..session import prepare
from ..sources import blocks, cleaning, raw_csv, store
from ..sources.tables import event_sessions, raw_sessions, sessions
from . import export, pages

Query = Callable[[SparkSession, str], DataFrame]

# The slicer requests whose effect is checked one by one, as argument maps.
SLICES: dict[str, dict[str, str]] = {
    "slice_cat": {"cat": "2"}, "slice_pay": {"pay": "1"}, "slice_dev": {"dev": "0"},
    "slice_utype": {"utype": "1"}, "slice_chan": {"chan": "4"}, "slice_loc": {"loc": "16"},
    "slice_bucket": {"bucket": "Long"}, "slice_purch": {"purch": "1"},
    "slice_purch_0": {"purch": "0"}, "slice_month": {"month": "11"},
    "slice_dbucket_0": {"dbucket": "0"}, "slice_dbucket": {"dbucket": "3"},
    "slice_pband": {"pband": "2"}, "slice_pband_3": {"pband": "3"},
    "slice_from": {"from": "1997-03-01"}, "slice_to": {"to": "15-06-1998"},
    "slice_combo": {"cat": "2", "pay": "1", "month": "6"}, "slice_empty": {"cat": "99"},
    "slice_unknown_text": {"bucket": "xyz", "loc": "not-a-real-value"},
    "slice_month_0": {"month": "0"}, "slice_seg_unknown": {"seg": "not-a-segment"},
    "slice_rmin": {"rmin": "4"}, "slice_dmin": {"dmin": "10"}, "slice_dmax": {"dmax": "15"},
    "seg_semi_high": {"seg": "high"}, "seg_semi_mid": {"seg": "mid"},
    "seg_semi_core": {"seg": "core"}, "seg_anti_window": {"seg": "window"},
}
# The batch answers 22 of these requests in one scan.
BATCH = {name: SLICES[name] for name in [
    "slice_cat", "slice_pay", "slice_dev", "slice_utype", "slice_chan", "slice_loc", "slice_bucket",
    "slice_purch", "slice_purch_0", "slice_month", "seg_semi_high", "seg_anti_window",
    "slice_dbucket_0", "slice_dbucket", "slice_pband", "slice_from", "slice_to", "slice_combo",
    "slice_empty", "slice_unknown_text", "slice_month_0", "slice_seg_unknown"]}
DATE_FORMS = {
    "iso": {"from": "1997-03-01", "to": "1997-09-30"}, "dmy": {"from": "01-03-1997", "to": "30-09-1997"},
    "slashes": {"from": "01/03/1997", "to": "1997/09/30"},
    "past_month_end": {"from": "31-02-1997", "to": "31-09-1997"},
    "unusable": {"from": "1997-13-01", "to": "soon"},
}
LABELLED = {"coded": {"cat": "2", "pay": "1", "month": "6"}, "text": {"bucket": "Long", "purch": "1"},
            "bands": {"dbucket": "3", "pband": "2"}, "dates": {"from": "1997-03-01", "seg": "high"},
            "absent": {"cat": "99", "loc": "16", "utype": "1.0"}}


# Requests of a table, as (key, which requests name it, the text they give): unusable and absent values among them.
REQUESTS = 5000
ASKED = [
    ("cat", "id % 3 = 0", "CAST(id % 9 AS STRING)"), ("pay", "id % 5 = 1", "concat(' ', id % 7, '.0')"),
    ("month", "id % 4 = 2", "CAST(id % 14 AS STRING)"),
    ("from", "id % 6 = 3", "date_format(date_add(DATE '1992-01-01', CAST(id * 37 % 2500 AS INT)), IF(id % 2 = 0, 'yyyy-MM-dd', 'dd/MM/yyyy'))"),
    ("to", "id % 7 = 4", "IF(id % 49 = 4, '31-02-1997', date_format(date_add(DATE '1993-01-01', CAST(id * 53 % 2200 AS INT)), 'yyyy/MM/dd'))"),
    ("utype", "id % 11 = 5", "IF(id % 2 = 0, 'abc', '1')"), ("seg", "id % 13 = 6", "element_at(array('high', 'mid', 'core', 'window', 'none'), CAST(id % 5 AS INT) + 1)"),
    ("dbucket", "id % 10 = 7", "CAST(id % 6 AS STRING)"), ("pband", "id % 10 = 8", "CAST(id % 4 AS STRING)"),
    ("bucket", "id % 12 = 9", "element_at(array('Long', 'Short', 'Very Long', 'nope', ' '), CAST(id % 5 AS INT) + 1)"),
    ("purch", "id % 8 = 1", "CAST(id % 3 AS STRING)"), ("rmin", "id % 9 = 2", "CAST(id % 6 AS STRING)"),
    ("dmin", "id % 14 = 3", "CAST(id % 30 AS STRING)"), ("dmax", "id % 15 = 4", "IF(id % 2 = 0, '1e300', CAST(id % 30 AS STRING))"),
    ("loc", "id % 17 = 2", "CAST(id % 30 AS STRING)"), ("dev", "id % 19 = 1", "CAST(id % 4 AS STRING)"), ("chan", "id % 21 = 3", "concat(id % 5, 'e0')"),
    ("nokey", "id % 23 = 0", "'1'")]


def _requests(spark: SparkSession) -> DataFrame:
    cells = ", ".join(f"'{key}', IF({test}, {text}, NULL)" for key, test, text in ASKED)
    return spark.range(REQUESTS).selectExpr("concat('r', id) AS request_id", f"stack({len(ASKED)}, {cells}) AS (key, value)")


def _slice_table(spark: SparkSession, folder: str) -> DataFrame:
    return table_totals(sessions(spark, folder), _requests(spark))


def _sliced(args: dict[str, str]) -> Query:
    return lambda spark, folder: A.totals(S.apply_slicers(sessions(spark, folder), args))


def _on_sessions(work: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: work(sessions(spark, folder))


def _on_raw(work: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: work(raw_sessions(spark, folder))


def _on_counts(work: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_raw(lambda raw: work(Q.value_counts(raw)))


def _on_clean(work: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_raw(lambda raw: work(cleaning.accepted(cleaning.parse(raw))))


def _ingest_clean(clean: DataFrame) -> DataFrame:
    return clean.withColumn("visit_date", F.col("visit_date").cast("string"))


def _metadata(raw: DataFrame) -> DataFrame:
    parsed = cleaning.parse(raw)
    return Q.metadata(raw, parsed, cleaning.accepted(parsed))


def _segments(df: DataFrame) -> DataFrame:
    return export.segment_table(df)


def _sums(df: DataFrame) -> DataFrame:
    return C.segment_sums(C.with_segments(C.rollup(df)))


def _fmt_totals(df: DataFrame) -> DataFrame:
    one = A.totals(df)
    parts = [p for m in TOTALS for p in (F.lit(m), F.lit(METRICS[m].kind), F.col(m))]
    long = one.select(F.stack(F.lit(len(TOTALS)), *parts).alias("metric", "kind", "value"))
    return long.select("metric", "kind", D.fmt_by(F.col("kind"), F.col("value")).alias("display"))


def _formatted(df: DataFrame, first: str, columns: list[tuple[str, str, str]]) -> DataFrame:
    return df.select(first, *[D.fmt(F.col(c), kind).alias(name) for name, c, kind in columns])


def _fmt_category_table(df: DataFrame) -> DataFrame:
    needed = ["revenue", "conversion", "aov", "avg_price", "sessions"]
    return _formatted(A.group(df, "category", needed), "label", pages.CATEGORY_TABLE)


def _fmt_segment_table(df: DataFrame) -> DataFrame:
    return _formatted(_segments(df), "segment", pages.SEGMENT_TABLE)


def _fmt_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Every formatter over every order's price, and the date label of its date."""
    prepare(spark)
    x = F.col("o_totalprice")
    return spark.read.parquet(f"{folder}/orders.parquet").select(
        "o_orderkey", D.number(x).alias("number0"), D.number(x, 2, "west").alias("number2_west"),
        D.inr(x, 2).alias("inr2"), D.inr_m(x).alias("inr_m"), D.inr_short(x).alias("inr_short"),
        D.compact(x).alias("compact"), D.pct(x / F.lit(1e5), 2).alias("pct2"),
        D.pct(x / F.lit(1e5) - 1, 1, signed=True).alias("pct_signed"), D.mmss(x / F.lit(100.0)).alias("mmss"),
        D.date_label(F.col("o_orderdate").cast("date")).alias("date_label"))


# Tables whose rows are written as text, in order of the first column, to take the digest of their bytes.
DIGESTED = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
            "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
            "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]}


def _home(spark: SparkSession, name: str) -> str:
    return f"{prepare(spark).sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and digest of some tables' text, however many files it is in."""
    home = _home(spark, "digested")
    for name, columns in DIGESTED.items():
        rows = spark.read.parquet(f"{folder}/{name}.parquet").orderBy(columns[0])
        rows.select(F.concat_ws("|", *columns)).write.text(f"{home}/{name}")
    return blocks.folders(raw_csv.fingerprint(spark, [f"{home}/{name}" for name in DIGESTED])).select("name", "bytes", "digest")


def _csv_quoted(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files with line breaks and doubled quotes inside fields, and with rows of too many and too few
    fields, read back: the id and the spoilt field of good rows, the text of the others."""
    raw, home = raw_sessions(spark, folder), _home(spark, "quoted")
    key, bucket = F.col("session_id").try_cast("bigint"), F.col("session_duration_bucket")
    torn = raw.withColumn("session_duration_bucket", F.when(key % 13 == 0, F.concat(F.lit('two "lines",\n'), bucket)).otherwise(bucket))
    torn.write.options(header=True, emptyValue="", escape='"').csv(f"{home}/torn")
    more = F.when(key % 101 == 5, ",surplus").when(key % 103 == 7, "\ntoo,few")
    odd = raw.select(F.concat(F.concat_ws(",", *raw.columns), more).alias("line")).filter("line IS NOT NULL")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of its file
    odd.select(F.when(first, F.concat(F.lit(",".join(raw.columns) + "\n"), "line")).otherwise(F.col("line"))).write.text(f"{home}/odd")
    rows = raw_csv.read_raw(spark, [f"{home}/torn", f"{home}/odd"])
    good = F.col(raw_csv.BROKEN).isNull()
    return rows.select(F.when(good, F.col("session_id")).alias("session_id"), F.when(good, bucket).alias("bucket"), F.col(raw_csv.BROKEN).alias("malformed"))


def _spoilt_store(spark: SparkSession, folder: str) -> str:
    """A store built from CSV files of spoilt rows: two column orders, amounts and products out of
    range, blank ids, and rows that occur twice."""
    raw = raw_sessions(spark, folder)
    key = F.col("session_id").try_cast("bigint")
    spoil = lambda df: df.withColumns({
        "unit_price": F.when(key % 97 == 0, "1e40").otherwise(F.col("unit_price")),
        "quantity": F.when(key % 89 == 1, "9000000000000000000").otherwise(F.col("quantity")),
        "session_id": F.when(key % 83 == 2, "").otherwise(F.col("session_id"))})
    home = _home(spark, "spoilt")
    out = lambda df, name: df.write.option("header", True).option("emptyValue", "").csv(f"{home}/{name}")
    out(spoil(raw), "first files")
    out(spoil(raw.filter(key % 79 == 3)).select(*reversed(raw.columns)), "other_order")
    export.build_store(spark, [f"{home}/first files", f"{home}/other_order"], f"{home}/store")
    return f"{home}/store"


def _load_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Rows stored and rows set aside by reason; together all raw rows."""
    here = _spoilt_store(spark, folder)
    rejects = store.read_table(spark, here, "rejects").groupBy(F.col("reason").alias("ending")).agg(F.count(F.lit(1)).alias("n"))
    return rejects.unionByName(store.stored_sessions(spark, here).agg(F.lit("stored").alias("ending"), F.count(F.lit(1)).alias("n")))


def _trend_slice(args: dict[str, str]) -> Query:
    return _on_sessions(lambda df: trend(S.apply_slicers(df, args), pages.TREND_METRICS))


def _page(name: str, args: dict[str, str] | None = None) -> Query:
    return _on_sessions(lambda df: pages.PAGES[name](S.apply_slicers(df, args or {})))


# A slice that is shown by weeks.
WEEKS = {"cat": "2", "from": "1997-03-01", "to": "1997-09-30"}

GROUPS = {f"group_{dim}": _on_sessions(lambda df, dim=dim: A.group(df, dim, GROUP_METRICS))
          for dim in DIMENSIONS}
OPTIONS = {f"options_{key}": _on_sessions(lambda df, key=key: S.slicer_options(df, key))
           for key in S.OPTION_SLICERS}

QUERIES: dict[str, Query] = {
    # ingest, store, export
    "ingest_clean": _on_clean(_ingest_clean),
    "ingest_store_rows": _on_clean(lambda c: _ingest_clean(cleaning.one_row_per_session(c))),
    "ingest_rejects": _on_raw(lambda raw: cleaning.rejected(cleaning.parse(raw))),
    "load_balance": _load_balance,
    "meta_summary": _on_raw(_metadata),
    "store_status": _on_sessions(store.status),
    "source_fingerprint": _fingerprint,
    "csv_quoted": _csv_quoted,
    "export_totals": _on_sessions(export.summary),
    "export_segments": _on_sessions(_segments),
    "export_json": lambda spark, folder: export.export(sessions(spark, folder), source=export.provenance(spark, folder)),
    # totals, groups, options
    "totals": _on_sessions(A.totals),
    **GROUPS,
    **OPTIONS,
    "top_categories": _on_sessions(lambda df: A.group(df, "category", ["revenue", "aov"], limit=3)),
    "top_products": _on_sessions(lambda df: A.group(df, "product", ["revenue", "units", "sessions"], limit=10)),
    "bottom_locations": _on_sessions(
        lambda df: A.group(df, "location", ["conversion", "sessions"], limit=5, order="conversion", asc=True)),
    "payment_by_key_desc": _on_sessions(
        lambda df: A.group(df, "payment", ["purchases"], limit=4, order="key")),
    # slicers
    **{name: _sliced(args) for name, args in SLICES.items()},
    "slice_batch": _on_sessions(lambda df: S.slice_totals(df, BATCH)),
    "slice_table": _slice_table,
    "slice_date_forms": _on_sessions(lambda df: S.slice_totals(
        df, DATE_FORMS, ["sessions", "purchases", "revenue"])),
    "slice_labels": _on_sessions(lambda df: S.slice_labels(df, LABELLED)),
    # customers
    "segments": _on_sessions(_segments),
    "segments_sliced": _on_sessions(lambda df: _segments(S.apply_slicers(df, {"cat": "2", "seg": "high"}))),
    "segment_assign": _on_sessions(lambda df: C.assignments(C.with_segments(C.rollup(df)))),
    "segment_headline": _on_sessions(lambda df: C.headline(_sums(df))),
    "pareto_curve": _on_sessions(lambda df: C.pareto_curve(_sums(df))),
    "freq_hist": _on_sessions(lambda df: C.purchase_frequency(C.rollup(df))),
    "sessions_hist": _on_sessions(lambda df: C.sessions_histogram(C.rollup(df))),
    # funnel, trend, correlation
    "funnel": _on_sessions(funnel),
    "funnel_by_user_type": _on_sessions(lambda df: funnel_by(df, "user_type")),
    "funnel_events": lambda spark, folder: funnel(event_sessions(spark, folder)),
    "trend_day": _on_sessions(lambda df: trend(df, granularity="day")),
    "trend_week": _on_sessions(lambda df: trend(df, granularity="week")),
    "trend_month": _on_sessions(lambda df: trend(df, granularity="month")),
    "trend_auto": _trend_slice({}),
    "trend_auto_week": _trend_slice({"from": "1997-03-01", "to": "1997-09-30"}),
    "trend_auto_day": _trend_slice({"from": "1997-03-01", "to": "1997-04-05"}),
    "trend_seg": _trend_slice({"seg": "high"}),
    "group_category_seg": _on_sessions(lambda df: A.group(S.apply_slicers(df, {"seg": "high"}), "category", GROUP_METRICS)),
    "trend_events": lambda spark, folder: trend(event_sessions(spark, folder)),
    "discount_corr": _on_sessions(A.discount_correlation),
    # data quality
    "dq_profile_counts": _on_counts(Q.profile_counts),
    "dq_profile_numeric": _on_counts(lambda counts: Q.numeric_profile(counts)),
    "quartiles": _on_counts(Q.quartiles),
    "dq_outliers": _on_counts(Q.outliers),
    "dq_top_values": _on_counts(Q.top_values),
    "dq_columns": _on_raw(Q.profile),
    "dq_rules": _on_clean(Q.rule_counts),
    "dq_findings": _on_clean(Q.findings),
    "dq_duplicates": _on_clean(Q.duplicate_sessions),
    "dq_duplicate_rows": _on_raw(Q.duplicate_rows),
    "dq_facts": _on_sessions(Q.dataset_facts),
    "dq_sku_stability": _on_sessions(Q.sku_stability),
    "dq_code_crosstab": _on_raw(Q.code_crosstab),
    "rating_mode": _on_sessions(Q.common_rating),
    # display
    "fmt_totals": _on_sessions(_fmt_totals),
    "fmt_category_table": _on_sessions(_fmt_category_table),
    "fmt_segment_table": _on_sessions(_fmt_segment_table),
    "fmt_matrix": _fmt_matrix,
    # report
    "page_overview": _page("overview"),
    "page_customers": _page("customers"),
    "page_conversion": _page("conversion"),
    "page_categories": _page("categories"),
    "page_overview_sliced": _page("overview", WEEKS),
    "page_overview_seg": _page("overview", {"seg": "high"}),
    "pages_all": _on_sessions(pages.every_page),
    "pages_all_sliced": _on_sessions(lambda df: pages.every_page(S.apply_slicers(df, WEEKS))),
    "page_empty": _page("overview", {"cat": "99"}),
    "findings": _on_sessions(pages.findings),
}
