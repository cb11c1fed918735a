"""Tables of requests: read as the slicers read their arguments, answered without multiplying sessions."""

from pyspark.sql import functions as F

from basketlens.functions.metrics import GROUP_METRICS
from basketlens.operators import requests as R
from basketlens.operators import slicers as S
from basketlens.plans.catalog import BATCH, DATE_FORMS, LABELLED, SLICES, _requests

ODD = {"int": ["1", " 1.9 ", "-0.5", "1e0", "1_0", "x", "nan", "inf", "1d", "0x1", "1e300", "-1e300", "", " 1 ", "99999999999999999999"],
       "date": ["1997-3-1", "01-03-1997", "1/3/1997", "1997/02/31", "31-04-1997", "1989-01-01", "2101-01-01", "1997-13-01", "32-01-1997", "1997-1-1x", "19970301"],
       "text": ["Long", " Long ", "nope", "x" * 80], "bands": ["0", "3", "4", " 1", "01"], "segment": ["high", "HIGH", "window"], "outcome": ["0", "1.0", "2", "yes"]}


def frame(spark, requests):
    rows = [(rid, k, v) for rid, args in requests.items() for k, v in (args.items() if args else [(None, None)])]
    return spark.createDataFrame(rows, "request_id string, key string, value string").repartition(3)


def by_id(df):
    return {r.request_id: tuple(r) for r in df.collect()}


def test_values_are_read_as_arguments(spark):
    asked = {f"{s.key}|{v}": {s.key: v} for s in S.SLICERS for v in ODD[s.kind]}
    got = {(r.request_id): r.asked for r in R.coerced(frame(spark, asked)).collect()}
    clamp = lambda v: str(max(-(1 << 63), min((1 << 63) - 1, v)))
    for rid, args in asked.items():
        (key, text), = args.items()
        slicer = R.BY_KEY[key]
        value = S.coerce(slicer, text)
        shown = None if value is None else str((value - __import__("datetime").date(1970, 1, 1)).days) if slicer.kind == "date" else clamp(value) if isinstance(value, int) else value
        assert got.get(rid) == shown, rid


def test_a_table_answers_as_single_requests_do(spark, sessions):
    asked = {**SLICES, **{f"d_{k}": v for k, v in DATE_FORMS.items()}, **{f"l_{k}": v for k, v in LABELLED.items()}, "all": {}, "unusable": {"cat": "x", "nokey": "1"},
             "far": {"dmax": "1e300", "rmin": "-1e300"}, "none": {"dmin": "1e300"}, "two": {"cat": "2", "seg": "mid", "rmin": "4"}}
    table = by_id(R.table_totals(sessions, frame(spark, asked), GROUP_METRICS))
    assert table == by_id(S.slice_totals(sessions, asked, GROUP_METRICS))
    assert by_id(R.table_totals(sessions, frame(spark, {"all": {}}), ["sessions"]))["all"][1] == sessions.count()
    assert R.table_totals(sessions, frame(spark, {"a": {}}).limit(0), ["sessions"]).count() == 0
    nobody = by_id(R.table_totals(sessions.limit(0), frame(spark, asked), ["sessions", "revenue"]))
    assert {v[1:] for v in nobody.values()} == {(0.0, 0.0)} and len(nobody) == len(asked)


def test_passes_and_shuffled_indexes_change_nothing(spark, sessions, monkeypatch):
    asked = frame(spark, BATCH | DATE_FORMS)
    whole = by_id(R.table_totals(sessions, asked, ["sessions", "customers", "revenue"]))
    monkeypatch.setattr(R, "SLAB", 10)
    monkeypatch.setattr(R, "BROADCAST_BYTES", 0)
    assert by_id(R.table_totals(sessions, asked, ["sessions", "customers", "revenue"])) == whole


def test_many_values_for_a_key_and_requests_without_a_name(spark, sessions):
    rows = [("a", "cat", "1"), ("a", "cat", "2"), (None, "cat", "3"), ("b", None, None), ("b", "cat", None)]
    got = by_id(R.table_totals(sessions, spark.createDataFrame(rows, "request_id string, key string, value string"), ["sessions"]))
    one = lambda c: sessions.filter(f"product_category = {c}").count()
    assert {k: v[1] for k, v in got.items()} == {"a": one(2), None: one(3), "b": sessions.count()}


def test_no_request_is_an_expression(spark, sessions):
    small, large = (R.table_totals(sessions, _requests(spark).filter(F.substring("request_id", 2, 9).cast("int") < n), ["sessions", "customers"]) for n in (64 * 2, 64 * 16))
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (small, large)]
    assert "r100" not in plans[1] and len(plans[1]) < 1.2 * len(plans[0])
    physical = large._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert all("HashAggregate" in part for part in physical.split("Generate explode")[1:]) and "Generate explode" in physical


def test_set_bits(spark):
    values = {0: [], 1: [0], (1 << 63) - 1: list(range(63)), -(1 << 63): [63], -1: list(range(64)), 1 << 40 | 1 << 8 | 5: [0, 2, 8, 40]}
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", S.set_bits(F.col("v")).alias("bits"))
    assert {r.v: r.bits for r in rows.collect()} == values
    assert "array(0, 1)" not in rows._jdf.queryExecution().optimizedPlan().toString()  # the table is one literal


def test_busy_keys_small_blocks_and_large_sums_change_nothing(spark, sessions, monkeypatch):
    """Keys dealt over tasks, groups that go on in the next batch, and sums whose upper 32 bits count."""
    wide = sessions.withColumn("revenue_cents", F.expr("IF(session_id % 2 = 0, -1, 1) * 4000000000123L * (session_id % 7)")).withColumn(
        "customer_id", F.expr("CASE WHEN session_id % 3 = 0 THEN 1L WHEN session_id % 11 = 0 THEN NULL ELSE customer_id END")).checkpoint()
    asked = {name: BATCH[name] for name in ["slice_cat", "slice_purch", "slice_month", "slice_combo", "slice_empty"]}
    expected = by_id(S.slice_totals(wide, asked, GROUP_METRICS))
    for name, value in (("HOT_ROWS", 3), ("UNION_ROWS", 7), ("BLOCK_ROWS", 5)):
        monkeypatch.setattr(R, name, value)
    got = R.table_totals(wide, frame(spark, asked), GROUP_METRICS)
    assert by_id(got) == expected
