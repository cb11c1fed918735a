"""Every registered query against its SQL, and the shape of its plan."""

import re

import pytest

import __spark_entry__ as entry
import oracle_check
from basketlens.plans.catalog import QUERIES
from oracle import ORACLES

# Nodes that would not survive the data growing.
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "MapInPandas", "FlatMapGroupsInPandas"]
# Bytes of text files are folded block by block, which no built-in function does.
OF_BYTES = {"source_fingerprint", "csv_quoted"}


@pytest.fixture(scope="module")
def duck(folder):
    return oracle_check.connect(folder)


def test_every_query_but_one_has_an_oracle():
    assert set(QUERIES) - set(ORACLES) == {"export_json"}
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, folder, name):
    df = QUERIES[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert name in OF_BYTES or not [node for node in FORBIDDEN if node in plan]
    if name in ORACLES:
        assert oracle_check.differences(duck, df, ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_the_comparison_notices_differences(spark, duck):
    df = spark.sql("SELECT 1L AS a, 0.5D AS b")
    assert oracle_check.differences(duck, df, "SELECT CAST(1 AS BIGINT) AS a, CAST(0.5 AS DOUBLE) AS b") == []
    assert oracle_check.differences(duck, df, "SELECT CAST(1 AS BIGINT) AS a, CAST(0.6 AS DOUBLE) AS b")
    assert oracle_check.differences(duck, df, "SELECT CAST(1 AS INTEGER) AS a, CAST(0.5 AS DOUBLE) AS b")
    assert oracle_check.differences(duck, df, "SELECT CAST(1 AS BIGINT) AS a")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["page", "section_ord", "kind"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_slicers_reach_the_scan(spark, tmp_path, folder):
    from basketlens.operators.aggregate import totals
    from basketlens.operators.slicers import apply_slicers
    from basketlens.sources.store import stored_sessions, write_sessions
    from basketlens.sources.tables import adapt_orders
    write_sessions(adapt_orders(spark, folder), str(tmp_path))
    stored = stored_sessions(spark, str(tmp_path))
    assert len(stored.columns) == 40
    plan = _plan(apply_slicers(stored, {"cat": "2", "month": "6"}).groupBy("user_type").count())
    assert "EqualTo(product_category,2)" in plan
    assert re.search(r"PartitionFilters: \[[^\]]*visit_month", plan)
    assert re.search(r"ReadSchema: struct<user_type:int,product_category:int>", plan)
    same = lambda df: [tuple(r) for r in totals(df).collect()]
    assert same(stored) == same(adapt_orders(spark, folder))


def test_unused_lookups_are_not_joined(spark, folder):
    from basketlens.sources.tables import adapt_orders
    plan = _plan(adapt_orders(spark, folder).groupBy("customer_id").agg({"purchased": "sum"}))
    assert "Join" not in plan and "lineitem" not in plan


def test_top_values_are_limited_before_the_shuffle(spark, sessions):
    from basketlens.operators.quality import top_values
    counts = spark.sql("SELECT IF(id % 2 = 0, 'a', 'b') AS name, CAST(id AS STRING) AS value, id AS n FROM range(100)")
    assert re.search(r"WindowGroupLimit.*Partial", _plan(top_values(counts)))


def test_a_segment_slice_is_joined_once(spark, sessions):
    from basketlens.operators.slicers import apply_slicers
    for segment in ("high", "window"):
        plan = _plan(apply_slicers(sessions, {"seg": segment}))
        assert "Join" not in plan and "ExistingRDD" in plan


def test_a_batch_of_slices_multiplies_no_rows(spark, sessions):
    from basketlens.operators.slicers import masked_bases, masks
    from pyspark.sql import functions as F
    marked = sessions.withColumns(masks({"a": F.col("product_category") == 1, "b": F.col("purchased") == 1}))
    plan = _plan(masked_bases(marked, {"sessions", "customers"}))
    assert all("HashAggregate" in part for part in plan.split("Generate posexplode")[1:]) and "Generate posexplode" in plan
