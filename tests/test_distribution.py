"""Global order and skewed joins against brute force."""

import random

from pyspark.sql import functions as F

from basketlens.operators import joins, ordering, slicers
from basketlens.operators.quality import numeric_counts, quartiles, value_counts


def test_row_numbers_with_ties(spark):
    random.seed(3)
    rows = [(i, random.choice([0, 0, 5, 7, 7, random.randint(0, 50)])) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, score long").repartition(13)
    got = ordering.row_numbers(df, F.col("score").desc(), F.col("id").asc()).collect()
    expected = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert {r.id: r.rn for r in got} == expected


def test_row_numbers_of_nothing(spark):
    df = spark.createDataFrame([], "id long")
    assert ordering.row_numbers(df, F.col("id")).collect() == []


def test_order_statistics_at_every_size_modulo_four(spark):
    for size in (1, 2, 3, 4, 5, 101, 102, 103, 104):
        random.seed(size)
        values = [random.randint(0, 30) for _ in range(size)]
        raw = spark.createDataFrame([(str(v),) for v in values], "quantity string")
        row = quartiles(value_counts(raw)).first()
        ordered = sorted(values)
        middle = (ordered[(size - 1) // 2] + ordered[size // 2]) / 2
        assert (row.q1, row.q3, row.median_num) == (
            ordered[int(0.25 * (size - 1))], ordered[int(0.75 * (size - 1))], middle)


def test_unreadable_numbers_are_left_out(spark):
    texts = ["1", " 2 ", "x", "", "NaN", "Infinity", "12d", "3e2", None]
    raw = spark.createDataFrame([(t,) for t in texts], "quantity string")
    assert sorted(r.num for r in numeric_counts(value_counts(raw)).collect()) == [1.0, 2.0, 300.0]


def test_spread_join_equals_plain_join(spark):
    # One key holds a third of the rows, another a sixth.
    keys = [1] * 400 + [2] * 200 + list(range(3, 603))
    facts = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "session_id long, customer_id long")
    people = facts.groupBy("customer_id").count().filter("customer_id % 3 <> 0")
    hot = joins.hot_keys(facts.groupBy("customer_id").count(), "customer_id", "count", hot_rows=50)
    assert {r.customer_id: r._pieces for r in hot.collect()} == {1: 8, 2: 4}
    for how in ("left_semi", "left_anti", "left", "inner"):
        got = joins.spread_join(facts, people, "customer_id", how, hot)
        want = facts.join(people, "customer_id", how)
        assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == \
            sorted(map(tuple, want.collect()), key=str)


def test_hot_rows_are_dealt_over_several_pieces(spark):
    facts = spark.createDataFrame([(i, 1) for i in range(1000)], "session_id long, customer_id long")
    hot = joins.hot_keys(facts.groupBy("customer_id").count(), "customer_id", "count", hot_rows=100)
    dealt = facts.join(hot, "customer_id").groupBy(F.pmod(F.xxhash64("session_id"), F.col("_pieces"))).count()
    sizes = [r[1] for r in dealt.collect()]
    assert len(sizes) == 10 and max(sizes) < 200


def test_segment_slices_with_forced_spreading(spark, sessions):
    for key in ("high", "mid", "core", "window"):
        plain = slicers.slice_segment(sessions, sessions, key).count()
        assert plain == slicers.slice_segment(sessions, sessions, key, hot_rows=2).count() > 0


def test_few_hot_keys_however_large_the_table(spark):
    counts = spark.range(40_000).select(F.col("id").alias("k"), F.lit(1000).cast("long").alias("n"))
    assert joins.hot_keys(counts, "k", "n", hot_rows=10).count() <= joins.MAX_HOT_KEYS
