"""Column profile, consistency rules and dataset facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import case, div0, to_double
from ..model import (CODE_LABELS, NUMERIC_COLUMNS, SEASON_NAMES, SEASON_OF_MONTH, WEEKDAY_NAMES, column_role,
                     column_type)
from .ordering import split_in_order, values_at

# Fixed values of the profile: fewest numbers for outlier fences, values listed per column,
# longest listed value.
FENCE_MIN_ROWS, TOP_VALUES, VALUE_CHARS = 100, 3, 40


# ------------------------------------------------------------------------------ profile
def value_counts(raw: DataFrame) -> DataFrame:
    """(name, value, n) for all columns at once, split in numeric order and checkpointed.

    One unpivot and one aggregation serve every column, so 29 columns cost one shuffle.
    Frequent values combine map-side; distinct ones are spread by the range split.
    """
    texts = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns])
    long = texts.unpivot([], texts.columns, "name", "value")
    counted = long.groupBy("name", F.coalesce("value", F.lit("")).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    numeric = F.when(F.col("name").isin(NUMERIC_COLUMNS), to_double(F.col("value")))
    return split_in_order(counted.withColumn("num", numeric),
                          F.col("name"), F.col("num"), F.col("value"))


def profile_counts(counts: DataFrame) -> DataFrame:
    blank = F.trim("value") == ""
    return counts.groupBy("name").agg(
        F.sum(F.when(blank, 0).otherwise(F.col("n"))).alias("not_nulls"),
        F.sum(F.when(blank, F.col("n")).otherwise(0)).alias("nulls"),
        F.count(F.lit(1)).alias("distinct_n"))


def top_values(counts: DataFrame) -> DataFrame:
    """Most frequent values per column, ties by value.

    ``rank <= k`` lets Spark keep k rows per column and partition before the shuffle.
    """
    order = Window.partitionBy("name").orderBy(F.col("n").desc(), F.col("value"))
    return (counts.select("name", "value", "n").withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= TOP_VALUES)
            .select("name", "rank", F.substring("value", 1, VALUE_CHARS).alias("value"), "n"))


def numeric_counts(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("num").isNotNull())


def quartiles(counts: DataFrame) -> DataFrame:
    """Order statistics per numeric column: positions floor(q*(n-1)) and the middle one or two."""
    numbers = numeric_counts(counts)
    sizes = numbers.groupBy("name").agg(F.sum("n").alias("size"))
    last = F.col("size") - 1
    whole = lambda c: F.floor(c).cast("bigint")
    targets = sizes.select("name", F.stack(
        F.lit(4),
        F.lit("q1"), whole(last / 4) + 1, F.lit("q3"), whole(last * 3 / 4) + 1,
        F.lit("m1"), whole(last / 2) + 1, F.lit("m2"), whole(F.col("size") / 2) + 1,
    ).alias("which", "position"))
    found = values_at(numbers, targets, "name", "num", "n")
    at = lambda which: F.max(F.when(F.col("which") == which, F.col("num")))
    return found.groupBy("name").agg(at("q1").alias("q1"), at("q3").alias("q3"),
                                     ((at("m1") + at("m2")) / 2).alias("median_num"))


def numeric_profile(counts: DataFrame) -> DataFrame:
    """Min, max, mean and the number of readable values per numeric column.

    Values that a decimal holds are summed exactly, in any order; the rest (very large, very
    small) are added in double arithmetic, so that no value is left out of the sum.
    """
    decimal = F.trim("value").try_cast("decimal(28,6)")
    times = F.col("n").cast("decimal(20,0)")
    exact = F.when(decimal.cast("double") == F.col("num"), F.try_multiply(decimal, times))
    rest = F.when(exact.isNull(), F.col("num") * F.col("n"))
    every = F.sum(F.col("num") * F.col("n"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    total = F.when(F.count(exact) == 0, every).otherwise(F.coalesce(
        F.try_sum(exact).cast("double") + zero(F.sum(rest)), every))
    return numeric_counts(counts).groupBy("name").agg(
        F.min("num").alias("min_num"), F.max("num").alias("max_num"),
        div0(total, F.sum("n")).alias("mean_num"), F.sum("n").alias("size"))


def fences(counts: DataFrame) -> DataFrame:
    """Outlier fences of the columns with enough numbers (one row per column)."""
    sizes = numeric_counts(counts).groupBy("name").agg(F.sum("n").alias("size"))
    reach = (F.col("q3") - F.col("q1")) * F.lit(1.5)
    return (quartiles(counts).join(sizes, "name").filter(F.col("size") >= FENCE_MIN_ROWS)
            .select("name", (F.col("q1") - reach).alias("outlier_low"),
                    (F.col("q3") + reach).alias("outlier_high")))


def outliers(counts: DataFrame) -> DataFrame:
    beyond = (F.col("num") < F.col("outlier_low")) | (F.col("num") > F.col("outlier_high"))
    # One fence row per source column.
    return (numeric_counts(counts).join(F.broadcast(fences(counts)), "name")
            .groupBy("name", "outlier_low", "outlier_high")
            .agg(F.sum(F.when(beyond, F.col("n")).otherwise(0)).alias("outliers")))


def column_facts(raw: DataFrame) -> DataFrame:
    rows = [(c, i, column_type(c), column_role(c)) for i, c in enumerate(raw.columns)]
    return raw.sparkSession.createDataFrame(rows, "name string, position int, dtype string, role string")


def profile(raw: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """The per-column profile table (17 columns)."""
    counts = value_counts(raw) if counts is None else counts
    tops = top_values(counts)
    listed = tops.groupBy("name").agg(
        F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))),
                              lambda t: F.struct(t["value"].alias("value"), t["n"].alias("count"))))
        .alias("top_values"),
        F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("top"))
    parts = [column_facts(raw), profile_counts(counts), numeric_profile(counts),
             quartiles(counts), listed, outliers(counts)]
    joined = reduce(lambda a, b: a.join(b, "name", "left"), parts)
    return joined.select(
        "name", "position", "dtype", "not_nulls", "nulls", "distinct_n", "min_num", "max_num",
        "mean_num", "median_num", F.when(F.col("dtype") == "text", F.col("top")).alias("min_str"),
        F.lit(None).cast("string").alias("max_str"), "top_values", "outlier_low", "outlier_high",
        F.coalesce("outliers", F.lit(0)).alias("outliers"), "role")


# ------------------------------------------------------------------------- duplicates
def duplicate_rows(raw: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier row in full, by a 256-bit digest of the row."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(raw.columns)]
    digest = F.unhex(F.sha2(F.to_json(F.array(*texts)), 256))
    copies = raw.groupBy(digest.alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def duplicate_sessions(clean: DataFrame) -> DataFrame:
    """Session ids that occur more than once."""
    return (clean.groupBy("session_id").agg(F.count(F.lit(1)).alias("copies"))
            .filter(F.col("copies") > 1))


# ------------------------------------------------------------------------------- rules
def common_rating(clean: DataFrame) -> DataFrame:
    """Most common rating of sessions without a purchase, with its count."""
    return (clean.filter(F.col("purchased") == 0).groupBy("rating")
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "rating").limit(1))


def rule_counts(clean: DataFrame) -> DataFrame:
    """Offending rows per rule."""
    return _rule_pass(clean).filter(~F.contains("rule", F.lit(":")))


def _rule_pass(clean: DataFrame) -> DataFrame:
    """Offending rows per rule, and the ends of each code's range as rules low:code and high:code:
    one pass for row rules, ratings and ranges, one for repeated ids.

    The first pass is grouped by rating and outcome (a handful of rows), so that the most
    common rating without a purchase falls out of it too.
    """
    c = F.col
    sold, unsold, carted = c("purchased") == 1, c("purchased") == 0, c("added_to_cart") == 1
    tests = {
        "zero_revenue_purchase": sold & (c("revenue_cents") == 0),
        "revenue_without_purchase": unsold & (c("revenue_cents") > 0),
        "discount_mismatch": F.expr(
            "coalesce(abs(discount_cents - try_add(try_multiply(gross_cents, CAST(discount_percent AS BIGINT)), 50L) div 100) > 2, true)"),
        "purchase_without_cart": sold & (c("added_to_cart") == 0),
        "cart_not_ended_once": carted & (c("purchased") + c("cart_abandoned") != 1),
        "price_not_positive": c("unit_cents") <= 0,
    }
    counted = clean.groupBy("rating", unsold.alias("unsold")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(t).alias(name) for name, t in tests.items()],
        *[f(code).cast("bigint").alias(f"{end}:{code}") for code in CODES for end, f in ENDS.items()])
    zero = lambda x: F.coalesce(x, F.lit(0))
    one = counted.agg(
        *[zero(F.sum(n)).alias(n) for n in ["rows", *tests]],
        *[f(f"`{end}:{code}`").alias(f"{end}:{code}") for code in CODES for end, f in ENDS.items()],
        F.max_by(F.struct("rows", "rating"), F.when(c("unsold"), F.struct(c("rows"), -c("rating"))))
        .alias("usual"))
    none = F.lit(None).cast("int")
    ranges = [f"{end}:{code}" for code in CODES for end in ENDS]
    rows = one.select(F.stack(
        F.lit(len(tests) + len(ranges) + 2), *[p for n in ["rows", *tests, *ranges] for p in (F.lit(n), c(f"`{n}`"), none)],
        F.lit("placeholder_rating"), c("usual.rows"), c("usual.rating")).alias("rule", "n", "value"))
    repeated = duplicate_sessions(clean).agg(
        F.lit("duplicate_session_id").alias("rule"), zero(F.sum(c("copies") - 1)).alias("n"),
        none.alias("value"))
    return rows.filter(c("n").isNotNull()).unionByName(repeated)


# rule -> (column, title and detail when broken, severity, title and detail when it holds);
# {n} is the count, {value} the rating. None: no finding in that case.
RULES = {
    "zero_revenue_purchase": ("revenue", "{n} purchases carry no revenue",
                              "They count as purchases, so they lower the average order value.",
                              None, None, None),
    "revenue_without_purchase": ("revenue", "{n} sessions without a purchase carry revenue",
                                 "Revenue belongs to completed purchases only.",
                                 "info", "No revenue outside purchases",
                                 "Revenue averages are taken over purchases, not over sessions."),
    "placeholder_rating": ("rating", "{n} sessions without a purchase are rated {value}",
                           "The rating is a placeholder there; rating metrics use purchases only.",
                           None, None, None),
    "discount_mismatch": ("discount_amount", "{n} discounts differ from price, quantity and percent",
                          "The two discount fields are more than two cents apart.",
                          "ok", "Discounts agree with price, quantity and percent",
                          "Checked for every row within two cents."),
    "purchase_without_cart": ("purchased", "{n} purchases skipped the cart",
                              "A session can reach the purchase without the cart stage.", None, None, None),
    "cart_not_ended_once": ("cart_abandoned", "{n} carts were not ended exactly once",
                            "A cart should be either purchased or abandoned.",
                            "ok", "Every cart was purchased or abandoned",
                            "The funnel adds up."),
    "duplicate_session_id": ("session_id", "{n} repeated session ids",
                             "Only one row per session id enters the store.",
                             "ok", "Session ids are unique", "One row is one session."),
    "price_not_positive": ("unit_price", "{n} prices are zero or less",
                           "Averages per order include such lines.", None, None, None),
}
# The codes of the fact table whose names the source does not tell.
CODES = [c if c != "review_text" else "review_code" for c in CODE_LABELS]
ENDS = {"low": F.min, "high": F.max}
PLACEHOLDER_SHARE = 0.2


def findings(clean: DataFrame) -> DataFrame:
    """Severity, column, title, detail and count of everything worth saying. The last one is always
    there: codes have numbers but no names."""
    passed = _rule_pass(clean).checkpoint()  # a few dozen rows
    ends = F.split("rule", ":")
    ranges = passed.filter(F.contains("rule", F.lit(":"))).groupBy(ends[1].alias("code")).agg(
        F.max(F.when(ends[0] == "low", F.col("n"))).alias("low"), F.max(F.when(ends[0] == "high", F.col("n"))).alias("high"))
    listed = F.array_join(F.sort_array(F.collect_list(F.concat_ws(
        " ", "code", F.concat(F.col("low").cast("string"), F.lit("-"), F.col("high").cast("string"))))), ", ")
    opaque = ranges.agg(listed.alias("ranges")).select(
        F.lit(len(RULES) + 1).alias("ord"), F.lit("info").alias("severity"), F.lit("codes").alias("column"),
        F.lit("Codes have no names").alias("title"), F.concat(F.lit("Only their ranges are known: "), "ranges").alias("detail"),
        F.lit(len(CODES)).cast("bigint").alias("n"))
    return findings_from(passed.filter(~F.contains("rule", F.lit(":")))).unionByName(opaque).orderBy("ord")


def findings_from(counts: DataFrame) -> DataFrame:
    total = counts.filter(F.col("rule") == "rows").agg(F.max("n")).scalar()
    c = F.col
    broken = F.when(c("rule") == "placeholder_rating",
                    c("n") > total * F.lit(PLACEHOLDER_SHARE)).otherwise(c("n") > 0)
    texts = counts.sparkSession.createDataFrame(
        [(i, rule, *texts) for i, (rule, texts) in enumerate(RULES.items(), 1)],
        "ord int, rule string, column string, bad_title string, bad_detail string, "
        "good_severity string, good_title string, good_detail string")
    pick = lambda bad, good: F.when(broken, bad).otherwise(good)
    titled = F.replace(F.replace(c("bad_title"), F.lit("{n}"), F.format_number("n", 0)),
                       F.lit("{value}"), F.coalesce(c("value").cast("string"), F.lit("")))
    # RULES is a fixed list of eight.
    rows = (counts.join(F.broadcast(texts), "rule")
            .filter(broken | c("good_severity").isNotNull())
            .select("ord", pick(F.lit("warning"), c("good_severity")).alias("severity"), "column",
                    pick(titled, c("good_title")).alias("title"),
                    pick(c("bad_detail"), c("good_detail")).alias("detail"), "n"))
    return rows.orderBy("ord")


# ------------------------------------------------------------------------------- facts
def dataset_facts(clean: DataFrame) -> DataFrame:
    """Size, distinct customers and products, and date range, as (key, value) text rows."""
    from .aggregate import base_aggregates
    one = base_aggregates(clean, {}, {"sessions", "customers", "products", "first_day", "last_day"})
    facts = {"rows": "b_sessions", "unique_customers": "b_customers",
             "unique_products": "b_products", "date_min": "b_first_day", "date_max": "b_last_day"}
    return _key_values(one, {k: F.col(v) for k, v in facts.items()})


def _key_values(one: DataFrame, facts: dict[str, Column]) -> DataFrame:
    parts = [p for k, v in facts.items() for p in (F.lit(k), v.cast("string"))]
    return one.select(F.stack(F.lit(len(facts)), *parts).alias("key", "value"))


def metadata(raw: DataFrame, parsed: DataFrame, clean: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """The metadata table of a load: facts of the rows kept, rejected and repeated rows, code
    tables, findings. ``kept`` is what was stored of the clean rows; without it, one row per id is."""
    spark = raw.sparkSession
    lost = duplicate_sessions(clean).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n"))
    again = _key_values(lost, {"repeated_rows": F.col("n")})
    built = [] if kept is None else [_key_values(spark.range(1), {"built_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")})]
    stored = clean.dropDuplicates(["session_id"]) if kept is None else kept
    unparsed = _key_values(parsed.agg(F.count_if(F.col("reason").isNotNull()).alias("n")),
                           {"unparsed_rows": F.col("n")})
    repeated = _key_values(duplicate_rows(raw), {"duplicate_rows": F.col("duplicate_rows")})
    as_json = lambda d: F.to_json(F.create_map(*[F.lit(str(x)) for kv in d.items() for x in kv]))
    fixed = _key_values(spark.range(1), {
        "csv_columns": F.lit(len(raw.columns)),
        "weekday_mapping": as_json(dict(enumerate(WEEKDAY_NAMES))),
        "season_mapping": as_json(SEASON_NAMES)})
    # At most one finding per rule: the list holds nine entries.
    said = findings(clean).agg(F.to_json(F.transform(
        F.sort_array(F.collect_list(F.struct("ord", "severity", "column", "title", "detail"))),
        lambda f: f.dropFields("ord"))).alias("findings"))
    return reduce(DataFrame.unionByName, [dataset_facts(stored), unparsed, again, repeated, fixed, *built,
                                          _key_values(said, {"findings": F.col("findings")})])


def sku_stability(df: DataFrame) -> DataFrame:
    """Categories seen per product, as a histogram: a stable product id has one."""
    per_product = (df.select("product_id", "product_category").distinct()
                   .groupBy("product_id").agg(F.count(F.lit(1)).alias("categories")))
    return (per_product.groupBy("categories").agg(F.count(F.lit(1)).alias("products"))
            .orderBy("categories"))


def split_products(df: DataFrame) -> DataFrame:
    """Number of products, and of those seen in several categories (one row)."""
    seen = df.filter(F.col("product_id").isNotNull()).groupBy("product_id").agg(
        F.min("product_category").alias("low"), F.max("product_category").alias("high"))
    return seen.agg(F.count(F.lit(1)).alias("products"), F.count_if(F.col("low") < F.col("high")).alias("split"))


def code_crosstab(raw: DataFrame, parsed_date: Column | None = None) -> DataFrame:
    """Do the shipped weekday and season codes agree with the date? Counts per pair."""
    day = F.try_to_date(F.trim("visit_date"), "d-M-yyyy") if parsed_date is None else parsed_date
    season = case([(F.month(day) == month, code) for month, code in SEASON_OF_MONTH.items()])
    pairs = raw.filter(day.isNotNull()).select(F.stack(
        F.lit(2), F.lit("weekday"), F.col("visit_weekday").try_cast("int"), F.weekday(day),
        F.lit("season"), F.col("visit_season").try_cast("int"), season,
    ).alias("code", "shipped", "derived"))
    return (pairs.groupBy("code", "shipped", "derived").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("agrees", F.col("shipped").eqNullSafe(F.col("derived"))))
