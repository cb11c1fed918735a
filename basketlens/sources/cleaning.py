"""Row cleaning: raw text rows to the typed fact table, and the rows that cannot enter it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import out_of_range, to_cents, to_double, to_int, to_long
from ..model import CODE_LABELS, NOT_NULL_CODES, SEASON_NAMES, SESSION_SCHEMA, WEEKDAY_NAMES
from .raw_csv import BROKEN

# Derived columns as SQL text: date parts and labels that follow from the typed core columns.
SEASON_LABEL = " ".join(f"WHEN {code} THEN '{name}'" for code, name in SEASON_NAMES.items())
WEEKDAYS = ", ".join(f"'{n}'" for n in WEEKDAY_NAMES)
DERIVED = {
    "visit_year": "year(visit_date)", "visit_month": "month(visit_date)",
    "visit_day": "day(visit_date)", "month_name": "date_format(visit_date, 'MMM')",
    "weekday": "weekday(visit_date)", "weekday_name": f"array({WEEKDAYS})[weekday(visit_date)]",
    "season_name": f"CASE season {SEASON_LABEL} ELSE 'Season NA' END",
    **{label: f"concat('{CODE_LABELS[code]} ', {code})" for label, code in [
        ("device_label", "device_type"), ("user_type_label", "user_type"),
        ("channel_label", "marketing_channel"), ("category_label", "product_category"),
        ("payment_label", "payment_method"), ("location_label", "location")]},
}


def complete(core: DataFrame) -> DataFrame:
    """Add the derived columns and put everything into the fact table's shape."""
    names = [n for n in SESSION_SCHEMA.names if n in DERIVED or n in core.columns]
    return core.selectExpr(*[f"{DERIVED[n]} AS {n}" if n in DERIVED else n for n in names])


ROW = "row_no"  # tells equal raw rows apart once it has been stored


def parse(raw: DataFrame) -> DataFrame:
    """Typed core columns of every raw row, plus the raw date and a reject reason.

    A number that its type cannot hold is a reason, not a zero; text that is no number reads as
    null or zero, as the columns define. Where the rows are numbered (column ROW), the number and
    the row's text are carried along, and rows without an id get ids that differ.
    """
    col = F.col
    source = [c for c in raw.columns if c not in (ROW, BROKEN)]
    # A missing id takes the row's own hash: a distributed scan has no row number.
    row_hash = F.xxhash64(*[col(c) for c in raw.columns if c != BROKEN])
    cents = {c: to_cents(col(c)) for c in ("unit_price", "discount_amount", "revenue")}
    longs = {c: to_long(col(c)) for c in ("session_id", "customer_id", "product_id", "quantity")}
    ints = {c: to_int(col(c)) for c in (
        "product_category", "payment_method", "device_type", "user_type", "marketing_channel", "location",
        "visit_season", "review_text", "discount_percent", "pages_viewed", "time_on_site_sec", "added_to_cart",
        "purchased", "cart_abandoned", "rating", "review_helpful_votes")}
    doubles = {"revenue_normalized": to_double(col("revenue_normalized"))}
    numbers = cents | longs | ints | doubles
    zero = lambda c, name=None: F.coalesce(numbers[c], F.lit(0)).alias(name or c)
    typed = [
        F.when(F.trim(F.coalesce(col("session_id"), F.lit(""))) == "", row_hash)
        .otherwise(numbers["session_id"]).alias("session_id"),
        *[numbers[c].alias(c) for c in NOT_NULL_CODES],
        F.try_to_date(F.trim("visit_date"), "d-M-yyyy").alias("visit_date"),
        zero("unit_price", "unit_cents"), zero("quantity"), zero("discount_amount", "discount_cents"),
        zero("revenue", "revenue_cents"), zero("visit_season", "season"), zero("review_text", "review_code"),
        *[zero(c) for c in (
            "discount_percent", "pages_viewed", "time_on_site_sec", "added_to_cart", "purchased",
            "cart_abandoned", "rating", "review_helpful_votes")],
        F.coalesce(F.nullif(F.trim("session_duration_bucket"), F.lit("")), F.lit("Unknown"))
        .alias("duration_bucket"),
        F.coalesce(numbers["revenue_normalized"], F.lit(0.0)).alias("revenue_normalized"),
        col("visit_date").alias("raw_date"),
        F.coalesce(*[F.when(out_of_range(col(c), t), F.lit(c)) for c, t in numbers.items()]).alias("_odd"),
        (col(BROKEN) if BROKEN in raw.columns else F.lit(None).cast("string")).alias("_broken_text"),
        *([col(ROW), F.struct(*source).alias("_row")] if ROW in raw.columns else []),
    ]
    # Parsed inside a generator: filters on the results are not pushed below it, so the text
    # is parsed once and the optimizer does not multiply the parse through every filter.
    core = raw.select(F.inline(F.array(F.struct(*typed))))
    missing = " ".join(f"WHEN {c} IS NULL THEN 'missing {c}'" for c in ("session_id", *NOT_NULL_CODES))
    judged = core.withColumn("gross_cents", F.try_multiply("unit_cents", "quantity")).withColumn("reason", F.expr(f"""
        CASE WHEN _broken_text IS NOT NULL THEN 'malformed row'
             WHEN visit_date IS NULL THEN 'unparseable visit_date'
             WHEN _odd IS NOT NULL THEN concat('out of range ', _odd) {missing}
             WHEN gross_cents IS NULL THEN 'out of range gross_value' END"""))
    if ROW in raw.columns:  # the text of rows that will be rejected
        judged = judged.withColumn("raw", F.when(F.col("reason").isNotNull(), F.coalesce("_broken_text", F.to_json("_row")))).drop("_row")
    return judged.drop("_odd", "_broken_text")


def accepted(parsed: DataFrame) -> DataFrame:
    return complete(parsed.filter(F.col("reason").isNull()))


def rejected(parsed: DataFrame) -> DataFrame:
    return (parsed.filter(F.col("reason").isNotNull())
            .select("session_id", F.col("raw_date").alias("visit_date"), "reason", *[c for c in ("raw",) if c in parsed.columns]))


def repeated_ids(parsed: DataFrame) -> DataFrame:
    """Session ids of several accepted rows, and the number of the row that is kept: the first."""
    return (parsed.filter(F.col("reason").isNull()).groupBy("session_id")
            .agg(F.count(F.lit(1)).alias("_copies"), F.min(ROW).alias("_kept")).filter("_copies > 1").drop("_copies"))


def quarantined(parsed: DataFrame) -> DataFrame:
    """Numbered parsed rows with a reason for all but one row of each session id. Only the ids that
    repeat are looked up, so the clean majority of rows is not grouped at full width."""
    marked = parsed.join(repeated_ids(parsed), "session_id", "left")
    extra = F.col("reason").isNull() & F.col("_kept").isNotNull() & (F.col(ROW) != F.col("_kept"))
    core = F.to_json(F.struct(*[c for c in parsed.columns if c not in (ROW, "raw", "reason")]))
    return (marked.withColumn("raw", F.when(extra, core).otherwise(F.col("raw")))
            .withColumn("reason", F.when(extra, "repeated session_id").otherwise(F.col("reason"))).drop("_kept"))


def one_row_per_session(clean: DataFrame) -> DataFrame:
    """Keep one row per session id, the smallest: for clean rows that come without numbers."""
    rest = [c for c in clean.columns if c != "session_id"]
    kept = clean.groupBy("session_id").agg(F.min(F.struct(*rest)).alias("row"))
    return kept.select("session_id", "row.*").select(*clean.columns)
