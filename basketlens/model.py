"""The data model: raw header, clean fact table, and the fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

# Source header, in file order.
SOURCE_COLUMNS = [
    "customer_id", "session_id", "visit_date", "device_type", "user_type", "marketing_channel",
    "product_id", "product_category", "unit_price", "quantity", "discount_percent",
    "discount_amount", "revenue", "pages_viewed", "time_on_site_sec", "added_to_cart",
    "purchased", "cart_abandoned", "rating", "review_text", "review_helpful_votes",
    "payment_method", "visit_day", "visit_month", "visit_weekday", "visit_season",
    "session_duration_bucket", "revenue_normalized", "location",
]

# Label prefix of each opaque integer code.
CODE_LABELS = {
    "product_category": "Category",
    "payment_method": "Payment",
    "device_type": "Device",
    "user_type": "User type",
    "marketing_channel": "Channel",
    "location": "Location",
    "review_text": "Review code",
}

# Columns the header must have before a load may start.
REQUIRED_COLUMNS = sorted([*CODE_LABELS, "visit_date", "revenue", "purchased"])

# Season codes.
SEASON_NAMES = {
    1: "Spring (Mar-May)",
    2: "Summer (Jun-Aug)",
    0: "Autumn (Sep-Nov)",
    3: "Winter (Dec-Feb)",
}
# Season code of each month, and names of the days, Monday first.
SEASON_OF_MONTH = {1: 3, 2: 3, 3: 1, 4: 1, 5: 1, 6: 2, 7: 2, 8: 2, 9: 0, 10: 0, 11: 0, 12: 3}
WEEKDAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

# Session-length buckets in reading order.
DURATION_ORDER = ["Very Short", "Short", "Long", "Very Long"]

# What the columns hold.
FLOAT_COLUMNS = ["unit_price", "discount_amount", "revenue", "revenue_normalized"]
TEXT_COLUMNS = ["visit_date", "session_duration_bucket"]
INT_COLUMNS = [c for c in SOURCE_COLUMNS if c not in FLOAT_COLUMNS and c not in TEXT_COLUMNS]
NUMERIC_COLUMNS = [c for c in SOURCE_COLUMNS if c not in TEXT_COLUMNS]
MEASURES = ["unit_price", "revenue", "discount_amount", "time_on_site_sec", "revenue_normalized"]
FLAGS = ["added_to_cart", "purchased", "cart_abandoned"]

# Codes and ids a clean row cannot do without; rows lacking one are rejected.
NOT_NULL_CODES = ["customer_id", "product_id", "product_category", "payment_method",
                  "device_type", "user_type", "marketing_channel", "location"]


# Fixed values: (type, role) of each column in the profile, where they are not those of a plain code.
COLUMN_FACTS = {
    **{c: ("integer", "code") for c in INT_COLUMNS},
    **{c: ("integer", "encoded category (integer code)") for c in CODE_LABELS},
    **{c: ("integer", "binary flag") for c in FLAGS},
    **{c: ("float" if c in FLOAT_COLUMNS else "integer", "measure") for c in MEASURES},
    "visit_date": ("date (text DD-MM-YYYY)", "temporal"),
    "session_duration_bucket": ("text", "category"),
}


def column_type(name: str) -> str:
    return COLUMN_FACTS.get(name, ("text", "category"))[0]


def column_role(name: str) -> str:
    return COLUMN_FACTS.get(name, ("text", "category"))[1]


# Money is held in whole cents so that sums are exact in any shuffle order.
SESSION_SCHEMA = T.StructType([
    T.StructField(name, kind) for name, kind in [
        ("session_id", T.LongType()), ("customer_id", T.LongType()), ("visit_date", T.DateType()),
        ("visit_year", T.IntegerType()), ("visit_month", T.IntegerType()),
        ("month_name", T.StringType()), ("visit_day", T.IntegerType()),
        ("weekday", T.IntegerType()), ("weekday_name", T.StringType()),
        ("season", T.IntegerType()), ("season_name", T.StringType()),
        ("device_type", T.IntegerType()), ("device_label", T.StringType()),
        ("user_type", T.IntegerType()), ("user_type_label", T.StringType()),
        ("marketing_channel", T.IntegerType()), ("channel_label", T.StringType()),
        ("product_id", T.LongType()), ("product_category", T.IntegerType()),
        ("category_label", T.StringType()), ("unit_cents", T.LongType()),
        ("quantity", T.LongType()), ("gross_cents", T.LongType()),
        ("discount_percent", T.IntegerType()), ("discount_cents", T.LongType()),
        ("revenue_cents", T.LongType()), ("pages_viewed", T.IntegerType()),
        ("time_on_site_sec", T.IntegerType()), ("duration_bucket", T.StringType()),
        ("added_to_cart", T.IntegerType()), ("purchased", T.IntegerType()),
        ("cart_abandoned", T.IntegerType()), ("rating", T.IntegerType()),
        ("review_code", T.IntegerType()), ("review_helpful_votes", T.IntegerType()),
        ("payment_method", T.IntegerType()), ("payment_label", T.StringType()),
        ("location", T.IntegerType()), ("location_label", T.StringType()),
        ("revenue_normalized", T.DoubleType()),
    ]
])
