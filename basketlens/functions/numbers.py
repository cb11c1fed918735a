"""Small null-safe column helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# A plain decimal literal; keeps Java-only spellings such as "12d" or "NaN" out.
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def case(branches, otherwise=None) -> Column:
    """One flat CASE over (test, value) pairs; nested ones make the analyzer slow."""
    (test, value), *rest = branches
    out = F.when(test, value)
    for test, value in rest:
        out = out.when(test, value)
    return out if otherwise is None else out.otherwise(otherwise)


def div0(top: Column, bottom: Column) -> Column:
    """Ratio in double arithmetic; null where the denominator is zero."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def money(cents: Column) -> Column:
    return cents.cast("double") / F.lit(100.0)


def percent(top: Column, bottom: Column) -> Column:
    return div0(F.lit(100.0) * top, bottom)


def to_double(text: Column) -> Column:
    """Finite number or null; text that is no number gives null, never an error."""
    value = F.when(text.rlike(NUMERIC_TEXT), text.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def to_long(text: Column) -> Column:
    """Whole number, fractions cut off; null where unreadable or out of range."""
    return F.coalesce(text.try_cast("bigint"), to_double(text).try_cast("bigint"))


def to_int(text: Column) -> Column:
    return to_long(text).try_cast("int")


def to_cents(text: Column) -> Column:
    """Money text to whole cents; null where unreadable or out of range."""
    exact = F.when(text.rlike(NUMERIC_TEXT), F.trim(text).try_cast("decimal(38,2)"))
    return F.try_multiply(exact, F.lit(100)).try_cast("bigint")


def out_of_range(text: Column, typed: Column) -> Column:
    """Is the text a number that its type cannot hold?"""
    return typed.isNull() & text.rlike(NUMERIC_TEXT)


def _holds_doubles(kind: T.DataType) -> bool:
    inner = {T.StructType: lambda: [f.dataType for f in kind.fields], T.ArrayType: lambda: [kind.elementType], T.MapType: lambda: [kind.valueType]}
    return isinstance(kind, (T.DoubleType, T.FloatType)) or any(map(_holds_doubles, inner.get(type(kind), list)()))


def _json_value(col: Column, kind: T.DataType) -> Column:
    if not _holds_doubles(kind):
        return col
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[_json_value(col.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _json_value(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(col, lambda _, x: _json_value(x, kind.valueType))
    return F.when(~F.isnan(col) & (F.abs(col) != F.lit(float("inf"))), col)


def json_safe(df):
    """NaN and infinities become null in every floating value, inside structs, arrays and maps too."""
    return df.select(*[_json_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
