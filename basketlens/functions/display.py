"""Display text as column expressions: grouped digits, rupees, percentages, durations.

Decimals are rounded from the exact binary value with ties to even, so 2.675 shows as 2.67
and 0.125 as 0.12. Null shows as "n/a".
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numbers import case

NOT_AVAILABLE = "n/a"
# Digit grouping: thousands then pairs (12,34,567), or thousands throughout (1,234,567); only
# before the decimal point.
WHOLE_PART = r"(?<=\d)(?<!\.\d{0,9})"
GROUPING = {"indian": WHOLE_PART + r"(?=(\d\d)*\d{3}(\.|$))",
            "west": WHOLE_PART + r"(?=(\d{3})+(\.|$))"}
# The display kind of each formatter.
KINDS = ["inr", "inr_m", "rupee", "count", "pct", "pct2", "num1", "num2", "sec", "num"]
SPLITTER = 134217729.0  # 2**27 + 1 halves a double's 53 bits


def _shifted(x: Column, digits: int) -> Column:
    """|x| * 10**digits as a whole number, rounded from the exact product.

    The rounded product alone can land on .5 by accident; the error of the multiplication
    (exact, since the factor is short) tells on which side the true value lies.
    """
    factor = F.lit(10.0 ** digits)
    a = F.abs(x.cast("double"))
    product = a * factor
    wide = a * F.lit(SPLITTER)
    high = wide - (wide - a)
    error = (high * factor - product) + (a - high) * factor
    nearest = F.rint(product)
    off = product - nearest
    fixed = nearest + F.when(off * F.signum(error) == 0.5, off + off).otherwise(0.0)
    return fixed.try_cast("bigint")


def plain(x: Column, digits: int = 0, grouping: str | None = None) -> Column:
    """Unsigned decimal text of |x|. What is too large to shift is a whole number already."""
    shifted = _shifted(x, digits)
    whole = F.abs(x.cast("double")).try_cast("decimal(38,0)").cast("string")
    large = F.coalesce(F.concat(whole, F.lit("0" * digits)), F.concat(x.cast("string"), F.lit("0" * digits)))
    text = F.when(shifted.isNull(), large).otherwise(F.format_string(f"%0{digits + 1}d", shifted))
    if digits:
        text = F.regexp_replace(text, rf"(\d{{{digits}}})$", ".$1")
    return F.regexp_replace(text, GROUPING[grouping], ",") if grouping else text


def _minus(x: Column) -> Column:
    return F.when(x < 0, "-").otherwise("")


def _shown(x: Column, text: Column) -> Column:
    value = x.cast("double")
    return F.when(x.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), NOT_AVAILABLE).otherwise(text)


def number(x: Column, digits: int = 0, style: str = "indian") -> Column:
    return _shown(x, F.concat(_minus(x), plain(x, digits, style)))


def inr(x: Column, digits: int = 0) -> Column:
    return _shown(x, F.concat(F.lit("₹"), number(x, digits)))


def inr_m(x: Column) -> Column:
    """Rupees in millions: ₹10.12M."""
    return _shown(x, F.concat(F.lit("₹"), _minus(x), plain(x / F.lit(1e6), 2), F.lit("M")))


def inr_short(x: Column) -> Column:
    """Rupees as millions, whole thousands or with paise, by size."""
    size = F.abs(x)
    body = (F.when(size >= 1e6, F.concat(plain(x / F.lit(1e6), 2), F.lit("M")))
            .when(size >= 1000, plain(x, 0, "indian")).otherwise(plain(x, 2, "west")))
    return _shown(x, F.concat(_minus(x), F.lit("₹"), body))


def compact(x: Column, digits: int = 1) -> Column:
    """Crore, lakh or thousand."""
    size = F.abs(x)
    scaled = lambda unit, tag: F.concat(plain(x / F.lit(unit), digits), F.lit(tag))
    body = (F.when(size >= 1e7, scaled(1e7, "Cr")).when(size >= 1e5, scaled(1e5, "L"))
            .when(size >= 1000, scaled(1000.0, "k")).otherwise(plain(x, 0)))
    return _shown(x, F.concat(_minus(x), body))


def pct(x: Column, digits: int = 1, signed: bool = False) -> Column:
    if signed:
        lead = F.when(x > 0, "▲ ").when(x < 0, "▼ ").otherwise("")
    else:
        lead = _minus(x)
    return _shown(x, F.concat(lead, plain(x, digits), F.lit("%")))


def date_label(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "d MMM yyyy"), F.lit(NOT_AVAILABLE))


def mmss(seconds: Column) -> Column:
    """Minutes and seconds, fractions cut off: 3m 07s."""
    whole = seconds.try_cast("bigint")
    return F.when(whole.isNull(), NOT_AVAILABLE).otherwise(
        F.format_string("%dm %02ds", F.floor(whole / 60), F.pmod(whole, F.lit(60))))


def rounded(x: Column, digits: int = 2) -> Column:
    """Rounding that leaves null alone."""
    return F.round(x.cast("double"), digits)


def fmt(x: Column, kind: str) -> Column:
    """Display text for a value of a known kind."""
    if kind == "inr":
        return inr_short(x)
    if kind == "inr_m":
        return inr_m(x)
    if kind == "rupee":
        return inr(x)
    if kind == "count":
        return number(x)
    if kind in ("pct", "pct2"):
        return pct(x, 2 if kind == "pct2" else 1)
    if kind in ("num1", "num2"):
        return number(x, int(kind[-1]), "west")
    if kind == "sec":
        return mmss(x)
    return F.coalesce(x.cast("string"), F.lit(NOT_AVAILABLE))


def fmt_by(kind: Column, x: Column) -> Column:
    """Display text where the kind is itself a column."""
    return case([(kind == name, fmt(x, name)) for name in KINDS[:-1]], fmt(x, "num"))
