"""Report rows: one long shape for tiles, charts, tables, funnels and findings.

Every piece of a page becomes rows of (page, section_ord, kind, item, ord, series, key, label,
value, display). A small aggregated frame is unfolded into all the rows it feeds by one
``stack``; the pieces of a page are unioned and formatted once at the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.display import fmt_by, rounded

FIELDS = ["section_ord", "kind", "item", "ord", "series", "key", "label", "value", "how"]
# (section, kind, item, ord, series, key, label, value, display kind); ord, key, label and value
# are SQL over the frame, the rest are plain values.
Cell = tuple[int, str, str, str, str | None, str, str, str, str]
# (series name, value column, display kind)
Series = tuple[str, str, str]
NULL_TEXT = "CAST(NULL AS STRING)"


def _quote(text: str | None) -> str:
    return NULL_TEXT if text is None else "'" + text.replace("'", "\\'") + "'"


def rows(df: DataFrame, page: str, *groups: Sequence[Cell]) -> DataFrame:
    """Unfold a small frame into report rows, one per input row and cell."""
    cells = [c for g in groups for c in g]
    parts = ", ".join(
        f"{section}, {_quote(kind)}, {_quote(item)}, CAST({ord_} AS INT), {_quote(series)}, "
        f"CAST({key} AS STRING), {label}, CAST({value} AS DOUBLE), {_quote(how)}"
        for section, kind, item, ord_, series, key, label, value, how in cells)
    return df.selectExpr(f"{_quote(page)} AS page",
                         f"stack({len(cells)}, {parts}) AS ({', '.join(FIELDS)})")


def tiles(section: int, specs: Sequence[tuple[int, str, str, str]]) -> list[Cell]:
    """Headline figures of a one-row frame; specs are (ord, label, column, display kind)."""
    return [(section, "kpi", column, str(place), None, NULL_TEXT, _quote(label), column, how)
            for place, label, column, how in specs]


def chart(section: int, item: str, series: Sequence[Series], kind: str = "chart") -> list[Cell]:
    """Series over a frame with ``ord``, ``key`` and ``label``."""
    return [(section, kind, item, "ord", name, "key", "label", column, how)
            for name, column, how in series]


def finding(section: int, item: str, cells: Sequence[tuple[str, str | None, str, str]],
            kind: str = "finding") -> list[Cell]:
    """Finding of a one-row frame; cells are (measure, label SQL, value column, display kind)."""
    return [(section, kind, item, str(i), measure, NULL_TEXT, label or NULL_TEXT, column, how)
            for i, (measure, label, column, how) in enumerate(cells, 1)]


def funnel(steps: DataFrame, page: str, section: int) -> DataFrame:
    """Step counts with their share of sessions, and losses with their share of the step before."""
    keyed = steps.selectExpr("step_ord AS ord", f"{NULL_TEXT} AS key", "step AS label", "value",
                             "pct_of_sessions", "lost", "lost_pct")
    unfolded = rows(keyed, page,
                    chart(section, "funnel", [("sessions", "value", "count"), ("share", "pct_of_sessions", "pct")],
                          "funnel"),
                    chart(section, "funnel", [("lost", "lost", "count"), ("lost_share", "lost_pct", "pct")],
                          "dropoff"))
    return unfolded.filter("kind = 'funnel' OR ord > 1")


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Add the position within a small, already grouped frame."""
    return df.withColumn("ord", F.row_number().over(Window.partitionBy().orderBy(*order)))


def note(spark: SparkSession, page: str, text: str) -> DataFrame:
    """The single row of a page without data."""
    row = (page, 1, "note", "empty", 1, None, None, text, None, text)
    return spark.createDataFrame([row], "page string, section_ord int, kind string, item string, "
                                        "ord int, series string, key string, label string, "
                                        "value double, display string")


def assemble(parts: Sequence[DataFrame]) -> DataFrame:
    """Union the pieces, order them and format every value. The pieces are a few hundred
    aggregated rows, so one task does it without another shuffle."""
    page = reduce(DataFrame.unionByName, parts).coalesce(1)
    ordered = page.sortWithinPartitions("section_ord", "kind", "item", "ord", "series")
    return ordered.select("page", *FIELDS[:7], rounded(F.col("value"), 4).alias("value"),
                          _display(page.sparkSession.sparkContext).alias("display"))


_SHOWN: WeakKeyDictionary[SparkContext, Column] = WeakKeyDictionary()


def _display(context: SparkContext) -> Column:
    """The display expression, built once per context: it has a few hundred nodes."""
    if context not in _SHOWN:
        _SHOWN[context] = fmt_by(F.col("how"), F.col("value"))
    return _SHOWN[context]
