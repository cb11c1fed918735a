"""Global order without a global task: row numbers and order statistics.

Rows are split into key ranges, numbered inside their range, and shifted by the number of
rows in the ranges before. The split is checkpointed before it is counted, so a lost
executor cannot bring back other range boundaries. Windows here only ever run over the
list of ranges (as long as the shuffle is wide) or inside one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import literal, prepare, shuffle_width

# monotonically_increasing_id keeps the partition above bit 33 and the row position below.
POSITION_BITS = 33


def split_in_order(df: DataFrame, *order: Column, pin: bool = True) -> DataFrame:
    """Range-partition and sort; tag each row with its range and its position there."""
    prepare(df.sparkSession)
    ranged = (df.repartitionByRange(shuffle_width(df.sparkSession), *order)
              .sortWithinPartitions(*order)
              .withColumn("_at", F.monotonically_increasing_id()))
    tagged = ranged.withColumns({
        "_range": F.shiftright("_at", POSITION_BITS),
        "_position": F.col("_at").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)) + 1,
    }).drop("_at")
    return tagged.checkpoint() if pin else tagged


def _starts(df: DataFrame, weight: Column, by: list[str]) -> DataFrame:
    """Total weight of each range and the weight of all ranges before it."""
    sums = df.groupBy(*by, "_range").agg(F.sum(weight).alias("_in_range"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("_before", F.coalesce(F.sum("_in_range").over(before), F.lit(0)))


def row_numbers(df: DataFrame, *order: Column, name: str = "rn") -> DataFrame:
    """Add a gapless 1-based row number over a total order."""
    split = split_in_order(df, *order)
    # One row per range: as many as the shuffle is wide.
    starts = literal(_starts(split, F.lit(1), []).select("_range", "_before"))
    return (split.join(F.broadcast(starts), "_range")
            .withColumn(name, F.col("_before") + F.col("_position"))
            .drop("_range", "_position", "_before"))


def values_at(split: DataFrame, targets: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """Values at given 1-based positions of each group's weighted, ascending order.

    ``split`` comes from ``split_in_order(df, group, value)``; ``targets`` holds (group,
    which, position) with a handful of positions per group. Only the ranges that hold a
    position are scanned further.
    """
    starts = _starts(split, F.col(weight), [group])
    hit = (starts.join(F.broadcast(targets), group)
           .filter((F.col("_before") < F.col("position"))
                   & (F.col("position") <= F.col("_before") + F.col("_in_range")))
           .select(group, "which", "position", "_range", "_before"))
    running = F.sum(weight).over(
        Window.partitionBy(group, "_range", "which").orderBy(value, "_position")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (split.join(F.broadcast(hit), [group, "_range"])
            .withColumn("_reached", running + F.col("_before"))
            .filter(F.col("_reached") >= F.col("position"))
            .groupBy(group, "which").agg(F.min(value).alias(value)))
