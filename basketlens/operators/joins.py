"""Joins of the session table to customer-level rows, with busy customers spread out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import shuffle_width
from ..sources.cleaning import DERIVED

# A key with more rows than this is spread over several tasks.
HOT_ROWS = 1_000_000
# ... unless the data is so large that this many keys would qualify.
MAX_HOT_KEYS = 200_000


def hot_keys(counts: DataFrame, key: str, rows: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys above the threshold and the number of pieces each is cut into.

    ``counts`` has one row per key. The threshold is at least total / MAX_HOT_KEYS, so
    fewer than MAX_HOT_KEYS keys can exceed it: the result is small by arithmetic.
    """
    total = counts.agg(F.sum(rows)).scalar()
    limit = F.greatest(F.lit(hot_rows), F.ceil(total / F.lit(MAX_HOT_KEYS)))
    return (counts.filter(F.col(rows) > limit)
            .select(key, F.ceil(F.col(rows) / limit).cast("int").alias("_pieces")))


def spread_join(facts: DataFrame, lookup: DataFrame, key: str, how: str, hot: DataFrame,
                spread_by: str = "session_id") -> DataFrame:
    """Join many fact rows per key to one lookup row per key.

    Facts of a hot key are dealt over its pieces by a hash of ``spread_by`` (stable under
    recomputation), and the lookup row is copied once per piece. Facts without a key match
    nothing, so they are dealt over as many pieces as there are partitions.
    """
    small = F.broadcast(hot)  # fewer than MAX_HOT_KEYS rows of 12 bytes
    pieces = F.coalesce("_pieces", F.lit(1))
    own = F.when(F.col(key).isNull(), shuffle_width(facts.sparkSession)).otherwise(pieces)
    dealt = (facts.join(small, key, "left")
             .withColumn("_piece", F.pmod(F.xxhash64(spread_by), own).cast("int")).drop("_pieces"))
    copied = (lookup.join(small, key, "left")
              .withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
              .drop("_pieces"))
    return dealt.join(copied, [key, "_piece"], how).drop("_piece")


def pinned(df: DataFrame) -> DataFrame:
    """Evaluate a frame that holds a join once, for all passes over it. Text that follows from
    other columns is left out of the checkpoint and derived again."""
    types = dict(df.dtypes)
    again = [c for c in df.columns if c in DERIVED and types[c] == "string"]
    core = df.drop(*again).checkpoint()
    return core.selectExpr(*[f"{DERIVED[c]} AS {c}" if c in again else f"`{c}`" for c in df.columns])
