"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Make sure reliable checkpoints have a home and skewed joins are split.

    The folder comes from ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder; a cluster without it is a configuration error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="basketlens-")
        context.setCheckpointDir(shared)
    # A join whose output feeds a group-by on the same key is only split when forced.
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # Two reads of the same files must see the same blocks, however many executors there are by then.
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(context.defaultParallelism))
    return spark


def literal(df: DataFrame) -> DataFrame:
    """Run a frame now and keep its rows in the plan. Only for whole numbers and plain text,
    and only where the number of rows is bounded by design (segments, ranges of a shuffle)."""
    types = dict(df.dtypes)
    show = {"string": lambda v: "'" + v.replace("'", "\\'") + "'"}
    cell = lambda v, t: f"CAST({'NULL' if v is None else show.get(t, str)(v)} AS {t})"
    rows = [", ".join(cell(v, t) for v, t in zip(r, types.values())) for r in df.collect()]
    if not rows:
        return df.limit(0)
    values = ", ".join(f"({r})" for r in rows)
    return df.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(types)})").coalesce(1)


def shuffle_width(spark: SparkSession) -> int:
    """Number of partitions used wherever a partition count must be pinned."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
