"""The stored fact table, its profile and its metadata."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import SESSION_SCHEMA
from ..session import shuffle_width


def write_sessions(clean: DataFrame, folder: str) -> None:
    """Parquet by year and month, customers clustered inside.

    The range split ends on session_id, so neither a busy month nor a customer who owns
    a third of the rows ends up in one task, and each task writes few folders.
    """
    width = shuffle_width(clean.sparkSession)
    order = ["visit_year", "visit_month", "customer_id", "session_id"]
    (clean.repartitionByRange(width, *order).sortWithinPartitions(*order)
     .write.mode("overwrite").partitionBy("visit_year", "visit_month")
     .parquet(f"{folder}/sessions"))


def write_table(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")


def new_version(folder: str) -> str:
    """Folder of a load that nobody sees until it is published."""
    return f"{folder}/load-{uuid.uuid4().hex}"


def publish(spark: SparkSession, folder: str, version: str) -> None:
    """Make a finished load the current one: one small file, committed last, names it."""
    name = version.removeprefix(f"{folder}/")
    (spark.range(1).select(F.lit(name).alias("load"), F.current_timestamp().alias("published"))
     .coalesce(1).write.mode("append").parquet(f"{folder}/current"))


def _or_none(read):
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current(spark: SparkSession, folder: str) -> str:
    """Folder of the load published last; the folder itself where loads are not versioned."""
    pointers = _or_none(lambda: spark.read.schema("load string, published timestamp").parquet(f"{folder}/current"))
    name = None if pointers is None else pointers.agg(F.max_by("load", F.struct("published", "load"))).first()[0]
    return folder if name is None else f"{folder}/{name}"


def stored_sessions(spark: SparkSession, folder: str) -> DataFrame | None:
    """The stored fact table, or None where the folder holds none."""
    here = current(spark, folder)
    return _or_none(lambda: spark.read.schema(SESSION_SCHEMA).parquet(f"{here}/sessions"))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{current(spark, folder)}/{name}")


def status(sessions: DataFrame) -> DataFrame:
    """Is the table usable: row count, column count, readiness."""
    return sessions.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(sessions.columns)).cast("bigint").alias("columns"),
        (F.col("rows") > 0).alias("ready"))
