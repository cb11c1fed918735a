"""Summary, JSON export and the offline build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.metrics import TOTALS
from ..functions.numbers import json_safe
from ..model import SESSION_SCHEMA
from ..operators import customers as C
from ..operators.aggregate import totals
from ..operators.quality import metadata, profile
from ..operators.slicers import apply_slicers, resolve
from ..session import prepare
from ..sources import cleaning, raw_csv, store


def summary(df: DataFrame) -> DataFrame:
    """Readiness and totals."""
    return totals(df).select((F.col("sessions") > 0).alias("ready"), *TOTALS)


def segment_table(df: DataFrame) -> DataFrame:
    return C.segments(C.segment_sums(C.with_segments(C.rollup(df))))


def export(df: DataFrame, args: dict | None = None, source: dict | None = None) -> DataFrame:
    """One JSON document: source, filters in effect, totals and segments."""
    args = args or {}
    sliced = apply_slicers(df, args)
    filters = {a.slicer.key: a.raw for a in resolve(df, args)}
    text_map = lambda d: F.create_map(*[F.lit(str(x)) for kv in d.items() for x in kv]) if d else \
        F.create_map().cast("map<string,string>")
    segments = json_safe(segment_table(sliced))
    # At most four segments.
    listed = segments.agg(F.sort_array(F.collect_list(F.struct(
        "seg_ord", *[c for c in segments.columns if c != "seg_ord"])))).scalar()
    return json_safe(totals(sliced)).select(F.to_json(F.struct(
        text_map(source or {}).alias("source"), text_map(filters).alias("filters"),
        F.struct(*TOTALS).alias("totals"), listed.alias("segments"))).alias("value"))


def build_store(spark: SparkSession, csv_path: str | list[str], folder: str, multi_line: bool = True) -> None:
    """CSV to store: clean and write the fact table, then profile and metadata, then publish."""
    prepare(spark)
    files = raw_csv.fingerprint(spark, csv_path).checkpoint()
    write_store(raw_csv.read_raw(spark, csv_path, files, multi_line), folder, files)


def write_store(raw: DataFrame, folder: str, files: DataFrame | None = None) -> None:
    """Load raw rows as a new version. Every raw row ends in ``sessions`` or in ``rejects``.

    The text is parsed once into a staged table, whose row numbers tell equal rows apart;
    everything typed then reads only its columns. Readers see the load when all of it is written.
    """
    spark, load = raw.sparkSession, store.new_version(folder)
    texts = raw.select(*[c for c in raw.columns if c != raw_csv.BROKEN])
    store.write_table(cleaning.parse(raw.withColumn(cleaning.ROW, F.monotonically_increasing_id())), load, "parsed")
    parsed = spark.read.parquet(f"{load}/parsed")
    judged = cleaning.quarantined(parsed)
    store.write_sessions(cleaning.accepted(judged), load)
    store.write_table(cleaning.rejected(judged), load, "rejects")
    store.write_table(profile(texts), load, "dq_columns")
    if files is not None:
        store.write_table(files.select("path", "bytes", "digest"), load, "source_files")
    kept = spark.read.schema(SESSION_SCHEMA).parquet(f"{load}/sessions")
    store.write_table(metadata(texts, parsed, cleaning.accepted(parsed), kept), load, "meta")
    store.publish(spark, folder, load)


def provenance(spark: SparkSession, folder: str) -> dict[str, str]:
    """Where the current load came from: built when, rows kept and set aside, files, bytes and
    digest. Empty for a folder without a load."""
    if store.current(spark, folder) == folder:
        return {}
    meta = {r["key"]: r["value"] for r in store.read_table(spark, folder, "meta")
            .filter(F.col("key").isin("rows", "unparsed_rows", "repeated_rows", "built_at")).collect()}
    files = store.read_table(spark, folder, "source_files").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.bit_xor(F.xxhash64("digest")).alias("digest")).first()
    return meta | {k: str(v) for k, v in files.asDict().items()}
