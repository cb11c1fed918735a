"""Raw CSV input: every column read as text, by each file's own header, bytes fingerprinted."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import REQUIRED_COLUMNS, SOURCE_COLUMNS
from . import blocks

BROKEN = "_broken"  # text of a row whose number of fields differs from its header's
FORM = {"encoding": "UTF-8", "quote": '"', "escape": '"', "columnNameOfCorruptRecord": BROKEN,
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}
MAX_HEADERS = 100  # different headers in one load; more is a mistake in the input


def check_header(columns: list[str], file: str = "") -> list[str]:
    missing = sorted(set(REQUIRED_COLUMNS) - set(columns))
    if missing:
        raise ValueError(f"unexpected header, missing columns: {missing} {file}".rstrip())
    return columns


def fingerprint(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per source file: path, bytes, digest of the bytes, header record, and whether and in which blocks
    records hold line breaks. Empty files have no row. One pass over the input, a row per block moved."""
    return blocks.files(spark, path)


def read_raw(spark: SparkSession, path: str | list[str], files: DataFrame | None = None, multi_line: bool = True) -> DataFrame:
    """All-text rows in the order of SOURCE_COLUMNS; blanks stay blank text rather than null.

    Files are read in groups of equal headers and lined up by column name, and in parallel whatever their size.
    Those whose quoted fields hold line breaks are cut into records by what ``files`` tells of their blocks; with
    ``multi_line`` off every line is taken as a record. A lone carriage return is data. A row with too few or too
    many fields keeps its text in column BROKEN.
    """
    files = fingerprint(spark, path).checkpoint() if files is None else files
    odd = F.col("breaks") if multi_line else F.lit(False)
    groups = files.filter("bytes > 0").groupBy("header").agg(
        F.min("path").alias("example"), F.collect_list(F.when(~odd, F.col("path"))).alias("paths"), F.count_if(odd).alias("odd")).limit(MAX_HEADERS + 1).collect()
    if len(groups) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different headers")
    out = None
    for header, example, paths, broken in groups:
        names = check_header(next(csv.reader([header])), example)
        schema = ", ".join(f"`{n}` string" for n in [*names, BROKEN])
        parts = []
        if paths:
            parts.append(spark.read.schema(schema).options(header=True, columnPruning=False, **FORM).csv([unescaped(p) for p in paths]))
        if broken:
            rows = files.filter(odd & (F.col("header") == header)).select("path", "starts", "inside", F.xxhash64("path").alias("hash")).collect()
            found = blocks.records(spark, path, rows).filter("NOT (start = 0 AND seq = 0)")
            parts.append(found.select(F.from_csv("text", schema, FORM).alias("r")).select("r.*"))
        texts = [(F.coalesce(f"`{c}`", F.lit("")) if c in names else F.lit("")).alias(c) for c in SOURCE_COLUMNS]
        for part in parts:
            part = part.select(*texts, BROKEN)
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"no file with a header under {path}")
    return out


def unescaped(path: str) -> str:
    """The path that a URI names, as the readers take it."""
    from urllib.parse import unquote
    return unquote(path)
