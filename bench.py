"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The fact table is built once from the raw tables, as the data model intends, and queried
from the store; ``raw`` repeats some queries straight from the raw tables, joins included.
Each query is timed from plan building to its last row: first run, then the best of two more.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from basketlens.plans.catalog import QUERIES  # noqa: E402
from basketlens.session import prepare  # noqa: E402
from basketlens.sources.store import write_sessions  # noqa: E402
from basketlens.sources.tables import adapt_orders  # noqa: E402

HEADLINE = [
    "totals", "group_category", "group_date", "group_product", "options_loc", "slice_combo",
    "slice_batch", "seg_semi_high", "seg_anti_window", "group_category_seg", "trend_seg", "segments", "segment_assign", "freq_hist",
    "funnel", "trend_month", "trend_auto", "top_products", "dq_facts", "export_json",
    "page_overview", "page_overview_seg", "page_customers", "page_conversion", "page_categories", "pages_all", "findings",
]
FROM_RAW = ["totals", "group_category", "segments", "trend_month", "seg_semi_high",
            "ingest_clean", "dq_findings", "dq_columns"]


def timed(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).collect()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("basketlens-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", f"{scratch}/checkpoints")
             .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)

    start = time.perf_counter()
    write_sessions(adapt_orders(spark, folder), f"{scratch}/store")
    build = time.perf_counter() - start
    rows = spark.read.parquet(f"{scratch}/store/sessions").count()

    cold = {name: timed(spark, name, f"{scratch}/store") for name in HEADLINE}
    warm = {name: min(timed(spark, name, f"{scratch}/store") for _ in range(2)) for name in HEADLINE}
    raw = {name: timed(spark, name, folder) for name in FROM_RAW}
    short = lambda d: {k: round(v, 3) for k, v in d.items()}
    print(json.dumps({
        "metric": "warm seconds over all headline queries on the stored fact table",
        "value": round(sum(warm.values()), 3), "unit": "sec", "queries": short(warm),
        "cold": short(cold), "raw": short(raw), "build_sec": round(build, 3), "sessions": rows,
        "cpus": int(cpus), "shuffle_partitions": int(cpus), "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
