"""Writes all pages of a store in a session of its own and prints, for each file scan, the rows it read.

Run as ``python count_reads.py STORE SCRATCH``; the event log goes to SCRATCH.
"""

import json
import os
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


def events(folder: str):
    for place, _, names in os.walk(folder):
        for name in names:
            if not name.startswith((".", "appstatus")):
                with open(os.path.join(place, name)) as lines:
                    yield from map(json.loads, lines)


def main(store: str, scratch: str) -> None:
    from basketlens.plans.pages import every_page
    from basketlens.sources.store import stored_sessions
    os.makedirs(f"{scratch}/events", exist_ok=True)
    spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", f"file://{scratch}/events")
             .config("spark.eventLog.compress", "false")
             .config("spark.checkpoint.dir", f"{scratch}/checkpoints").getOrCreate())
    pages = every_page(stored_sessions(spark, store)).collect()
    spark.stop()
    read = Counter()
    for event in events(f"{scratch}/events"):
        if event["Event"] == "SparkListenerTaskEnd" and event.get("Task Metrics"):
            read[event["Stage ID"]] += event["Task Metrics"]["Input Metrics"]["Records Read"]
    print(json.dumps({"rows": len(pages), "read": sorted(n for n in read.values() if n)}))


if __name__ == "__main__":
    main(*sys.argv[1:])
