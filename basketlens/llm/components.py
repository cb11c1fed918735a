"""Connected components of links by alternating large and small stars.

Each round joins links with the smallest neighbour of each node; hubs are reduced before the
shuffle and their join is left to Spark's skew splitting. Rounds end when the links no longer
change, which takes a logarithmic number of them; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _large(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node in links (a, b) but the smallest of each component, whose
    id the component carries. Loops and repeated links do no harm; no links, no rows."""
    links = stored(links.filter("a <> b").select("a", "b").distinct(), "links")
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
        links = stored(_small(_large(links)).filter("a <> b").distinct(), "links")


def local_roots(count: int, a, b):
    """Smallest index linked with each of ``count`` items by index pairs (a, b), in one task."""
    import numpy as np
    root = np.arange(count)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[root]
        if np.array_equal(new, root):
            return root
        root = new
