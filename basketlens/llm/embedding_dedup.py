"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells.

Exact copies are first collapsed to one vector with a count. Centres are fitted on a bounded
sample; every vector has a home cell, the centre of greatest cosine. Two similar vectors may have
different homes, so a vector also visits each lower-numbered cell whose boundary with its home is
nearer than ``margin``. With margin sqrt(1 - threshold^2) no pair can be missed. The default is
measured: about ``QUERIES`` vectors picked by hash are compared with all rows, and each link found
tells the margin it needs; the largest is taken, and never less than ``Z`` standard deviations of
the distance between two vectors at the threshold along one direction. Another vector's links need
more with a chance of one in the number of queries. If fewer than ``LINKED`` queries have links,
more are asked, and in the end the margin is sqrt(1 - threshold^2). In a table of at most
``QUERIES`` distinct vectors every vector is asked, so no link is lost. A cell is cut into
blocks, and a task compares two blocks by one matrix product in double precision, so a cell that
holds a third of all vectors is many tasks. A task returns a row per vector (its number of links,
and one link that spans its local component), never pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link
with nothing; a shorter vector is compared as if padded with zeros; links are cosine >= threshold,
ties included; rows that repeat an id count as vectors of their own; an empty table gives no rows;
other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ready, stored
from .components import components, local_roots

SAMPLE = 20_000  # vectors the centres are fitted on, about
MAX_CELLS = 4096
PER_CELL = 64  # distinct vectors per cell aimed at
BLOCK = 256
ROUNDS = 6
Z = 2.0
QUERIES = 4096  # vectors compared with all rows to measure the margin, about
MAX_QUERIES = 65536
LINKED = 100  # of them with links, at least; else more are asked
TASK_DDL = "task string, side int, id bigint, n bigint, vector array<double>"
LINK_DDL = "id bigint, links bigint, other bigint"


def usable(vector: Column) -> Column:
    """Has a direction: some components, all finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: list[list[float]], size: int) -> np.ndarray:
    """Rows as unit vectors in double precision, padded with zeros; scaled first so that no square overflows."""
    out = np.zeros((len(rows), size))
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def fit(points: np.ndarray, cells: int, seed: int = 1) -> np.ndarray:
    """Centres of unit length."""
    if len(points) <= 1 or cells <= 1:
        return points[:1]
    picked = np.random.default_rng(seed).permutation(len(points))[:cells]
    centres = points[picked]
    for _ in range(ROUNDS):
        home = homes_of(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, points)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def homes_of(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(points[i:i + 4096] @ centres.T, axis=1) for i in range(0, len(points), 4096)])


def homes(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cos = points @ centres.T
    return cos, np.argmax(cos, axis=1)


def visits(cos: np.ndarray, home: np.ndarray, gaps: np.ndarray, margin: float) -> np.ndarray:
    """Which lower-numbered cells each vector visits; gaps: distances between centres."""
    distance = (cos[np.arange(len(home)), home][:, None] - cos) / np.maximum(gaps[home], 1e-12)
    return (distance <= margin) & (np.arange(cos.shape[1]) < home[:, None])


def batches_of(batch: pa.RecordBatch, size: int) -> Iterator[tuple[list, list, np.ndarray]]:
    for i in range(0, batch.num_rows, 512):
        part = batch.slice(i, 512).to_pydict()
        if part["id"]:
            yield part["id"], part["n"], unit(part["vector"], size)


def needed(shared, size: int, threshold: float):
    """The largest margin that the links of each query that has links need, among the rows of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, keys, queries, home_q = shared.value
        gaps = np.maximum(np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T)), 1e-12)
        most = np.full(len(keys), -1.0)
        for batch in batches:
            for ids, _, points in batches_of(batch, size):
                cos, home = homes(points, centres)
                near = cos[np.arange(len(home)), home]
                for i in range(0, len(keys), 1024):
                    q, at = queries[i:i + 1024], home_q[i:i + 1024]
                    linked = (q @ points.T >= threshold) & (keys[i:i + 1024, None] != np.array(ids)[None, :])
                    some = linked.any(axis=1)
                    if not some.any():
                        continue
                    q, at, linked = q[some], at[some], linked[some]
                    # The one of the higher cell is the visitor.
                    away = np.where(at[:, None] > home, (q * centres[at]).sum(axis=1)[:, None] - q @ centres[home].T, near - cos[:, at].T) / gaps[at][:, home]
                    need = np.where(linked, np.where(at[:, None] == home, 0.0, np.maximum(away, 0.0)), -1.0).max(axis=1)
                    most[i:i + 1024][some] = np.maximum(most[i:i + 1024][some], need)
        found = np.nonzero(most >= 0)[0]
        yield pa.RecordBatch.from_pydict({"query": pa.array(keys[found], pa.int64()), "need": pa.array(most[found], pa.float64())})
    return run


def measured_margin(classes: DataFrame, place: Column, count: int, size: int, centres: np.ndarray, threshold: float) -> float:
    """Margin that every link of the queries needs at most; sqrt(1 - threshold^2) if too few have links."""
    spark = classes.sparkSession
    wanted = QUERIES
    while True:
        asked = classes.filter(place >= 1 - min(1.0, wanted / count)).select("id", "vector").toArrow()
        if asked.num_rows:
            queries = unit(asked["vector"].to_pylist(), size)
            shared = spark.sparkContext.broadcast((centres, np.array(asked["id"].to_pylist(), dtype=np.int64), queries, homes_of(queries, centres)))  # at most MAX_QUERIES vectors, about
            linked, most = (classes.mapInArrow(needed(shared, size, threshold), "query bigint, need double").groupBy("query").agg(F.max("need").alias("need"))
                            .agg(F.count("*"), F.coalesce(F.max("need"), F.lit(0.0))).first())
            shared.unpersist()
            if linked >= LINKED or wanted >= count:
                return most + 1e-9  # products of other shapes round otherwise
        if wanted >= MAX_QUERIES:
            return math.sqrt(1 - threshold * threshold)
        wanted *= 4


def cell_sizes(shared, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, margin = shared.value
        gaps = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
        own, guests = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64)
        for batch in batches:
            for _, _, points in batches_of(batch, size):
                cos, home = homes(points, centres)
                own += np.bincount(home, minlength=len(centres))
                guests += visits(cos, home, gaps, margin).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(len(centres))), "own": pa.array(own), "guests": pa.array(guests)})
    return run


def to_tasks(shared, size: int):
    """Each vector goes to every pair of blocks of a cell that it takes part in. Side 0 and 1 are
    compared with each other; a pair of a block with itself has side 0 only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, margin, own, guests = shared.value
        gaps = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
        for batch in batches:
            for ids, ns, points in batches_of(batch, size):
                cos, home = homes(points, centres)
                seen = visits(cos, home, gaps, margin)
                out = []
                for i, (key, n) in enumerate(zip(ids, ns)):
                    cell = int(home[i])
                    mine = key * 2654435761 % own[cell]
                    out += [(f"{cell}:{min(mine, j)}:{max(mine, j)}", int(j < mine), key, n, points[i]) for j in range(own[cell])]
                    out += [(f"{cell}:{mine}:g{j}", 0, key, n, points[i]) for j in range(guests[cell])]
                    for cell in np.nonzero(seen[i])[0].tolist():
                        mine = key * 2654435761 % max(1, guests[cell])
                        out += [(f"{cell}:{j}:g{mine}", 1, key, n, points[i]) for j in range(own[cell])]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64())))],
                                                     names=["task", "side", "id", "n", "vector"])
    return run


def compare(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, ns, side = rows["id"].to_numpy(), rows["n"].to_numpy(), rows["side"].to_numpy()
        points = np.stack(rows["vector"].to_numpy())
        _, low, high = rows["task"].iloc[0].split(":")
        left = np.nonzero(side == 0)[0]
        right = left if low == high else np.nonzero(side == 1)[0]
        a, b = np.nonzero(points[left] @ points[right].T >= threshold) if len(left) and len(right) else ([], [])
        a, b = left[a], right[b]
        if low == high:
            apart = a != b
            a, b = a[apart], b[apart]
        links = np.zeros(len(ids), dtype=np.int64)
        np.add.at(links, a, ns[b])
        if low != high:
            np.add.at(links, b, ns[a])
        order = np.argsort(ids, kind="stable")  # smallest index is the smallest id
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        root = local_roots(len(ids), rank[a], rank[b])
        other = ids[order][root[rank]]
        some = links > 0
        return pd.DataFrame({"id": ids[some], "links": links[some], "other": other[some]})
    return run


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.95,
                    margin: float | None = None) -> DataFrame:
    """A row per vector: the id, ``n_links, component_id, kept``."""
    spark = ready(rows.sparkSession)
    given = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    good = given.filter(usable(F.col("v")) & F.col("vec_id").isNotNull())
    classes = stored(good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumnRenamed("v", "vector"), "vectors")
    count, size = classes.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    own = given.select("vec_id", F.when(usable(F.col("v")), F.col("v")).alias("v"))
    if not count:
        return own.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    cells = max(1, min(MAX_CELLS, count // PER_CELL))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = classes.filter(place < min(1.0, SAMPLE / count)).select("vector").toArrow()["vector"].to_pylist()
    centres = fit(unit(sample, size), cells) if sample else np.eye(1, size)
    if margin is None:
        # One cell has no boundary.
        margin = max(Z * math.sqrt(2 - 2 * threshold) / math.sqrt(size), measured_margin(classes, place, count, size, centres, threshold) if len(centres) > 1 else 0.0)
    margin = min(margin, math.sqrt(1 - threshold * threshold))
    shared = spark.sparkContext.broadcast((centres, margin))  # at most MAX_CELLS vectors
    sizes = classes.mapInArrow(cell_sizes(shared, size), "cell bigint, own bigint, guests bigint").groupBy("cell").agg(F.sum("own"), F.sum("guests")).collect()
    blocks = [[0] * len(centres), [0] * len(centres)]
    for cell, mine, guests in sizes:
        blocks[0][cell], blocks[1][cell] = -(-mine // BLOCK), -(-guests // BLOCK) if mine else 0
    plan = spark.sparkContext.broadcast((centres, margin, *blocks))
    found = stored(classes.mapInArrow(to_tasks(plan, size), TASK_DDL).groupBy("task").applyInPandas(compare(threshold), LINK_DDL), "vector-links")
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    told = (classes.join(linked, "id", "left").join(groups, F.col("id") == F.col("node"), "left")
            .select(F.col("vector").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    whole = own.join(told, "v", "left")
    component = F.coalesce("component_id", "vec_id")
    return whole.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
