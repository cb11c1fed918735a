"""Mixing sources to target weights, in DataFrame operations only.

Token shares p of the sources are raised to one exponent a in [0, 1] and normalised: a = 1 keeps
the shares, a = 0 makes all sources equal. The exponent is bisected until the mixture's entropy
reaches ``target_entropy`` (a share of the greatest entropy, log of the number of sources; the
largest such exponent), or, without a target, until no source repeats more than ``max_repeats``
times (the smallest such exponent). Each job over the table of sources halves the bracket
``HALVINGS`` times, by trying all of those inner points at once.

The weights become whole token budgets. A source's budget is spent in epochs: full passes, then
the longest prefix of one more random order that the budget still covers. Where that prefix ends
is found by two rounds of summing tokens over 1024 slices of the order, then a running sum inside
one slice, so a source that holds a third of all rows is never ordered in one task. Epoch e puts a
document at (e + u) / epochs of its source's course, u its place in that epoch's random order;
cutting the courses of all sources at equal places gives blocks that each hold the target mixture.

Defined results: a null source is a source of its own; null or empty texts have no tokens and come
with the full passes, and with the partial pass where their place is before its end; a source
without tokens is passed once; ties in the random order go by id; repeated rows are documents of
their own; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ready, stored

WORD = r"[^\x20\x09-\x0D]+"
SLICES = 1024
HALVINGS = 5
ROUNDS = 6
BITS = 48  # of a place in a random order


def place(id_col: Column, epoch: Column, seed: int) -> Column:
    """Pseudo-random whole number below 2^BITS."""
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")), epoch.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def exponent(sources: DataFrame, budget: int, target_entropy: float | None, max_repeats: float) -> float:
    """Bisect the exponent over ``sources`` (column p: share; t: tokens)."""
    low, high = 0.0, 1.0

    def holds(r) -> bool:
        """Does the exponent leave the smaller side, where the mixture is too flat or flat enough?"""
        if target_entropy is None:
            return budget * r["steepest"] / r["z"] <= max_repeats  # true from some exponent upwards
        return math.log(r["z"]) - r["a"] * r["plogp"] / r["z"] < target_entropy * math.log(r["n"]) - 1e-12

    for _ in range(ROUNDS):
        step = (high - low) / 2 ** HALVINGS
        tried = [low + step * i for i in range(2 ** HALVINGS + 1)]
        power = F.pow("p", F.col("a"))
        rows = (sources.withColumn("a", F.explode(F.array(*map(F.lit, tried)))).groupBy("a").agg(
            F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("plogp"), F.max(power / F.col("t")).alias("steepest"),
            F.count("*").alias("n")).collect())  # one row per exponent tried
        right = sorted((r["a"] for r in rows if holds(r)))
        if not rows:
            return 1.0
        if not right:
            return high
        high = right[0]
        low = max((a for a in tried if a < high), default=low)
        if high == low or high == tried[0]:
            break
    return high if target_entropy is None else low


def plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", budget: int | None = None,
         target_entropy: float | None = 0.95, max_repeats: float = 4.0, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(documents, sources). Documents: ``id, key, tokens``; sources: ``key, t`` (tokens), ``share,
    weight, budget, passes`` (full), ``rest`` (tokens left for the partial pass), ``epochs``, and
    where the partial pass ends: ``cut_place, cut_id``."""
    ready(docs.sparkSession)
    rows = stored(docs.select(F.col(id_col).alias("id"), source_key(source).alias("key"),
                              F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("tokens")), "mix-documents")
    totals = stored(rows.groupBy("key").agg(F.sum("tokens").alias("t")), "mix-sources")
    whole = totals.agg(F.sum("t")).first()[0] or 0
    budget = whole if budget is None else budget
    shares = totals.filter("t > 0").withColumn("p", F.col("t") / F.lit(float(max(whole, 1))))
    a = exponent(shares, budget, target_entropy, max_repeats)
    norm = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    weight = F.when(F.col("t") > 0, F.pow(F.col("t") / F.lit(float(max(whole, 1))), F.lit(a)) / F.lit(norm)).otherwise(F.lit(0.0))
    sources = totals.select("key", "t", (F.col("t") / F.lit(float(max(whole, 1)))).alias("share"), weight.alias("weight"))
    sources = sources.withColumn("budget", F.round(F.col("weight") * F.lit(float(budget))).cast("bigint"))
    sources = sources.withColumn("passes", F.when(F.col("t") > 0, F.expr("budget div t")).otherwise(F.lit(1)).cast("bigint"))
    sources = sources.withColumn("rest", F.when(F.col("t") > 0, F.expr("budget % t")).otherwise(F.lit(0)).cast("bigint"))
    sources = sources.withColumn("epochs", F.greatest(F.when(F.col("t") > 0, F.col("budget") / F.col("t")).otherwise(F.lit(1.0)), F.lit(1e-12)))
    sources = stored(sources, "mix-weights")
    return rows, sources.join(cuts(rows, sources, seed), "key", "left")


def cuts(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """``key, cut_place, cut_id``: the last document of each source's partial pass."""
    open_ = sources.filter("rest > 0").select("key", "passes", F.col("rest").alias("left"))
    at = rows.join(open_.select("key", "passes"), "key").select("key", "id", "tokens", place(F.col("id"), F.col("passes"), seed).alias("u"))
    at = stored(at, "mix-order")
    found = open_.select("key", "left")
    scale = 1 << BITS
    last = at
    for _ in range(2):
        scale //= SLICES
        within = last.withColumn("slice", F.floor(F.col("u") / F.lit(scale)).cast("bigint"))
        sums = within.groupBy("key", "slice").agg(F.sum("tokens").alias("n"))
        order = Window.partitionBy("key").orderBy("slice")  # at most SLICES rows
        run = sums.withColumn("upto", F.sum("n").over(order)).join(found.select("key", "left"), "key")
        # The first slice that does not fit whole holds the end; what lies before it is taken.
        first = run.filter(F.col("upto") > F.col("left")).groupBy("key").agg(F.min_by(F.struct("slice", (F.col("left") - F.col("upto") + F.col("n")).alias("left")), "slice").alias("f"))
        found = stored(first.select("key", F.col("f.slice").alias("slice"), F.col("f.left").alias("left")), "mix-slice")
        last = within.join(found.select("key", "slice"), ["key", "slice"]).drop("slice")
    order = Window.partitionBy("key").orderBy("u", "id")
    inside = last.withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(found, "key")
    taken = inside.filter(F.col("upto") <= F.col("left")).groupBy("key").agg(F.max(F.struct("u", "id")).alias("m"))
    # Nothing of the last slice may fit: then the pass ends where that slice begins.
    return found.join(taken, "key", "left").select(
        "key", F.coalesce(F.col("m.u"), F.col("slice") * F.lit(scale)).alias("cut_place"), F.col("m.id").alias("cut_id"))


def repeats(passes: Column, rest: Column, u: Column, id_col: Column, cut_place: Column, cut_id: Column) -> Column:
    inside = (rest > 0) & ((u < cut_place) | ((u == cut_place) & (id_col <= cut_id)))
    return passes + F.when(inside, 1).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", blocks: int = 100, seed: int = 1,
        out: str = "mix", **targets) -> DataFrame:
    """A row per document and epoch in which it is shown: all columns, and a struct ``out`` with
    ``epoch, block, place, weight``. Order by (block, place) to train. An ``out`` that is there is
    replaced."""
    _, sources = plan(docs, id_col, text, source, seed=seed, **targets)
    sources = stored(sources, "mix-plan").select(F.struct("*").alias("_mix_source"))
    key, s = "_mix_source.key", lambda name: F.col(f"_mix_source.{name}")
    rows = docs.drop(out).withColumn("_mix_key", source_key(source)).join(sources, F.col("_mix_key") == F.col(key))
    times = repeats(s("passes"), s("rest"), place(F.col(id_col), s("passes"), seed), F.col(id_col), s("cut_place"), s("cut_id"))
    shown = rows.withColumn("_mix_times", times).filter("_mix_times > 0").withColumn("_mix_epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_mix_times") - 1)))
    at = (F.col("_mix_epoch") + place(F.col(id_col), F.col("_mix_epoch"), seed) / F.lit(float(1 << BITS))) / s("epochs")
    shown = shown.withColumn("_mix_at", at)
    block = F.least(F.floor(F.col("_mix_at") * blocks).cast("bigint"), F.lit(blocks - 1).cast("bigint"))
    return shown.withColumn(out, F.struct(F.col("_mix_epoch").alias("epoch"), block.alias("block"), F.col("_mix_at").alias("place"),
                                          s("weight").alias("weight"))).drop("_mix_source", "_mix_key", "_mix_times", "_mix_epoch", "_mix_at")
