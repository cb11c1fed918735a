"""Target-distribution importance resampling with deduplicated segments, in DataFrame functions.

Features are runs of 1 to ``max_n`` words hashed into buckets. A bucket's gain is the scaled
log-ratio of its smoothed share in the target and in the corpus, a document's weight the sum of the
gains of its features, and its score that weight plus Gumbel noise drawn from its id: the highest
scores are a draw without replacement in proportion to the likelihood ratio.

Line feeds separate words, so a text is cut into lines. Equal lines of the whole corpus become one
row (``lines``), whose buckets are computed once; corpus counts are theirs times the line's
occurrences. A document keeps the 128-bit names of its lines and the buckets of runs that reach
across a line's end, which belong to no line. Once the gains are known, each distinct line is
weighed once and documents add up the weights of their lines.

Scale: lines are counted map-side before they travel once; afterwards only names do. Lines that
make up more than one in ``common.HOT`` of all occurrences (so fewer than ``HOT`` lines) are broadcast,
as a line that a third of all documents share would be one key of the join. Gains are one array
of ``buckets`` numbers. Ranks come from a range split, never from one task.

Defined results: null and empty texts have no features and weight 0; a null id draws its noise from
the empty text and comes last among ties; rows that repeat an id or a whole row are ranked one by
one; very long texts and lines are counted whole; an empty target or corpus leaves all counts at 0;
an empty table stays empty; other columns are left alone, those named in ``keep`` are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ordering import row_numbers
from .common import hot_join, stored

# What separates words, after A-Z became a-z; additive smoothing of one a bucket.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 1000.0  # gains and noise are whole thousandths
MAX_BUCKETS = 1 << 18  # gains travel as one array


def words(line: Column) -> Column:
    return F.regexp_extract_all(F.translate(line, UPPER, LOWER_CASE), F.lit(WORD), F.lit(0))


def bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def runs(found: Column, n: int, buckets: int, keep=None) -> Column:
    """Buckets of the runs of ``n`` words, of those whose first place passes ``keep``."""
    places = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - (n - 1))).otherwise(F.array().cast("array<int>"))
    places = F.filter(places, keep) if keep else places
    return F.transform(places, lambda i: bucket(F.array_join(F.slice(found, i, n), " "), buckets))


def within(found: Column, max_n: int, buckets: int) -> Column:
    """Buckets of all runs inside a line."""
    single = F.transform(found, lambda w: bucket(w, buckets))
    return F.concat(single, *[runs(found, n, buckets) for n in range(2, max_n + 1)])


def across(rows: DataFrame, max_n: int, buckets: int) -> DataFrame:
    """Adds ``cross``, the buckets of runs that begin in one line and end in another."""
    if max_n < 2:
        return rows.withColumn("cross", F.array().cast("array<int>"))
    by_line = F.transform("cut", words)
    flat = rows.withColumn("_by_line", by_line).withColumns({
        "_words": F.flatten("_by_line"),
        "_line": F.flatten(F.transform("_by_line", lambda found, i: F.array_repeat(i, F.size(found))))})
    reach = lambda n: lambda i: F.element_at("_line", i) != F.element_at("_line", i + (n - 1))
    cross = F.concat(*[runs(F.col("_words"), n, buckets, reach(n)) for n in range(2, max_n + 1)])
    return flat.withColumn("cross", cross).drop("_by_line", "_words", "_line")


def segmented(docs: DataFrame, text: str, max_n: int, buckets: int, keep: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """``docs`` (a numbered row per document: ``keep``, names of its lines, ``cross``) and ``lines`` (a
    row per distinct line: name, ``times``, ``n_words``, ``buckets``), both written."""
    cut = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n").alias("cut")
    rows = across(docs.select(*[c.alias(n) for n, c in keep.items()], cut), max_n, buckets)
    name = lambda line: F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), *keep, "cross", F.transform("cut", name).alias("names"))
    lines = docs.select(F.explode(cut).alias("line")).groupBy("line").agg(F.count("*").alias("times"))
    lines = lines.select("line", "times", words(F.col("line")).alias("words"))
    lines = lines.select(name(F.col("line")).alias("name"), "times", F.size("words").cast("long").alias("n_words"), within(F.col("words"), max_n, buckets).alias("buckets"))
    return stored(numbered, "importance-docs"), stored(lines.select("name.*", "times", "n_words", "buckets"), "importance-lines")


def counts(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``bucket, n`` over all features."""
    each = lines.select(F.explode("buckets").alias("bucket"), "times").unionAll(docs.select(F.explode("cross"), F.lit(1).cast("long")))
    return each.groupBy("bucket").agg(F.sum("times").alias("n"))


def gains(spark: SparkSession, corpus: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """Each bucket's gain; a bucket neither side has seen gets that of two zero counts."""
    total = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    corpus, target = stored(corpus, "importance-corpus"), stored(target, "importance-target")
    size, wanted = total(corpus), total(target)
    n = lambda side: (F.coalesce(F.col(f"{side}.n"), F.lit(0)) + 1).cast("double")
    ratio = (n("t") * F.lit(float(size + buckets))) / (n("s") * F.lit(float(wanted + buckets)))
    rows = (spark.range(buckets).join(corpus.alias("s"), F.col("id") == F.col("s.bucket"), "left")
            .join(target.alias("t"), F.col("id") == F.col("t.bucket"), "left")
            .select("id", F.floor(F.lit(SCALE) * F.log(ratio)).alias("gain")))
    return [r.gain for r in sorted(rows.collect())]


def weigh(docs: DataFrame, lines: DataFrame, gain: list[int], keep: list[str]) -> DataFrame:
    """``row``, ``keep``, ``n_words, n_features, weight`` per document."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one literal
    total = lambda found: F.aggregate(found, F.lit(0).cast("long"), lambda sum_, b: sum_ + F.get(table, b))
    weighed = stored(lines.select("a", "b", "times", "n_words", F.size("buckets").cast("long").alias("n_features"), total(F.col("buckets")).alias("weight")), "importance-weights")
    sums = ["n_words", "n_features", "weight"]
    held = hot_join(docs.select("row", *keep, F.explode("names").alias("name")).select("row", *keep, "name.*"), weighed, ["a", "b"], "times")
    cross = docs.select("row", *keep, F.lit(0).cast("long").alias("n_words"), F.size("cross").cast("long").alias("n_features"), total(F.col("cross")).alias("weight"))
    parts = held.select("row", *keep, *sums).unionAll(cross)
    return parts.groupBy("row", *keep).agg(*[F.sum(c).alias(c) for c in sums])


def noise(identity: Column, seed: str) -> Column:
    """Gumbel noise in whole thousandths from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-SCALE) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", max_n: int = 1,
             buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: str = "2024", keep: list[str] | None = None) -> DataFrame:
    """A row per document: ``keep`` (the id unless told otherwise) and ``n_features, weight, score, rank``.
    ``rank`` counts the drawn ``percent`` of the documents of at least ``min_words`` words; it is null for the
    others. Columns of ``keep`` that bear one of these names are replaced."""
    if not 1 <= buckets <= MAX_BUCKETS or max_n < 1 or not 0 <= percent <= 100:
        raise ValueError("buckets, max_n or percent out of range")
    own = ["n_features", "weight", "score", "rank"]
    keep = [c for c in (keep or [id_col]) if c not in own]
    kept = {"id": F.col(id_col), "kept": F.struct(*[F.col(c) for c in keep])} if keep != [id_col] else {"id": F.col(id_col)}
    rows, lines = segmented(docs, text, max_n, buckets, kept)
    goal = segmented(target, target_text, max_n, buckets, {})
    gain = gains(docs.sparkSession, counts(rows, lines), counts(*goal), buckets)
    scored = weigh(rows, lines, gain, ["id"]).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = stored(scored, "importance-scores")
    fit = F.col("n_words") >= min_words
    drawn = scored.filter(fit).count() * percent // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    ranked = row_numbers(scored.filter(fit), *order, name="rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    told = ranked.select("row", "id", *own).unionAll(scored.filter(~fit).select("row", "id", *own[:3], F.lit(None).cast("long")))
    if "kept" not in kept:
        return told.select(F.col("id").alias(id_col), *own)
    return told.join(rows.select("row", "kept"), "row").select(*[F.col("kept").getField(c).alias(c) for c in keep], *own)
