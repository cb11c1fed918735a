"""Slices that a table asks for: thousands of requests, coerced and answered inside the job.

A request is any number of rows (request_id, key, value). Values are read as the slicers read their
arguments; those that cannot be used are ignored. Requests are numbered. For each slicer an index
leads from a value in the data to the set of requests that let it pass, as bits of whole numbers;
a session looks up its values and ANDs the sets. Work per session grows with slicers times words
of 64 requests, and no expression stands for a request. Sums are a product of matrices, values by rows times rows
by requests, block by block in the tasks; customers and products are dealt to tasks with their narrow rows, and
the union of their sessions' bits is taken there, so no set of requests is shuffled but those of busy keys.

An index has one row per value of its slicer's column in the data (codes, days, bands). Its size is
counted: the smallest are broadcast, up to BROADCAST_BYTES together, others joined by a shuffle. Requests beyond SLAB
take further passes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.metrics import ADDITIVE, MERGES, TOTALS, needed_bases
from ..functions.numbers import case, to_double
from .aggregate import zero_filled
from .customers import SEGMENTS
from .joins import HOT_ROWS, hot_keys, spread_join
from .ordering import row_numbers
from .slicers import BANDS, DAY_FIRST, ISO_DATE, SEGMENT_KEYS, SLICERS, WORD_BITS, YEARS, Slicer, buyer_segments, set_bits

SLAB = 8192  # requests answered in one pass
BROADCAST_BYTES = 64 << 20  # of all indexes that are broadcast
BLOCK_ROWS = 512  # rows whose bits a task unfolds at a time
UNION_ROWS = 4096  # rows whose words a task holds at a time
BY_KEY = {s.key: s for s in SLICERS}
GROUPS = {"y": r"(\d{4})", "m": r"(\d{1,2})", "d": r"(\d{1,2})"}
# Columns that metrics are taken from.
MEASURED = ["customer_id", "product_id", "visit_date", "purchased", "added_to_cart", "cart_abandoned", "revenue_cents", "gross_cents", "discount_cents", "quantity",
            "unit_cents", "discount_percent", "rating", "review_helpful_votes", "time_on_site_sec", "pages_viewed"]
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # a cluster needs no copy of the package
NO_VALUE = ""  # class of a session without a value; blank arguments are never used, so nobody asks for it


def _dates(df: DataFrame) -> DataFrame:
    """Adds ``ge`` and ``le``, the day numbers that a date argument in ``text`` means as a lower and an
    upper bound: a 30th or 31st that its month lacks moves to the next month, or back to the month's end.
    Step by step, so that each part is computed once."""
    def named(pattern) -> Column:
        order = sorted("ymd", key=pattern.groupindex.get)
        shape = "^" + "[-/]".join(GROUPS[k] for k in order) + "$"
        part = lambda k: F.regexp_extract("text", shape, order.index(k) + 1).try_cast("int").alias(k)
        return F.when(F.col("text").rlike(shape), F.struct(*[part(k) for k in "ymd"]))

    df = df.withColumn("_part", F.coalesce(named(DAY_FIRST), named(ISO_DATE)))
    y, m, d = (F.col(f"_part.{k}") for k in "ymd")
    df = df.withColumn("_first", F.when(y.between(YEARS[0], YEARS[-1]) & m.between(1, 12) & d.between(1, 31), F.make_date(y, m, F.lit(1))))
    df = df.withColumns({"_day": F.date_add("_first", d - 1), "_last": F.last_day("_first")})
    day = lambda beyond: F.unix_date(F.when(F.col("_day") > F.col("_last"), beyond).otherwise(F.col("_day"))).cast("bigint")
    return df.withColumns({"ge": day(F.date_add("_last", 1)), "le": day(F.col("_last"))}).drop("_part", "_first", "_day", "_last")


def _numbers(df: DataFrame) -> DataFrame:
    """Adds ``whole``: the whole part of a number, at the ends of the range where it lies beyond."""
    far = F.lit(float(1 << 62))
    df = df.withColumn("_number", to_double(F.regexp_replace("text", r"(?<=\d)_(?=\d)", "")))
    number = F.col("_number")
    whole = F.when(number >= far, F.lit((1 << 63) - 1)).when(number <= -far, F.lit(-(1 << 63))).otherwise(number.try_cast("bigint"))
    return df.withColumn("whole", whole).drop("_number")


def coerced(requests: DataFrame) -> DataFrame:
    """``request_id, slicer, asked``: usable arguments, as the class (text) that they name. Of several values for one
    key the greatest text counts."""
    text = F.regexp_replace(F.col("value").cast("string"), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    one = requests.select("request_id", F.col("key").alias("slicer"), text.alias("text")).filter("text <> ''")
    read = _numbers(_dates(one.groupBy("request_id", "slicer").agg(F.max("text").alias("text"))))
    of = lambda test: F.col("slicer").isin(*[s.key for s in SLICERS if test(s)])
    kind = lambda *names: of(lambda s: s.kind in names)
    listed = [(F.col("slicer") == key, F.when(F.col("text").isin(*known), F.col("text"))) for key, known in (*BANDS.items(), ("seg", SEGMENT_KEYS))]
    asked = case([(kind("int", "outcome"), F.col("whole").cast("string")), (kind("text"), F.substring("text", 1, 64)), *listed,
                  *[(of(lambda s, t=test: s.kind == "date" and s.test == t), F.col(test).cast("string")) for test in ("ge", "le")]])
    return read.select("request_id", "slicer", asked.alias("asked")).filter("asked IS NOT NULL")


def class_of(slicer: Slicer) -> Column:
    """A session's class under a slicer, as text."""
    column = F.col(slicer.column)
    if slicer.kind == "bands":
        def inside(above, up_to):
            if slicer.key == "dbucket" and above is None:
                return column == up_to
            return column <= up_to if above is None else (column > above) & (column <= up_to)
        found = case([(inside(*ends), F.lit(name)) for name, ends in BANDS[slicer.key].items()])
    elif slicer.kind == "segment":
        found = case([(column == name, F.lit(key)) for key, name in SEGMENT_KEYS.items()])
    else:
        found = (F.unix_date(column) if slicer.kind == "date" else column).cast("string")
    return F.coalesce(found, F.lit(NO_VALUE))


def classed(df: DataFrame, used: list[str]) -> DataFrame:
    """What the metrics need of each session, and its class under each slicer in use; evaluated once."""
    columns = [c for c in MEASURED if c in df.columns]
    return df.select(*columns, *[class_of(BY_KEY[k]).alias(f"_class_{k}") for k in used]).checkpoint()


def classes(rows: DataFrame, used: list[str]) -> DataFrame:
    """``slicer, class``: what occurs in the data, from one pass combined map-side."""
    pairs = [part for k in used for part in (F.lit(k), F.col(f"_class_{k}"))]
    return rows.select(F.stack(F.lit(len(used)), *pairs).alias("slicer", "class")).distinct()


def index(asked: DataFrame, domain: DataFrame, words: int) -> DataFrame:
    """``slicer, class, sets``: for each class of the data the requests it satisfies or that do not ask,
    ``words`` whole numbers."""
    bits = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("no") % WORD_BITS).cast("int"))
    terms = asked.select("slicer", "asked", F.floor(F.col("no") / WORD_BITS).cast("int").alias("word"), bits.alias("bits"))
    ask = terms.groupBy("slicer", "word").agg(F.bit_or("bits").alias("asking"))
    wide = domain.withColumn("word", F.explode(F.sequence(F.lit(0), F.lit(words - 1))))
    exact = [s.key for s in SLICERS if s.test == "eq"]
    same = (wide.filter(F.col("slicer").isin(*exact))
            .join(terms.groupBy("slicer", "word", F.col("asked").alias("class")).agg(F.bit_or("bits").alias("bits")), ["slicer", "word", "class"], "left"))
    parts = [same.select("slicer", "class", "word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))]
    for test in ("ge", "le"):
        keys = [s.key for s in SLICERS if s.test == test]
        limit = terms.filter(F.col("slicer").isin(*keys)).groupBy("slicer", "word", F.col("asked").cast("bigint").alias("at")).agg(F.bit_or("bits").alias("bits"))
        value = wide.filter(F.col("slicer").isin(*keys)).select("slicer", "word", F.col("class").try_cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("bits"), "class")
        both = limit.withColumn("class", F.lit(None).cast("string")).unionByName(value)
        # Limits at or before a value, in the direction of the test; a range holds classes and limits of one word.
        way = F.col("at").asc_nulls_first() if test == "ge" else F.col("at").desc_nulls_last()
        run = Window.partitionBy("slicer", "word").orderBy(way, F.col("class").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        reached = both.withColumn("bits", F.when(F.col("at").isNull(), F.lit(0).cast("bigint")).otherwise(F.bit_or("bits").over(run)))
        parts.append(reached.filter("class IS NOT NULL").select("slicer", "class", "word", "bits"))
    each = reduce(DataFrame.unionByName, parts).join(ask, ["slicer", "word"], "left")
    passing = F.col("bits").bitwiseOR(F.bitwise_not(F.coalesce("asking", F.lit(0).cast("bigint"))))
    sets = F.transform(F.array_sort(F.collect_list(F.struct("word", passing.alias("p")))), lambda x: x["p"])  # as many as words
    return each.groupBy("slicer", "class").agg(sets.alias("sets"))


def answered(rows: DataFrame, asked: DataFrame, domain: DataFrame, used: list[str], first: int, count: int, needs: set[str]) -> DataFrame:
    """Base aggregates by ``request_no`` of the requests from number ``first`` on."""
    words = -(-count // WORD_BITS)
    mine = asked.filter(F.col("no").between(first, first + count - 1)).withColumn("no", F.col("no") - first)
    sets = index(mine, domain, words).checkpoint()
    sizes = {r["slicer"]: r["n"] * words * 8 for r in sets.groupBy("slicer").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as slicers
    small, room = [], BROADCAST_BYTES
    for key in sorted(used, key=lambda k: sizes.get(k, 0)):
        if (room := room - sizes.get(key, 0)) >= 0:
            small.append(key)
    told = sets.filter(F.col("slicer").isin(*small)).toArrow() if small else None  # BROADCAST_BYTES at most
    held = {}
    for key in small:
        own = told.filter(pc.equal(told["slicer"], key)).combine_chunks()
        held[key] = pa.array(own["class"].to_pylist(), pa.string()), words_of(own["sets"], words)
    marked = rows
    for key in used:
        if key not in held:
            # Every class of the data is in the index. An outer join, as equalities of many inner ones make the optimizer infer ever more filters.
            found = sets.filter(F.col("slicer") == key).select(F.col("class").alias("_class"), F.col("sets").alias(f"_sets_{key}"))
            marked = marked.join(found, F.col(f"_class_{key}") == F.col("_class"), "left").drop("_class", f"_class_{key}")
    marked = marked.checkpoint() if len(held) < len(used) else marked
    bases = set_bases(marked, Sets(used, rows.sparkSession.sparkContext.broadcast(held), count), needs)
    return bases.withColumn("request_no", F.col("request_no") + first)


def words_of(lists, words: int) -> np.ndarray:
    """Lists of ``words`` whole numbers as rows of a matrix."""
    return pc.list_flatten(lists).to_numpy().reshape(-1, words)


class Sets:
    """Requests that rows satisfy, from their classes and the index."""

    def __init__(self, used: list[str], held, count: int):
        self.used, self.held, self.count = used, held, count
        self.words = -(-count // WORD_BITS)

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        """A row of words for each row."""
        every = np.full(self.words * WORD_BITS, 0, dtype=np.uint8)
        every[:self.count] = 1
        out = np.repeat(np.packbits(every, bitorder="little").view("<i8")[None], batch.num_rows, axis=0)
        for key in self.used:
            if key in self.held.value:
                classes, sets = self.held.value[key]
                out &= sets[pc.index_in(batch.column(f"_class_{key}"), classes).to_numpy()]
            else:
                out &= words_of(batch.column(f"_sets_{key}"), self.words)
        return out

    def bits(self, sets: np.ndarray) -> np.ndarray:
        """A row of 0 and 1 for each row of words."""
        return np.unpackbits(sets.astype("<i8", copy=False).view(np.uint8), axis=1, bitorder="little")[:, :self.count]

    def columns(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c.startswith(("_class_", "_sets_"))]


def set_bases(df: DataFrame, sets: Sets, needs: set[str]) -> DataFrame:
    """Base aggregates by ``request_no``. Rows of equal classes are added up first; a task multiplies the matrix of their
    sums by that of their bits. For distinct counts a task ORs the bits of a customer's or product's rows."""
    additive = [n for n in ADDITIVE if n in needs] or ["sessions"]
    parts = [added(df, sets, additive)]
    kinds = {"customers": F.lit(True), "buyers": F.col("purchased") == 1, "browsers": F.col("purchased") == 0}
    tests = {n: test for n, test in kinds.items() if n in needs}
    parts += [united(df, sets, "customer_id", tests)] if tests else []
    parts += [united(df, sets, "product_id", {"products": F.lit(True)})] if "products" in needs else []
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.groupBy("request_no").agg(*[F.max(c).alias(c) for c in stacked.columns if c != "request_no"])


def added(df: DataFrame, sets: Sets, additive: list[str]) -> DataFrame:
    """Additive bases by ``request_no``. Whole numbers are multiplied as their upper and lower 32 bits, so that sums
    of doubles are exact."""
    keys = sets.columns(df)
    alike = df.groupBy(*keys).agg(*[ADDITIVE[n]().alias(f"b_{n}") for n in additive])
    kinds = {c: t for c, t in alike.dtypes if c.startswith("b_")}
    ways = {f"b_{n}": {F.max: "max", F.min: "min"}.get(MERGES.get(n), "sum") for n in additive}
    whole = {c: t in ("tinyint", "smallint", "int", "bigint", "date") for c, t in kinds.items()}
    plain = alike.select(*keys, *[F.unix_date(c).cast("bigint").alias(c) if t == "date" else F.col(c).cast("bigint" if whole[c] else "double").alias(c) for c, t in kinds.items()])
    split = [c for c in kinds if ways[c] == "sum" and whole[c]]
    schema = ", ".join(["request_no bigint", *[f"`{c}` {'bigint' if whole[c] else 'double'}" for c in kinds], *[f"`{c}_high` bigint" for c in split]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = sets.count
        low, high = (np.zeros((len(split), count), dtype=np.int64) for _ in "lh")
        rest: dict[str, np.ndarray] = {}
        seen: dict[str, np.ndarray] = {}
        for batch in (b.slice(i, BLOCK_ROWS) for b in batches for i in range(0, b.num_rows, BLOCK_ROWS)):
            bits = sets.bits(sets.of(batch))
            dense = bits.astype(np.float64)
            value = np.array([pc.fill_null(batch.column(c), 0).to_numpy() for c in split], dtype=np.int64).reshape(len(split), batch.num_rows)
            low += ((value & 0xFFFFFFFF).astype(np.float64) @ dense).astype(np.int64)
            upper = value >> 32
            some = upper.any(axis=1)
            if some.any():
                high[some] += (upper[some].astype(np.float64) @ dense).astype(np.int64)
            for c in kinds:
                if c in split:
                    continue
                there = pc.is_valid(batch.column(c)).to_numpy(zero_copy_only=False)
                v, b = batch.column(c).drop_null().to_numpy(), bits[there]
                if ways[c] == "sum":
                    rest[c] = rest.get(c, 0) + np.where(b != 0, v[:, None], 0.0).sum(axis=0)
                    seen[c] = seen.get(c, False) | b.any(axis=0)
                elif len(v):
                    order = np.argsort(v, kind="stable")[::-1 if ways[c] == "max" else 1]
                    at = b[order].argmax(axis=0)  # the first that has the bit, if any
                    best, has = v[order][at], b[order[at], np.arange(count)] != 0
                    old, had = rest.get(c, best), seen.get(c, np.zeros(count, dtype=bool))
                    both = np.maximum(old, best) if ways[c] == "max" else np.minimum(old, best)
                    rest[c] = np.where(had & has, both, np.where(has, best, old))
                    seen[c] = had | has
        cols = [pa.array(np.arange(count))]
        for c in kinds:
            kind = pa.int64() if whole[c] else pa.float64()
            cols.append(pa.array(low[split.index(c)]) if c in split else pa.array(rest[c], kind, mask=~seen[c]) if c in rest else pa.nulls(count, kind))
        yield pa.RecordBatch.from_arrays([*cols, *map(pa.array, high)], names=["request_no", *kinds, *[f"{c}_high" for c in split]])

    def merge(c: str) -> Column:
        if c in split:
            return F.sum(c) + F.sum(f"{c}_high") * (1 << 32)
        out = {"max": F.max, "min": F.min, "sum": F.sum}[ways[c]](c)
        return F.date_from_unix_date(out.cast("int")) if kinds[c] == "date" else out

    return plain.mapInArrow(run, schema).groupBy("request_no").agg(*[merge(c).alias(c) for c in kinds])


def united(df: DataFrame, sets: Sets, key: str, tests: dict[str, Column]) -> DataFrame:
    """Distinct keys by ``request_no``, for each test the rows may have to pass. A key's rows meet in one task; those of
    a busy key are dealt over several, whose unions are brought together word by word."""
    known = df.filter(F.col(key).isNotNull())
    hot = hot_keys(known.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "n", HOT_ROWS)
    flags = [F.coalesce(test, F.lit(False)).alias(f"_is_{n}") for n, test in tests.items()]
    narrow = known.select(key, *sets.columns(df), *flags).withColumn("_row", F.xxhash64(F.monotonically_increasing_id()))
    dealt = narrow.join(F.broadcast(hot), key, "left").withColumn("_piece", F.pmod("_row", F.coalesce("_pieces", F.lit(1))).cast("int"))
    sorted_ = dealt.withColumn("_busy", F.col("_pieces").isNotNull()).drop("_pieces", "_row").repartition(key, "_piece").sortWithinPartitions(key, "_piece")
    schema = f"name string, request_no bigint, n bigint, `{key}` {dict(df.dtypes)[key]}, sets array<bigint>"
    kind, asked = sorted_.schema[key].dataType, list(tests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {n: np.zeros(sets.count, dtype=np.int64) for n in asked}
        names, type_ = ["name", "request_no", "n", key, "sets"], to_arrow_type(kind)

        def batch_of(n: str, no, number, keys: pa.Array, words: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([n] * len(keys), pa.string()), pa.array(no, pa.int64()), pa.array(number, pa.int64()), keys, pa.array(words, pa.list_(pa.int64()))], names=names)

        def finished(keys: pa.Array, busy: np.ndarray, unions: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for n, union in zip(asked, unions):
                plain = union[~busy]
                for i in range(0, len(plain), BLOCK_ROWS):
                    counts[n] += sets.bits(plain[i:i + BLOCK_ROWS]).sum(axis=0, dtype=np.int64)
                if busy.any():
                    few = keys.filter(pa.array(busy))
                    yield batch_of(n, [None] * len(few), [None] * len(few), few, union[busy].tolist())

        last = None  # key, busy and unions of the group that the next batch may go on with
        for batch in (b.slice(i, UNION_ROWS) for b in batches for i in range(0, b.num_rows, UNION_ROWS)):
            of, keys = sets.of(batch), batch.column(key)
            new = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False) if len(keys) > 1 else np.zeros(0, dtype=bool)
            starts = np.flatnonzero(np.concatenate([[True], new]))
            flag = [batch.column(f"_is_{n}").to_numpy(zero_copy_only=False) for n in asked]
            unions = [np.bitwise_or.reduceat(of if f.all() else np.where(f[:, None], of, 0), starts, axis=0) for f in flag]
            heads, busy = keys.take(pa.array(starts)), batch.column("_busy").to_numpy(zero_copy_only=False)[starts]
            if last is not None:
                if last[0][0] == heads[0]:
                    for union, before in zip(unions, last[2]):
                        union[0] |= before[0]
                else:
                    yield from finished(*last)
            yield from finished(heads[:-1], busy[:-1], [u[:-1] for u in unions])
            last = heads[-1:], busy[-1:], [u[-1:] for u in unions]
        if last is not None:
            yield from finished(*last)
        for n, c in counts.items():
            at = np.flatnonzero(c)
            yield batch_of(n, at, c[at], pa.nulls(len(at), type_), [None] * len(at))

    told = sorted_.mapInArrow(run, schema).checkpoint()
    words = told.filter("sets IS NOT NULL").select("name", key, F.posexplode("sets").alias("_word", "_bits")).filter("_bits <> 0")
    union = words.groupBy("name", key, "_word").agg(F.bit_or("_bits").alias("_bits"))
    same = union.groupBy("name", "_word", "_bits").agg(F.count(F.lit(1)).alias("n")).withColumn("_bit", F.explode(set_bits(F.col("_bits"))))
    both = told.filter("sets IS NULL").select("name", "request_no", "n").union(same.select("name", (F.col("_word") * WORD_BITS + F.col("_bit")).cast("bigint"), "n"))
    return both.groupBy("request_no").agg(*[F.sum(F.when(F.col("name") == n, F.col("n"))).alias(f"b_{n}") for n in tests])


def table_totals(df: DataFrame, requests: DataFrame, metrics: Iterable[str] = tuple(TOTALS)) -> DataFrame:
    """Totals of every request of a table (request_id, key, value); a request without a usable row
    takes all sessions, one that nothing satisfies gets zeros."""
    metrics = list(metrics)
    ids = requests.select("request_id").distinct()
    numbered = row_numbers(ids, F.col("request_id")).select("request_id", (F.col("rn") - 1).alias("no")).checkpoint()
    total = numbered.count()
    # Null-safe, as a request may have no name.
    asked = coerced(requests).withColumnRenamed("request_id", "_id").join(numbered, F.col("_id").eqNullSafe(F.col("request_id"))).select("no", "slicer", "asked").checkpoint()
    used = {r[0] for r in asked.select("slicer").distinct().collect()}  # at most as many as slicers
    source = df
    if "seg" in used:
        people = buyer_segments(df)
        if people.filter(F.col("segment") != SEGMENTS[3]).isEmpty():
            used.discard("seg")  # nobody bought: the slicer is ignored
        else:
            source = spread_join(df, people.select("customer_id", "segment"), "customer_id", "left", hot_keys(people, "customer_id", "sessions"))
    used = [s.key for s in SLICERS if s.key in used]
    asked = asked.filter(F.col("slicer").isin(*used)) if used else asked.limit(0)
    rows = classed(source, used)
    domain = classes(rows, used).checkpoint() if used else None
    texts = [s.key for s in SLICERS if s.kind == "text" and s.key in used]
    if texts:  # a text must occur in the data to count
        known = domain.filter(F.col("slicer").isin(*texts)).withColumnRenamed("class", "asked")
        asked = asked.filter(~F.col("slicer").isin(*texts)).unionByName(asked.join(known, ["slicer", "asked"], "left_semi").select(*asked.columns))
    needs = needed_bases(metrics)
    if not used:
        domain = df.sparkSession.createDataFrame([], "slicer string, class string")
    parts = [answered(rows, asked, domain, used, first, max(1, min(SLAB, total - first)), needs) for first in range(0, max(1, total), SLAB)]
    names = numbered.withColumnRenamed("no", "request_no")
    return zero_filled(names.join(reduce(DataFrame.unionByName, parts), "request_no", "left"), metrics, "request_id")
