"""Small helpers the operators share: session, scratch tables, words, model broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import from_arrow_type

from ..session import prepare

BATCH_ROWS = 1000  # texts handed to Python at a time; long texts make larger batches useless
# The six white-space bytes that separate words in [^\x20\x09-\x0D]+.
SPACES = b" \t\n\x0b\x0c\r"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))  # A-Z only


def ready(spark: SparkSession) -> SparkSession:
    """Reliable checkpoints and small Arrow batches."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ready(spark).sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(array: pa.Array) -> list[str]:
    """Texts of a batch; null is the empty text."""
    return [t or "" for t in array.to_pylist()]


def tidy() -> None:
    """Hand memory back to the system at a task's end: idle workers of earlier stages stay alive for a
    while, beside those of the next one."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps what it has
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(work):
    """A function over Arrow batches that ends with ``tidy``."""
    @functools.wraps(work)
    def run(batches):
        yield from work(batches)
        tidy()
    return run


def words_of(text: str) -> list[bytes]:
    """Words [^ \\t-\\r]+ of a text as UTF-8. bytes.split() separates at just these six bytes."""
    return text.encode().split()


def structs(kind: pa.DataType, rows: list[tuple]) -> pa.Array:
    """Rows as an Arrow struct array."""
    cols = list(zip(*rows)) if rows else [[] for _ in kind]
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind)], fields=list(kind))


def bucket(column: str, modulus: int):
    """crc32 of the id's text, modulo; a null id falls in bucket 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)), F.lit(0))



def text_udf(make: Callable[[], Callable[[list[str]], list[tuple]]], kind: pa.DataType):
    """Arrow UDF of a text column: ``make()`` runs once per task and gives the function from a
    batch of texts to rows of ``kind``. Not deterministic for Spark, which would otherwise
    evaluate it once more for each filter on its result."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rows = make()
        for batch in batches:
            yield structs(kind, rows(texts_of(batch)))
        del rows
        tidy()
    return F.arrow_udf(run, returnType=from_arrow_type(kind)).asNondeterministic()


HOT = 10_000  # a key with more than one in so many rows is joined by broadcast


def hot_join(rows: DataFrame, facts: DataFrame, key: list[str], times: str) -> DataFrame:
    """Inner join of ``rows`` to ``facts``, one row a key, whose column ``times`` counts the key's rows (and
    is dropped). Fewer than ``HOT`` keys can be above one in ``HOT`` rows: these are broadcast, so
    that a key of a third of all rows is not one task; the others are joined by a shuffle.
    ``facts`` is read several times, so it should be written."""
    total = facts.agg(F.coalesce(F.sum(times), F.lit(0)).alias("n")).first().n
    hot = F.col(times) * HOT > total
    names = [c for c in facts.columns if c not in (*key, times)]
    known = F.struct(*names).alias("_known")
    marked = rows.join(F.broadcast(facts.filter(hot).select(*key, known)), key, "left")
    rest = marked.filter("_known IS NULL").drop("_known").join(facts.filter(~hot).select(*key, known), key)
    both = marked.filter("_known IS NOT NULL").unionByName(rest)
    return both.select(*rows.columns, *[F.col(f"_known.{c}").alias(c) for c in names])
