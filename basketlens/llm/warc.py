"""Content-addressed WARC archive: payload bytes once per digest, exact record headers apart.

An archive is two Parquet tables in one folder. ``payloads`` holds each distinct payload once
under its SHA-256; ``records`` holds the exact header text of every record, its digest key and
its id. ``read_archive`` joins them back into whole WARC records and recomputes the digests of
the bytes it finds, so that a damaged payload is an error rather than a wrong record.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest id is the
response and the others revisit it; shorter payloads are always responses. Only (id, digest)
pairs are grouped, so a third of all rows may hold the same page: the group is reduced to one
maximum before the shuffle, and its bytes travel once.

Defined results: null html is the empty payload; a null url is an empty target; rows that repeat
an id and payload are one record each, all of them responses if the id is the largest; a null id
sorts below every other id and is written as an empty page id; an empty table makes an empty
archive; other columns are not archived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import hot_join, ready, scratch, stored

# The digit sets of conv() and of RFC 4648 base32, the WARC version line and date.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: four groups of 40 bits make eight digits each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def one_line(url: Column) -> Column:
    """A line break in a url would forge header lines; it is percent-encoded."""
    return F.regexp_replace(F.regexp_replace(url.cast("string"), "\r", "%0D"), "\n", "%0A")


def record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def header(kind: Column, page: Column, url: Column, length: Column, digest: Column, refers: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    revisit = kind == "revisit"
    return F.concat(
        F.lit(VERSION + END), line("WARC-Type", kind), line("WARC-Record-ID", record_id(page)),
        line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", F.coalesce(url, F.lit(""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_id(refers)), line("WARC-Profile", F.lit(REVISIT)))).otherwise(F.lit("")),
        line("X-Payload-Length", length.cast("string")), line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(length.cast("string"))))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                  min_bytes: int = 0) -> str:
    """Write the two tables below ``path`` and return it."""
    ready(pages.sparkSession)
    body = F.coalesce(F.encode(F.col(body_col), "UTF-8"), F.encode(F.lit(""), "UTF-8"))
    rows = pages.select(F.col(id_col).alias("id"), one_line(F.col(url_col)).alias("url"), body.alias("payload"))
    keyed = rows.select("id", "url", F.sha2("payload", 256).alias("sha256"), base32_sha1(F.col("payload")).alias("sha1"),
                        F.octet_length("payload").cast("bigint").alias("length"))
    # Every distinct digest once, with the bytes of any of its rows: bytes move for one row per digest and task.
    (rows.select(F.sha2("payload", 256).alias("sha256"), "payload").dropDuplicates(["sha256"])
     .write.option("compression", "zstd").parquet(f"{path}/payloads"))
    best = keyed.groupBy("sha256").agg(F.max("id").alias("response_id"))
    shared = F.col("length") >= min_bytes
    told = keyed.join(best, "sha256").select(
        "id", "url", "sha256", "sha1", "length",
        F.when(shared & ~F.col("id").eqNullSafe(F.col("response_id")), "revisit").otherwise("response").alias("kind"),
        "response_id")
    (told.select("id", "sha256", header(F.col("kind"), F.col("id"), F.col("url"), F.col("length"), F.col("sha1"),
                                        F.col("response_id")).alias("header"))
     .write.option("compression", "zstd").parquet(f"{path}/records"))
    return path


def read_archive(spark: SparkSession, path: str, want: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """``id, header`` and what is wanted of the payload that each record (``where`` says which) stands for.

    ``want`` names expressions over column ``payload`` (default: the payload itself). They are
    computed where the bytes lie, before the join, so only what is asked for moves. Spark splits
    the join where many records share one payload.
    """
    records = spark.read.schema("id bigint, sha256 string, header string").parquet(f"{path}/records")
    records = records if where is None else records.filter(where)
    payloads = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads").select(
        "sha256", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload"))
        .otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("binary")).alias("payload"))
    want = want or {"payload": F.col("payload")}
    asked = payloads.select("sha256", F.lit(True).alias("found"), *[c.alias(name) for name, c in want.items()])
    whole = records.join(asked, "sha256", "left")
    present = F.coalesce("found", F.raise_error(F.concat(F.lit("missing payload "), F.col("sha256"))).cast("boolean"))
    return whole.filter(present).select("id", "header", *want)


def records_of(spark: SparkSession, path: str) -> DataFrame:
    """``id, record``: whole WARC records as bytes; a revisit carries no payload, so none is moved to it."""
    gap, bare = F.encode(F.lit(END), "UTF-8"), F.encode(F.lit(""), "UTF-8")
    whole = lambda body: F.concat(F.encode("header", "UTF-8"), gap, body, gap, gap).alias("record")
    revisit = field("WARC-Type") == "revisit"
    headers = spark.read.schema("id bigint, sha256 string, header string").parquet(f"{path}/records").filter(revisit)
    return read_archive(spark, path, where=~revisit).select("id", whole(F.col("payload"))).unionAll(headers.select("id", whole(bare)))


def parsed(records: DataFrame) -> DataFrame:
    """What the bytes of records say: ``id, kind, refers_to, sha1`` from the header, ``payload_bytes,
    payload_digest`` of the payload that is there."""
    told = records.withColumn("header", F.concat(F.substring_index(F.col("record").cast("string"), END + END, 1), F.lit(END)))
    length = field("Content-Length").try_cast("int")
    told = told.withColumn("payload", F.substring("record", F.octet_length("header") + len(END) + 1, length))
    return told.select("id", field("WARC-Type").alias("kind"), page_of(field("WARC-Refers-To")).alias("refers_to"), field("WARC-Payload-Digest").alias("sha1"),
                       F.octet_length("payload").cast("bigint").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))


def field(name: str) -> Column:
    """Value of a header line, null if it is not there."""
    found = F.regexp_extract("header", rf"(?s)(?:^|\r\n){name}: (.*?)\r\n", 1)
    return F.when(found != "", found)


def page_of(ref: Column) -> Column:
    return F.regexp_extract(ref, "<urn:page:(-?[0-9]+)>", 1).try_cast("bigint")


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages to an archive in the shared folder, rebuild its records, and describe each by its
    bytes; a revisit's payload is that of the response to which it refers."""
    spark = pages.sparkSession
    rows = stored(parsed(records_of(spark, write_archive(pages, scratch(spark, "warc"), min_bytes=min_bytes))), "warc-parsed")
    response = rows.filter("kind = 'response'")
    again = rows.filter("kind = 'revisit'").select("id", "kind", "refers_to", "sha1")
    # One row per response that is referred to; a page that a third of all rows repeat is joined by broadcast.
    known = response.groupBy(F.col("id").alias("refers_to"), "sha1").agg(F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"))
    known = stored(known.join(again.groupBy("refers_to", "sha1").agg(F.count("*").alias("times")), ["refers_to", "sha1"]), "warc-known")
    both = response.select("id", "kind", "refers_to", "payload_bytes", "payload_digest").unionByName(hot_join(again, known, ["refers_to", "sha1"], "times").drop("sha1"))
    return both.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")
