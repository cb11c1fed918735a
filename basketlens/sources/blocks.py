"""One pass over text files, block by block: a digest of their bytes, and where records begin.

A block is what one task reads of a file: whole lines up to a line feed. The digest is the
remainder of the file's bytes, taken as one number in base 256, by two primes. Remainders of
neighbouring blocks merge by a power of the base, so it does not depend on how files were split,
and files merge in the same way. Whether a line begins inside a quoted field depends on all lines
before it; a block is scanned for both cases, and a pass over one row per block then tells which
one holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..session import prepare

# Two primes below 2^61 whose halves (p-1)/2 are prime too, so that powers of 256
# repeat only after more bytes than a file has.
PRIMES = (2305843009213691579, 2305843009213690799)
BOM = b"\xef\xbb\xbf"
PACKED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")  # read as one block, size unknown
HEADER_CHARS = 1 << 20

BLOCK = pa.schema([("path", pa.string()), ("start", pa.int64()), ("file_bytes", pa.int64()), ("size", pa.int64()),
                   ("rest0", pa.int64()), ("rest1", pa.int64()), ("breaks", pa.bool_()), ("from_out", pa.bool_()), ("from_in", pa.bool_()), ("header", pa.string())])
FILE = "path string, bytes long, rest0 long, rest1 long, digest string, header string, breaks boolean, starts array<long>, inside array<boolean>"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, start, file_bytes, line``: bytes between line feeds, in order inside a block."""
    meta = lambda name: F.col(f"_metadata.{name}")
    return prepare(spark).read.option("lineSep", "\n").text(path).select(
        meta("file_path").alias("path"), meta("file_block_start").alias("start"), meta("file_size").alias("file_bytes"), F.col("value").cast("binary").alias("line"))


def ends_inside(line: bytes, inside: bool) -> bool:
    """Does a quoted field stay open at the line's end? A field is quoted if a quote is its first
    byte; a doubled quote is data; what follows the closing quote runs to the next comma."""
    at = 0
    while True:
        if inside:
            at = line.find(b'"', at)
            while at >= 0 and line[at + 1:at + 2] == b'"':
                at = line.find(b'"', at + 2)
            if at < 0:
                return True
            inside = False
        elif line[at:at + 1] == b'"':
            inside, at = True, at + 1
            continue
        at = line.find(b",", at)
        if at < 0:
            return False
        at += 1


def merge(left: tuple[int, int], right: tuple[int, int], size: int) -> tuple[int, int]:
    """Remainders of two texts side by side; ``size`` bytes are on the right."""
    return tuple((a * pow(256, size, p) + b) % p for a, b, p in zip(left, right, PRIMES))


def rests(data: bytes) -> tuple[int, int]:
    number = int.from_bytes(data, "big")
    return tuple(number % p for p in PRIMES)


class Scan:
    """What is known of a block so far."""

    def __init__(self, path: str, start: int, file_bytes: int):
        self.path, self.start, self.file_bytes = path, start, file_bytes
        self.size, self.rest, self.breaks, self.out, self.inn = 0, (0, 0), False, False, True
        self.header: list[bytes] | None = [] if start == 0 else None
        self.heading = start == 0

    def add(self, found: list[bytes]) -> None:
        data = b"\n".join(found) + b"\n"
        self.rest = merge(self.rest, rests(data), len(data))
        self.size += len(data)
        quoted = b'"' in data
        self.breaks |= self.out or data.count(b"\r") != data.count(b"\r\n")
        if self.heading or quoted:
            for line in found:
                if b'"' in line:
                    self.out, self.inn = ends_inside(line, self.out), ends_inside(line, self.inn)
                    self.breaks |= self.out
                if self.heading and (self.header or line.strip(BOM + b" \t\r")):
                    self.header.append(line)
                    self.heading = self.out and sum(map(len, self.header)) < HEADER_CHARS

    def row(self) -> tuple:
        header = None if self.header is None else b"\n".join(self.header).removeprefix(BOM).removesuffix(b"\r").decode("utf-8", "replace")
        return (self.path, self.start, self.file_bytes, self.size, *self.rest, self.breaks, self.out, self.inn, header)


def pieces(batches: Iterator[pa.RecordBatch], extra: int) -> Iterator[tuple[tuple, list[bytes]]]:
    """Runs of lines of one block: its path, start (and ``extra`` more columns), and the lines."""
    for batch in batches:
        if not batch.num_rows:
            continue
        code = pc.dictionary_encode(batch.column(0)).indices.to_numpy(zero_copy_only=False)
        start = batch.column(1).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(start) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield tuple(batch.column(c)[a].as_py() for c in range(2 + extra)), batch.column(batch.num_columns - 1).slice(a, b - a).to_pylist()


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = None
    rows = lambda b: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(b.row(), BLOCK)], schema=BLOCK)
    for (path, start, size), found in pieces(batches, 1):
        if block is None or (block.path, block.start) != (path, start):
            if block is not None:
                yield rows(block)
            block = Scan(path, start, size)
        block.add(found)
    if block is not None:
        yield rows(block)


def whole(blocks: pd.DataFrame) -> pd.DataFrame:
    """One file from its blocks. The file's size tells whether its last line ends in a line feed,
    and whether a byte order mark, which the reader hides, stands before the first."""
    blocks = blocks.sort_values("start")
    path, file_bytes = blocks.path.iloc[0], int(blocks.file_bytes.iloc[0])
    total, rest, inside, states = 0, (0, 0), False, []
    for b in blocks.itertuples():
        rest = merge(rest, (int(b.rest0), int(b.rest1)), int(b.size))
        total += int(b.size)
        states.append(inside)
        inside = bool(b.from_in if inside else b.from_out)
    if not path.endswith(PACKED):
        missing = file_bytes - total
        if missing > 0:  # the mark
            rest = merge(rests(BOM), rest, total)
            total += len(BOM)
        if file_bytes < total:  # no last line feed
            rest = tuple((r - 10) * pow(256, -1, p) % p for r, p in zip(rest, PRIMES))
            total -= 1
    digest = "{:016x}{:016x}".format(*rest)
    return pd.DataFrame([{"path": path, "bytes": total, "rest0": rest[0], "rest1": rest[1], "digest": digest, "header": blocks.header.iloc[0] or "",
                          "breaks": bool(blocks.breaks.any() or any(states)), "starts": blocks.start.astype(int).tolist(), "inside": states}])


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file that has bytes (see FILE), from one pass over its lines and a row per block."""
    blocks = lines(spark, path).mapInArrow(scan, from_arrow_schema(BLOCK))
    return blocks.groupBy("path").applyInPandas(whole, FILE)


def together(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("path")
    rest, total = (0, 0), 0
    for r in rows.itertuples():
        rest = merge(rest, (int(r.rest0), int(r.rest1)), int(r.bytes))
        total += int(r.bytes)
    return pd.DataFrame([{"name": rows.name.iloc[0], "files": len(rows), "bytes": total, "digest": "{:016x}{:016x}".format(*rest)}])


def folders(found: DataFrame) -> DataFrame:
    """``name, files, bytes, digest`` per folder: its files side by side, by name. A row a file is moved."""
    name = F.element_at(F.split("path", "/"), -2)
    return found.select(name.alias("name"), "path", "rest0", "rest1", "bytes").groupBy("name").applyInPandas(together, "name string, files long, bytes long, digest string")


RECORD = pa.schema([("path", pa.string()), ("start", pa.int64()), ("seq", pa.int64()), ("kind", pa.string()), ("text", pa.binary())])
OUT_BYTES = 4 << 20


def cutter(states: dict[str, dict[int, bool]]):
    """Cuts the lines of blocks into records. A block's first lines may end a record that an earlier block
    began (``head``), and its last one may stay open (``tail``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, here, open_, seq, kind, inside = [], 0, None, [], 0, "whole", False

        def flush() -> pa.RecordBatch:
            nonlocal rows, size
            cols = list(zip(*rows)) if rows else [[] for _ in RECORD]
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, RECORD)], schema=RECORD)
            rows, size = [], 0
            return batch

        def close(last: str) -> None:
            nonlocal open_, seq, kind, size
            text = b"\n".join(open_)
            if last != "whole" or text.strip(b" \t\r"):  # blank lines are no records
                rows.append((*here, seq, last, text))
                size += len(text)
                seq += 1
            open_, kind = [], "whole"

        for place, found in pieces(batches, 0):
            if place != here:
                if open_:
                    close("tail" if kind == "whole" else "head")
                here, seq = place, 0
                if place[1] not in states[place[0]]:
                    raise RuntimeError(f"{place[0]} is split in another way than when it was scanned")
                inside = states[place[0]][place[1]]
                kind = "head" if inside else "whole"
            for line in found:
                open_.append(line)
                if b'"' in line:
                    inside = ends_inside(line, inside)
                if not inside:
                    close(kind)
            if size >= OUT_BYTES:
                yield flush()
        if open_:
            close("tail" if kind == "whole" else "head")
        yield flush()
    return run


def records(spark: SparkSession, path: str | list[str], broken: list) -> DataFrame:
    """``path, start, seq, text`` of the records of files with line breaks inside quotes, read in as many tasks as
    they have blocks. ``broken`` holds their rows of ``files``. Only the pieces of records that cross blocks, at most
    two a block, are brought together."""
    states = {r.path: dict(zip(r.starts, r.inside)) for r in broken}
    # Not a condition on the file alone: that would prune files and so change how the rest is split.
    wanted = F.when(F.octet_length("line") >= 0, F.xxhash64("path")).isin([r.hash for r in broken])
    cut = lines(spark, path).filter(wanted).select("path", "start", "line").mapInArrow(cutter(states), from_arrow_schema(RECORD))
    parts = cut.filter("kind <> 'whole'").withColumn("chain", F.expr("sum(CAST(kind = 'tail' AS BIGINT)) OVER (PARTITION BY path ORDER BY start, seq)"))
    joined = (parts.groupBy("path", "chain").agg(F.sort_array(F.collect_list(F.struct("start", "seq", "text"))).alias("p"))
              .select("path", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["seq"].alias("seq"),
                      F.expr("array_join(transform(p, x -> CAST(x.text AS STRING)), '\\n')").alias("text")))
    everything = cut.filter("kind = 'whole'").select("path", "start", "seq", F.col("text").cast("string").alias("text")).unionAll(joined)
    bare = F.regexp_replace("text", "\r$", "")
    first = (F.col("start") == 0) & (F.col("seq") == 0)
    return everything.withColumn("text", F.when(first, F.regexp_replace(bare, "^﻿", "")).otherwise(bare))
