"""SentencePiece BPE encoding and decoding by a table of distinct chunks.

No piece of the vocabulary holds the whitespace mark behind another character, so no merge reaches
across the start of a marked word. ``load`` checks this, and which characters occur in no longer
piece at all: these end a chunk too. A text is cut into chunks (marks and the characters
up to the next mark); each distinct chunk enters a table once, is segmented once, and the ids of a
text are the table's entries joined by position. Segmentation merges the adjacent pair whose piece
has the highest score, leftmost first, until no pair is a piece; a character that is no piece is
spelled in byte pieces. The table belongs to a task and outlives its batches; it starts afresh
beyond ``TABLE_CHUNKS`` entries, which changes nothing but the work.

The vocabulary is a sentencepiece file, read on the driver, its size checked, and broadcast. The
method rests on an identity normalizer with a mark before the text; ``load`` compares a set of odd
texts with the library and refuses a file that is read otherwise.

Defined results: null and empty texts have no ids and decode to the empty text; very long texts and
words are encoded whole (a word costs n log n); equal rows get equal ids; a mark that stands in the
text itself decodes to a blank, as in the library; ids outside the vocabulary decode to nothing; an
existing ``out`` column is replaced and other columns are left alone; an empty table stays empty.
"""

from __future__ import annotations

import codecs
import heapq
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import groupby
from struct import pack

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import from_arrow_type

from .common import ready, text_udf

MAX_FILE_BYTES = 64 << 20  # a vocabulary file beyond this is refused rather than broadcast
TABLE_CHUNKS = 400_000  # distinct chunks a task's table holds before it starts afresh
SHORT = 48  # symbols up to which the best pair is searched rather than kept in a heap
NO_PIECE = float("-inf")
MARK = "▁"  # fixed value: the vocabulary's mark for a blank
KIND = pa.struct([("ids", pa.binary()), ("n_tokens", pa.int64())])
DIGESTS = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
PROBES = ["", " ", "a", "  two  blanks ", "\tx\n\ny \r", "ﬁ Ⅳ é é", "日本語 \U0001f600", "▁x▁▁y", "\x00 <s></s><unk> <0x0A>", *[" " * n + "end" for n in range(3, 40)]]


@dataclass
class Pieces:
    """What a task needs of a vocabulary file."""

    scores: dict[str, float]  # pieces that merges may make
    ids: dict[str, int]
    bytes_at: list[int]  # id of each byte's piece
    spelled: list[bytes]  # what each id decodes to, marks as blanks
    control: set[int]
    unmarked: set[int]  # byte pieces and the unknown piece
    alone: str  # characters in no longer piece


def load(path: str) -> Pieces:
    from sentencepiece import SentencePieceProcessor

    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    model = SentencePieceProcessor(model_file=path)
    scores, ids, spelled, control, unmarked, bytes_at = {}, {}, [], set(), set(), [-1] * 256
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_at[int(name[1:-1], 16)] = i
            unmarked.add(i)
            spelled.append(bytes([int(name[1:-1], 16)]))
        elif model.is_control(i):
            control.add(i)
            spelled.append(b"")
        elif model.is_unknown(i):
            unmarked.add(i)
            spelled.append(model.decode([i]).encode())
        else:
            scores[name], ids[name] = model.get_score(i), i
            spelled.append(name.replace(MARK, " ").encode())
    if min(bytes_at) < 0 or any(MARK in name.lstrip(MARK) for name in scores):
        raise ValueError(f"{path} lacks byte pieces, or has pieces that cross a mark")
    inner = set("".join(n for n in scores if len(n) > 1))
    pieces = Pieces(scores, ids, bytes_at, spelled, control, unmarked, "".join(c for c in "\n\t\r" if c not in inner))
    mine = Encoder(pieces)
    if any(ids_of(mine.encode([t])[0]) != model.encode(t) or mine.decode(model.encode(t)) != model.decode(model.encode(t)) for t in PROBES):
        raise ValueError(f"{path} normalizes or merges in a way that is not supported")
    return pieces


def ids_of(packed: bytes) -> list[int]:
    return list(memoryview(packed).cast("I"))


def each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


class Encoder:
    """Encodes batches of texts and decodes ids; one per task."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.table: dict[str, bytes] = {}
        ends = re.escape(pieces.alone)
        self.cut = re.compile(f"{MARK}+[^{MARK}{ends}]*|[^{MARK}{ends}]+" + (f"|[{ends}]+" if ends else "")).findall
        codecs.register_error("each_byte", each_byte)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        if len(self.table) > TABLE_CHUNKS:
            self.table.clear()
        docs = [self.cut(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        for chunk in set().union(*docs).difference(self.table):
            self.table[chunk] = self.packed(self.segment(chunk))
        return [b"".join(map(self.table.__getitem__, chunks)) for chunks in docs]

    def packed(self, symbols: list[str]) -> bytes:
        ids, found = self.p.ids, []
        for symbol in symbols:
            if (known := ids.get(symbol)) is not None:
                found.append(known)
            else:
                found += [self.p.bytes_at[b] for b in symbol.encode()]
        return pack(f"<{len(found)}I", *found)

    def segment(self, chunk: str) -> list[str]:
        if chunk in self.p.scores and len(chunk) == 1:
            return [chunk]
        return self.by_search(list(chunk)) if len(chunk) <= SHORT else self.by_heap(list(chunk))

    def by_search(self, symbols: list[str]) -> list[str]:
        get = self.p.scores.get
        pairs = [get(a + b, NO_PIECE) for a, b in zip(symbols, symbols[1:])]
        while pairs and (best := max(pairs)) != NO_PIECE:
            at = pairs.index(best)
            symbols[at] += symbols.pop(at + 1)
            del pairs[at]
            if at:
                pairs[at - 1] = get(symbols[at - 1] + symbols[at], NO_PIECE)
            if at < len(pairs):
                pairs[at] = get(symbols[at] + symbols[at + 1], NO_PIECE)
        return symbols

    def by_heap(self, symbols: list[str]) -> list[str]:
        """The same for long chunks: open pairs in a heap, neighbours in a linked list."""
        get, size = self.p.scores.get, len(symbols)
        left, right = list(range(-1, size - 1)), list(range(1, size + 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < size and (score := get(symbols[a] + symbols[b])) is not None:
                heapq.heappush(heap, (-score, a, symbols[a], symbols[b]))
        for i in range(size - 1):
            offer(i, i + 1)
        while heap:
            _, a, one, two = heapq.heappop(heap)
            b = right[a]
            if symbols[a] != one or b >= size or symbols[b] != two:  # merged away meanwhile
                continue
            symbols[a], symbols[b] = one + two, ""
            right[a] = right[b]
            if right[a] < size:
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [s for s in symbols if s]

    def decode(self, ids: list[int]) -> str:
        """Pieces side by side, the mark before the text left out, bytes read as UTF-8."""
        size, spelled, control = len(self.p.spelled), self.p.spelled, self.p.control
        if ids and (min(ids) < 0 or max(ids) >= size):
            ids = [i for i in ids if 0 <= i < size]
        runs = [ids] if control.isdisjoint(ids) else [list(run) for hidden, run in groupby(ids, control.__contains__) if not hidden]
        data = [b"".join(map(spelled.__getitem__, run)) for run in runs]  # bytes are not read across control pieces
        if runs and runs[0] and runs[0][0] not in self.p.unmarked and data[0][:1] == b" ":
            data[0] = data[0][1:]
        return "".join([d.decode("utf-8", "each_byte") for d in data])


def vocabulary_of(spark: SparkSession, path: str):
    """Broadcast fields of the vocabulary; their size is bounded by the file's."""
    return ready(spark).sparkContext.broadcast(vars(load(path)))


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "pieces") -> DataFrame:
    """All rows and columns, and a struct ``out``: ``ids`` (little-endian unsigned 32-bit
    integers) and ``n_tokens``."""
    shared = vocabulary_of(docs.sparkSession, path)

    def make():
        encoder = Encoder(Pieces(**shared.value))
        return lambda texts: [(ids, len(ids) // 4) for ids in encoder.encode(texts)]

    return docs.withColumn(out, text_udf(make, KIND)(F.col(text).cast("string")))


def decode(rows: DataFrame, path: str, ids: str, out: str = "decoded") -> DataFrame:
    """All rows and columns, and ``out``: the text of packed ids. Null ids decode to the empty text."""
    shared = vocabulary_of(rows.sparkSession, path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(Pieces(**shared.value))
        for batch in batches:
            yield pa.array([encoder.decode(ids_of(b or b"")) for b in batch.to_pylist()], pa.string())

    return rows.withColumn(out, F.arrow_udf(run, returnType=from_arrow_type(pa.string())).asNondeterministic()(F.col(ids)))


def digests(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """Counts and digests of ids and decoded text beside the columns ``keep``. Texts are encoded and
    their ids decoded in the same task, so neither ids nor decoded texts leave it."""
    shared = vocabulary_of(docs.sparkSession, path)

    def make():
        encoder = Encoder(Pieces(**shared.value))
        names = [str(i) for i in range(len(encoder.p.spelled))]

        def rows(texts: list[str]) -> list[tuple]:
            found = []
            for packed in encoder.encode(texts):
                ids = ids_of(packed)
                shown = ",".join(map(names.__getitem__, ids))
                found.append((len(ids), sha256(shown.encode()).hexdigest(), sha256(encoder.decode(ids).encode()).hexdigest()))
            return found
        return rows

    told = docs.select(*(keep or ["doc_id"]), text_udf(make, DIGESTS)(F.col("text").cast("string")).alias("_told"))
    return told.select(*(keep or ["doc_id"]), *[F.col(f"_told.{c.name}").alias(c.name) for c in DIGESTS])
