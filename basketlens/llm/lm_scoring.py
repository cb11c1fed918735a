"""Language-model scoring with a weighted backoff automaton, learnt from and run over the corpus.

Model. Tokens are words [^ \\t-\\r]+ with A-Z lower-cased, and one end per text. Words seen in
training share the mass left by an absolute discount; the discounted mass is the one unknown
event's. A longer context h of count c interpolates: P(w|h) = (1-l) c(hw)/c + l P(w|shorter h),
l = T/(c+T), T the number of different followers of h in training (Witten-Bell), counted over the
whole corpus with ``heaps=None``; with ``heaps=(a, b)`` the estimate a c^b stands in. Compiled, an
n-gram that was seen is an arc with log10 P(w|h); a context has a failure arc to its shorter
context with log10 l. A text is read left to right: the state is the longest context that was
seen; where it has no arc for the word, failure arcs are followed and their weights added.

Scale. Texts become blocks of bounded size, written once: local word numbers and word hashes
(64 bits). Each block sends the hash and training count of each of its distinct n-grams to a shard
of the hash space; a shard adds them up and sends back only what other blocks changed. A block thus
holds exactly the part of the automaton that its texts can reach, whatever the corpus; nothing is
pruned, nothing is broadcast but four sums. Followers are counted in the same way: a shard names for each
distinct n-gram one of its blocks, which adds one to the n-gram's context; blocks send what they
have for each context to a shard by the context's hash, and get the sums back. A frequent n-gram is one entry per block, so no key is
hot. Number and size of shards follow from the number of tokens.

Defined results: a null or empty text is one token, the end; a null id is kept; without training
texts every token is unknown, with probability 1 in base and score; repeated rows are texts of
their own; texts are scored whole; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, ready, stored

BLOCK_BYTES = 12 << 20  # text of a block
SHARD_ENTRIES = 1 << 20  # n-grams and blocks of a shard, about
HEAPS = (4.0, 0.9)
# Numbers of the end and of the start mark, odd multipliers of the n-gram hash.
END, START, FIRST = 0, 1, 2
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
BLOCK = pa.schema([("block", pa.string()), ("ids", pa.list_(pa.string())), ("train", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())),
                   ("words", pa.binary()), ("tokens", pa.binary())])
BLOCK_DDL = "block string, ids array<string>, train array<boolean>, lengths array<int>, words binary, tokens binary"
ENTRY_DDL = "level int, shard int, block string, keys binary, counts binary"
TOTAL_DDL = "block string, level int, shard int, keys binary, counts binary, firsts binary, v bigint, n bigint, n1 bigint, n2 bigint"
FOLLOW_DDL = "block string, level int, shard int, counts binary"
SCORE_DDL = "id bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def squeeze(array: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes."""
    import zstandard
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def widen(data: bytes, kind: type) -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(widen(data, np.uint64), dtype=np.uint64)


class Builder:
    """Collects texts of one task into a block."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.ids, self.train, self.lengths, self.tokens, self.size = [], [], [], [], 0

    def add(self, key: int | None, train: bool, text: bytes) -> None:
        numbers = self.numbers
        own = [numbers.setdefault(w, len(numbers)) for w in text.translate(LOWER).split()]
        self.ids.append("" if key is None else str(key))  # pandas would make floats of numbers with nulls
        self.train.append(train)
        self.lengths.append(len(own))
        self.tokens.append(np.array(own, dtype=np.uint32))
        self.size += len(text)

    def row(self, name: str) -> pa.RecordBatch:
        from xxhash import xxh3_64_intdigest
        hashes = np.array([xxh3_64_intdigest(w) for w in self.numbers], dtype=np.uint64)
        tokens = np.concatenate(self.tokens) if self.tokens else np.zeros(0, np.uint32)
        values = [[name], [self.ids], [self.train], [self.lengths], [hashes.tobytes()], [squeeze(tokens)]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, BLOCK)], schema=BLOCK)


def build_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    part, number, block = TaskContext.get().partitionId(), 0, Builder()
    for batch in batches:
        for key, train, text in zip(*(batch.column(c).to_pylist() for c in ("id", "train", "text"))):
            block.add(key, bool(train), (text or "").encode())
            if block.size >= BLOCK_BYTES:
                yield block.row(f"{part}-{number}")
                number, block = number + 1, Builder()
    if block.ids:
        yield block.row(f"{part}-{number}")


class Grams:
    """N-grams of a block, by level: sorted distinct hashes, their local training counts, and for
    each position of the text with marks the index of the n-gram that ends there."""

    def __init__(self, row: dict, order: int):
        hashes = np.concatenate([np.array([END, START], dtype=np.uint64), np.frombuffer(row["words"], dtype=np.uint64)])
        lengths = np.asarray(row["lengths"], dtype=np.int64)
        size = lengths + 2  # with both marks
        self.starts = np.cumsum(size) - size
        self.sizes = size
        text = np.empty(int(size.sum()), dtype=np.int32)
        inner = np.ones(len(text), dtype=bool)
        inner[self.starts] = inner[self.starts + size - 1] = False
        text[inner] = widen(row["tokens"], np.uint32).astype(np.int32) + FIRST
        text[self.starts], text[self.starts + size - 1] = START, END
        self.offset = (np.arange(len(text)) - np.repeat(self.starts, size)).astype(np.int32)  # from the text's start mark
        self.is_train = np.repeat(np.asarray(row["train"], dtype=bool), size)
        self.keys, self.counts, self.at = [], [], []
        before = None
        for level in range(1, order + 1):
            own = hashes[text] * MIX[1]
            if before is not None:
                shifted = np.concatenate([np.zeros(1, np.uint64), before[:-1]])
                own = (shifted ^ (shifted >> np.uint64(31))) * MIX[0] + own
            own ^= own >> np.uint64(32)
            there = self.offset >= level - 1
            keys, index = np.unique(own[there], return_inverse=True)
            at = np.full(len(text), -1, dtype=np.int32)
            at[there] = index
            self.keys.append(keys)
            self.at.append(at)
            self.counts.append(np.bincount(index[self.is_train[there]], minlength=len(keys)).astype(np.int64))
            before = own
        self.order = order


def start_key() -> np.uint64:
    with np.errstate(over="ignore"):
        key = np.uint64(START) * MIX[1]
        return key ^ (key >> np.uint64(32))


def shard_cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Ends of the shards' parts of sorted keys, the last shard's left out."""
    return np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.int64)


def heads(grams: Grams, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and shorter form of each n-gram of level k + 1, as indices of level k: one position of
    each n-gram shows them."""
    there = np.nonzero(grams.at[k] >= 0)[0]
    first = np.empty(len(grams.keys[k]), dtype=np.int64)
    first[grams.at[k][there]] = there
    return grams.at[k - 1][first - 1], grams.at[k - 1][first]


def shard_bits(entries: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, entries) / SHARD_ENTRIES))))


def to_shards(order: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(row, order)
                out = []
                for level, (keys, counts) in enumerate(zip(grams.keys, grams.counts), 1):
                    cuts = shard_cuts(keys, bits)
                    for shard, (k, c) in enumerate(zip(np.split(keys, cuts), np.split(counts, cuts))):
                        if len(k):
                            out.append((level, shard, row["block"], pack_keys(k), squeeze(c)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()))],
                                                 names=["level", "shard", "block", "keys", "counts"])
    return run


def add_up(rows: pd.DataFrame) -> pd.DataFrame:
    """Totals of a shard, for each block those that differ from its own counts, and which n-grams seen
    in training it is the first block of (bits, in the order of its own keys); and the shard's sums."""
    level, shard = int(rows["level"].iloc[0]), int(rows["shard"].iloc[0])
    keys = [unpack_keys(k) for k in rows["keys"]]
    counts = [widen(c, np.int64) for c in rows["counts"]]
    distinct, index = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(totals, index, np.concatenate(counts))
    out, start, free = [], 0, totals > 0
    for block, own_keys, own in zip(rows["block"], keys, counts):
        at = index[start:start + len(own)]
        mine, firsts = totals[at], free[at]
        free[at] = False
        start += len(own)
        changed = mine != own
        told = level > 1 and firsts.any()
        if changed.any() or told:
            some = (pack_keys(own_keys[changed]), squeeze(mine[changed])) if changed.any() else (None, None)
            out.append((block, level, shard, *some, squeeze(np.packbits(firsts)) if told else None, 0, 0, 0, 0))
    known = totals[(totals > 0) & (distinct != start_key())] if level == 1 else totals[:0]
    out.append((None, level, shard, None, None, None, len(known), int(known.sum()), int((known == 1).sum()), int((known == 2).sum())))
    return pd.DataFrame(out, columns=[c.split()[0] for c in TOTAL_DDL.split(", ")])


def to_contexts(order: int, bits: int):
    """For each context of a block how many n-grams continue it whose first block this is."""
    def run(blocks: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in ENTRY_DDL.split(", ")]
        if not len(blocks):
            return pd.DataFrame(columns=names)
        grams, out = Grams(blocks.iloc[0], order), []
        for k in range(1, order):
            firsts = np.zeros(len(grams.keys[k]), dtype=bool)
            ends = [0, *shard_cuts(grams.keys[k], bits), len(firsts)]
            for level, shard, data in zip(totals["level"], totals["shard"], totals["firsts"]):
                if level == k + 1:
                    firsts[ends[shard]:ends[shard + 1]] = np.unpackbits(widen(data, np.uint8), count=ends[shard + 1] - ends[shard])
            counts = np.bincount(heads(grams, k)[0][firsts], minlength=len(grams.keys[k - 1])).astype(np.int64)
            cuts = shard_cuts(grams.keys[k - 1], bits)
            out += [(k, shard, blocks["block"].iloc[0], pack_keys(keys), squeeze(own))
                    for shard, (keys, own) in enumerate(zip(np.split(grams.keys[k - 1], cuts), np.split(counts, cuts))) if len(keys)]
        return pd.DataFrame(out, columns=names)
    return run


def add_followers(rows: pd.DataFrame) -> pd.DataFrame:
    """Followers of a shard's contexts, for each block those of its own, in the order of its keys."""
    level, shard = int(rows["level"].iloc[0]), int(rows["shard"].iloc[0])
    keys = [unpack_keys(k) for k in rows["keys"]]
    distinct, index = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(totals, index, np.concatenate([widen(c, np.int64) for c in rows["counts"]]))
    parts = np.split(totals[index], np.cumsum([len(k) for k in keys])[:-1])
    return pd.DataFrame([(b, level, shard, squeeze(p)) for b, p in zip(rows["block"], parts)], columns=[c.split()[0] for c in FOLLOW_DDL.split(", ")])


class Automaton:
    """The part of the model that one block can reach. States are contexts; arcs and failure arcs
    hold log10 weights, index by index of the block's n-grams."""

    def __init__(self, grams: Grams, v: int, n: int, n1: int, n2: int, followers: list[np.ndarray] | None = None, heaps: tuple[float, float] = HEAPS):
        self.g = grams
        c = grams.counts
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        seen = np.where(c[0] > 0, (c[0] - discount) / max(n, 1), discount * v / max(n, 1) if v else 1.0)
        self.base = np.log10((c[0] + 1) / (n + v + 1))
        below = seen
        self.arc, self.fail = [np.log10(seen)], []
        for k in range(1, grams.order):
            context = c[k - 1].astype(np.float64)
            types = followers[k - 1] if followers is not None else heaps[0] * context ** heaps[1]
            share = np.where(context > 0, types / np.maximum(context + types, 1e-300), 1.0)
            head, tail = heads(grams, k)
            inner = (1 - share[head]) * c[k] / np.maximum(context[head], 1) + share[head] * below[tail]
            self.arc.append(np.log10(np.maximum(inner, 1e-300)))
            self.fail.append(np.log10(share))
            below = inner

    def weights(self) -> np.ndarray:
        """log10 weight of reading each position. All positions of the block step at once: the state
        carried into a position is the longest context of the words before it, so it is known."""
        g = self.g
        total = np.zeros(len(g.offset))
        open_ = g.offset >= 1  # start marks are not read
        for k in range(g.order - 1, 0, -1):
            state = np.concatenate([[-1], g.at[k - 1][:-1]])
            able = open_ & (g.at[k] >= 0)
            arc = able & (g.counts[k][g.at[k]] > 0)
            total[arc] += self.arc[k][g.at[k][arc]]
            fails = able & ~arc
            total[fails] += self.fail[k - 1][state[fails]]
            open_ = open_ & ~arc
        total[open_] += self.arc[0][g.at[0][open_]]
        return total


def scorer(order: int, bits: int, sums: tuple[int, int, int, int], heaps: tuple[float, float] | None):
    def run(blocks: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in SCORE_DDL.split(", ")]
        if not len(blocks):
            return pd.DataFrame(columns=names)
        row = blocks.iloc[0]
        grams = Grams(row, order)
        followers = [np.zeros(len(k), dtype=np.float64) for k in grams.keys[:-1]]
        for level, shard, keys, counts in zip(totals["level"], totals["shard"], totals["keys"], totals["counts"]):
            if keys is not None:
                grams.counts[level - 1][np.searchsorted(grams.keys[level - 1], unpack_keys(keys))] = widen(counts, np.int64)
            else:
                ends = [0, *shard_cuts(grams.keys[level - 1], bits), len(grams.keys[level - 1])]
                followers[level - 1][ends[shard]:ends[shard + 1]] = widen(counts, np.int64)
        model = Automaton(grams, *sums, followers) if heaps is None else Automaton(grams, *sums, heaps=heaps)
        read = grams.offset >= 1
        word = grams.at[0]
        add = lambda x: np.add.reduceat(np.where(read, x, 0), grams.starts)
        return pd.DataFrame({"id": pd.array([int(i) if i else None for i in row["ids"]], dtype="Int64"), "train": list(row["train"]),
                             "n_tokens": grams.sizes - 1, "n_known": add((grams.counts[0][word] > 0).astype(np.int64)),
                             "base_score": add(model.base[word]), "score": add(model.weights())}, columns=names)
    return run


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", order: int = 2,
          heaps: tuple[float, float] | None = HEAPS) -> DataFrame:
    """A row per text: ``id, train, n_tokens, n_known, train_tokens, base_score, score``. ``train``
    says which rows are learnt from. Followers are counted if ``heaps`` is None, else estimated."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).cast("string").alias("text"))
    blocks = stored(rows.mapInArrow(build_blocks, BLOCK_DDL), "lm-blocks")
    size = blocks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x + 2))).first()[0] or 0
    bits = shard_bits(size)
    entries = blocks.mapInArrow(to_shards(order, bits), ENTRY_DDL)
    totals = stored(entries.groupBy("level", "shard").applyInPandas(add_up, TOTAL_DDL), "lm-totals")
    sums = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("v", "n", "n1", "n2")]).first()
    known = totals.filter("keys IS NOT NULL").select("block", "level", "shard", "keys", "counts")
    if heaps is None and order > 1:
        firsts = totals.filter("firsts IS NOT NULL").select("block", "level", "shard", "firsts")
        contexts = blocks.groupBy("block").cogroup(firsts.groupBy("block")).applyInPandas(to_contexts(order, bits), ENTRY_DDL)
        followers = contexts.groupBy("level", "shard").applyInPandas(add_followers, FOLLOW_DDL)
        known = known.union(followers.select("block", "level", "shard", F.lit(None).cast("binary").alias("keys"), "counts"))
    told = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(scorer(order, bits, tuple(sums), heaps), SCORE_DDL)
    return told.withColumn("train_tokens", F.lit(sums[1]).cast("bigint"))
