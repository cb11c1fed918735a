"""BPE encoding by a walk over the trie of distinct words, and decoding.

A word's encoding is known from its last token: a vocabulary entry that is a suffix of the word
and that may stand behind the last token of the rest. Exactly one suffix qualifies, so the last
token is a state of the word's trie node. Distinct words are laid out in sorted order, which is
the depth-first order of their trie; the walk keeps the states of the current path only (the last
token and where it begins, from which a terminal node follows back), and a prefix that many words
share is encoded once. Whether two tokens may stand side by side is read
off their merge trees: no pair of symbols along the seam may have a merge that would have come
before the merges that built the two tokens. Training gives a merged token a higher rank than its
parts, on which this rests; ``load`` checks it and each token's own encoding.

Texts are prepared as the tokenizer file says: special tokens are cut out of the raw text, then
NFC, white space to one blank, lower case, the split pattern, bytes as printable characters. The
file is read on the driver, its size is checked, and its tables are broadcast.

Defined results: null and empty texts have no tokens and decode to the empty text; very long texts
and words are encoded whole; equal rows get equal tokens; other columns are left alone.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from struct import pack

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import from_arrow_type

from .common import ready, text_udf

MAX_FILE_BYTES = 64 << 20  # a tokenizer file beyond this is refused rather than broadcast
CACHED_WORDS = 200_000  # encodings a task keeps between batches before it starts afresh
# The Unicode White_Space class, which the normalizer's and the split pattern's \s mean.
WHITE = r"\p{White_Space}"
KIND = pa.struct([("ids", pa.binary()), ("n_tokens", pa.int64())])
DIGESTS = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
NO_RANK = 1 << 60


def byte_symbols() -> dict[int, str]:
    """Printable stand-in of each byte: itself where printable in Latin-1, else the next free code from 256 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


@dataclass
class Vocabulary:
    """What a task needs of a tokenizer file."""

    ids: dict[str, int]
    merges: dict[tuple[int, int], tuple[int, int]]  # pair of ids -> (rank, id)
    suffix: str
    pattern: str
    special: dict[str, int]
    longest: int = 0
    whole: set[int] = field(default_factory=set)  # tokens that encode to themselves
    parts: dict[int, tuple[int, int, int]] = field(default_factory=dict)  # id -> (rank, left, right)
    seams: dict[tuple[int, int], bool] = field(default_factory=dict)

    def prepare(self) -> Vocabulary:
        self.parts = {made: (rank, a, b) for (a, b), (rank, made) in self.merges.items()}
        rank = lambda t: self.parts.get(t, (-1,))[0]
        if any(r <= max(rank(a), rank(b)) for r, a, b in self.parts.values()):
            raise ValueError("a merge comes before the merges that make its parts")
        self.longest = max(len(t.removesuffix(self.suffix)) for t in self.ids)
        self.whole = {t for t in self.ids.values() if t not in self.parts or self.plain(self.leaves(t)) == [t]}
        return self

    def leaves(self, token: int) -> list[int]:
        if token not in self.parts:
            return [token]
        _, a, b = self.parts[token]
        return self.leaves(a) + self.leaves(b)

    def plain(self, symbols: list[int]) -> list[int]:
        """The definition: merge the pair of least rank, leftmost first, until none is left."""
        while len(symbols) > 1:
            rank, at = min((self.merges.get(p, (NO_RANK,))[0], i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if rank == NO_RANK:
                break
            symbols = [*symbols[:at], self.merges[symbols[at], symbols[at + 1]][1], *symbols[at + 2:]]
        return symbols

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Symbols along one edge of a token's merge tree, each with the rank at which it is merged away."""
        found, until = [(token, NO_RANK)], NO_RANK
        while token in self.parts:
            until, token = self.parts[token][0], self.parts[token][side]
            found.append((token, until))
        return found

    def fits(self, left: int, right: int) -> bool:
        """May ``right`` follow ``left``? Equal ranks: the leftmost merge wins."""
        key = (left, right)
        if (known := self.seams.get(key)) is None:
            heads = self.edge(right, 1)
            known = self.seams[key] = not any(
                (found := self.merges.get((a, b))) is not None and found[0] < gone_a and found[0] <= gone_b
                for a, gone_a in self.edge(left, 2) for b, gone_b in heads)
        return known


def load(path: str) -> Vocabulary:
    """Read a word-level BPE file: byte symbols, an end-of-word suffix, a split pattern."""
    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    ids = model["vocab"]
    pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(model["merges"])}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return Vocabulary(ids, merges, model["end_of_word_suffix"], pattern.replace(r"\s", WHITE), special).prepare()


class Encoder:
    """Encodes batches of texts; one per task."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        self.split = regex.compile(v.pattern).findall
        self.white = regex.compile(WHITE + "+").split
        self.cut = regex.compile("(" + "|".join(map(regex.escape, v.special)) + ")") if v.special else None
        self.symbols = byte_symbols()
        self.inner = {t: i for t, i in v.ids.items() if i in v.whole}  # tokens within a word
        self.final = {t.removesuffix(v.suffix): i for t, i in self.inner.items() if t.endswith(v.suffix)}
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, bytes] = {}  # word of the split pattern -> packed ids
        self.chunks: dict[str | bytes, bytes] = {t.encode(): pack("<I", i) for t, i in self.v.special.items()}

    def chunks_of(self, text: str) -> list[str | bytes]:
        """What lies between white space, and special tokens as bytes. No word of the pattern and
        no character that normalization composes reaches across white space."""
        found: list[str | bytes] = []
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                found.append(part.encode())
            elif any(c in part for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split() only
                found += self.white(part)
            else:
                found += part.split()
        return found

    def pieces(self, chunk: str) -> list[str]:
        flat = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ")  # no final sigma
        return self.split(flat.lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text, packed as little-endian unsigned 32-bit integers."""
        if len(self.chunks) > CACHED_WORDS:
            self.forget()
        docs = [self.chunks_of(t) for t in texts]
        new = {c: self.pieces(c) for c in set().union(*docs).difference(self.chunks)}
        self.walk(sorted(set().union(*new.values()).difference(self.words)))
        for chunk, pieces in new.items():
            self.chunks[chunk] = b"".join([self.words[p] for p in pieces])
        return [b"".join(map(self.chunks.__getitem__, chunks)) for chunks in docs]

    def walk(self, words: list[str]) -> None:
        """Visit the trie of sorted words depth first. Depth k of the path holds the last token of
        the word's first k symbols and where it begins; a terminal node follows these back."""
        inner, final, longest, fits, seams = self.inner, self.final, self.v.longest, self.v.fits, self.v.seams
        last, begin = [-1], [0]
        before = ""
        for word in words:
            text = word if word.isascii() and word.isprintable() else "".join(map(self.symbols.__getitem__, word.encode()))
            size = len(text)
            common = 0
            limit = min(len(before), size - 1, len(last) - 1)
            while common < limit and before[common] == text[common]:
                common += 1
            del last[common + 1:], begin[common + 1:]
            for end in range(common + 1, size + 1):
                names = inner if end < size else final
                # The last token of the shorter prefix, one symbol longer, is the likeliest.
                for start in (begin[end - 1], *range(max(0, end - longest), end)):
                    token = names.get(text[start:end])
                    if token is not None:
                        if start == 0:
                            break
                        known = seams.get((last[start], token))
                        if fits(last[start], token) if known is None else known:
                            break
                else:
                    raise ValueError(f"no encoding of {text[:end]!r}")
                if end < size:
                    last.append(token)
                    begin.append(start)
            ids = [token]
            while start:
                ids.append(last[start])
                start = begin[start]
            self.words[word] = pack(f"<{len(ids)}I", *reversed(ids))
            before = text


class Decoder:
    """The file names no decoder, so the tokens' own strings are joined by blanks; ids the file does not
    know are left out."""

    def __init__(self, vocabulary: Vocabulary):
        self.names = {i: t for t, i in [*vocabulary.ids.items(), *vocabulary.special.items()]}

    def decode(self, packed: bytes) -> str:
        ids, names = memoryview(packed).cast("I"), self.names
        try:
            return " ".join(map(names.__getitem__, ids))
        except KeyError:
            return " ".join([names[i] for i in ids if i in names])


def vocabulary_of(spark: SparkSession, path: str):
    """Broadcast fields of the vocabulary; their size is bounded by the file's."""
    return ready(spark).sparkContext.broadcast(vars(load(path)))


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "bpe") -> DataFrame:
    """All rows and columns, and a struct ``out``: ``ids`` (little-endian unsigned 32-bit
    integers) and ``n_tokens``. An ``out`` that is there already is replaced."""
    shared = vocabulary_of(docs.sparkSession, path)

    def make():
        encoder = Encoder(Vocabulary(**shared.value))
        return lambda texts: [(ids, len(ids) // 4) for ids in encoder.encode(texts)]

    return docs.withColumn(out, text_udf(make, KIND)(F.col(text).cast("string")))


def decode(rows: DataFrame, path: str, ids: str, out: str = "decoded") -> DataFrame:
    """All rows and columns, and ``out``: the text of packed ids."""
    shared = vocabulary_of(rows.sparkSession, path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(Vocabulary(**shared.value))
        for batch in batches:
            yield pa.array([decoder.decode(b or b"") for b in batch.to_pylist()], pa.string())

    return rows.withColumn(out, F.arrow_udf(run, returnType=from_arrow_type(pa.string())).asNondeterministic()(F.col(ids)))


def ids_of(packed: bytes) -> list[int]:
    return list(memoryview(packed).cast("I"))


def digests(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """Counts and digests of tokens and decoded text beside the columns ``keep``. Texts are encoded and
    their ids decoded in the same task, so neither ids nor decoded texts leave it."""
    shared = vocabulary_of(docs.sparkSession, path)
    keep = keep or ["doc_id"]

    def make():
        vocabulary = Vocabulary(**shared.value)
        encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)
        return lambda texts: [(len(ids) // 4, sha256(ids).hexdigest(), sha256(decoder.decode(ids).encode()).hexdigest()) for ids in encoder.encode(texts)]

    told = docs.select(*keep, text_udf(make, DIGESTS)(F.col("text").cast("string")).alias("_told"))
    return told.select(*keep, *[F.col(f"_told.{c.name}").alias(c.name) for c in DIGESTS])
