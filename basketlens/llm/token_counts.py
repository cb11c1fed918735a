"""Token counts of documents under a unigram model, by dynamic programming over a shared trie.

A text is cut into pre-tokens (words [^ \\t-\\r]+, each behind the space mark of the vocabulary).
The best segmentation of a pre-token is the one of highest total log-probability; its forward
scores depend on the prefix only. Distinct pre-tokens are laid out in sorted order, the
depth-first order of their trie; scores of the current path are kept on a stack, so each shared
prefix is scored once, and the terminal node's token count is stored for the word.

The vocabulary is a sentencepiece file, read on the driver, size checked, and broadcast. BPE files
carry ranks rather than probabilities: piece of rank r gets the Zipf log-probability
-log(r) - log(sum of 1/i). A character outside the vocabulary is spelled in byte tokens, at a
score of 10 below the least for the character, as unigram models do.

Defined results: null and empty texts count 0; ties in score go to fewer tokens; long texts and
words are counted whole; equal rows get equal counts; other columns are left alone.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ready, text_udf

MAX_FILE_BYTES = 64 << 20
CACHED_WORDS = 400_000
UNKNOWN_PENALTY = 10.0  # fixed value: what unigram models subtract from the least score
SPACE = "▁"  # fixed value: the vocabulary's mark of a word's start
KIND = pa.struct([("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])


@dataclass
class Pieces:
    scores: dict[str, float]
    unknown: float
    longest: int


def load(path: str) -> Pieces:
    """Normal pieces of a sentencepiece file with Zipf log-probabilities in the order of their ids."""
    from sentencepiece import SentencePieceProcessor

    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())
             if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return zipf(names)


def zipf(names: list[str]) -> Pieces:
    norm = math.log(sum(1 / r for r in range(1, len(names) + 1)))
    scores = {name: -math.log(rank) - norm for rank, name in enumerate(names, 1)}
    return Pieces(scores, min(scores.values(), default=0.0) - UNKNOWN_PENALTY, max(map(len, names), default=1))


class Counter:
    """Counts the tokens of batches of texts; one per task."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.known: dict[bytes, int] = {}

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        docs = [t.encode().split() for t in texts]
        self.walk(sorted(w.decode() for w in set().union(*docs).difference(self.known)))
        return [(len(d), sum(map(self.known.__getitem__, d))) for d in docs]

    def walk(self, words: list[str]) -> None:
        """Depth k of the path holds the best score of the word's first k characters and the number
        of tokens it takes; depth 0 is the root, depth 1 the space mark that all words share."""
        scores, longest, unknown = self.p.scores, self.p.longest, self.p.unknown
        best, count = [0.0], [0]
        before = ""
        for word in words:
            text = SPACE + word
            common, limit = 0, min(len(before), len(text), len(best) - 1)
            while common < limit and before[common] == text[common]:
                common += 1
            del best[common + 1:], count[common + 1:]
            for end in range(common + 1, len(text) + 1):
                top, fewest = -math.inf, 0
                for start in range(max(0, end - longest), end):
                    score = scores.get(text[start:end])
                    if score is not None:
                        score += best[start]
                        if score > top or score == top and count[start] + 1 < fewest:
                            top, fewest = score, count[start] + 1
                if text[end - 1] not in scores and (score := best[end - 1] + unknown) > top:
                    top, fewest = score, count[end - 1] + len(text[end - 1].encode())
                best.append(top)
                count.append(fewest)
            self.known[word.encode()] = count[-1]
            before = text


def count_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """All rows and columns, and a struct ``out``: ``n_pretokens`` and ``n_tokens``. An ``out`` that
    is there already is replaced."""
    shared = ready(docs.sparkSession).sparkContext.broadcast(vars(load(path)))

    def make():
        return Counter(Pieces(**shared.value)).count

    return docs.withColumn(out, text_udf(make, KIND)(F.col(text).cast("string")))
