"""Language identification: known words by log frequency, other words by ever shorter n-grams.

Learning counts words per language over labelled texts, and the character n-grams of those words.
A word that was seen ``min_count`` times or more scores the log of its smoothed frequency in each
language. Any other word is scored by its character n-grams of the greatest length of which at
least one is known, from ``longest`` characters down to one; a word with no known character says
nothing. A text's score per language is the sum over its words; the prediction is the language of
the greatest sum, ``score`` its probability under equal priors, the sums divided by ``temper``
times the root of the number of words.

Labelled texts are learnt from a bounded sample: about ``max_texts`` texts of each language, picked
by a hash of id and text, so the model is bounded in size, is learnt in Spark by grouped
counts, and is broadcast behind a check of its size. Prediction reads the text only.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where nothing
was learnt; ties go to the language that sorts first; texts are read whole; equal rows get equal
results; labels that are null teach nothing; other columns are left alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ready, stored, text_udf

UNKNOWN = "und"
MAX_TEXTS = 2000  # labelled texts per language that are learnt from
MAX_LANGUAGES = 500
MAX_ENTRIES = 4_000_000  # of the model, words and n-grams together; 12 bytes and a float per language each
CACHED_WORDS = 300_000
WORD = r"\p{L}+"
KIND = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def words(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def sample(docs: DataFrame, id_col: str, text: str, lang: str, max_texts: int) -> DataFrame:
    """``lang, text`` of about max_texts labelled texts per language: all of a language that has no
    more, else those whose hash falls in the share that makes max_texts. One pass counts, none shuffles texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return rows.select("lang", "text")
    share = F.create_map(*[F.lit(x) for lang_n, n in counts.items() for x in (lang_n, min(1.0, max_texts / n))])
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rows.filter(place < share[F.col("lang")]).select("lang", "text")


def grams(word: Column, longest: int) -> Column:
    """Character n-grams of <word>, marks included, of 1 to ``longest`` characters."""
    marked = F.concat(F.lit("<"), word, F.lit(">"))
    size = F.length(marked)
    each = [F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i, n=n: F.substring(marked, i, F.lit(n))))
            .otherwise(F.array().cast("array<string>")) for n in range(1, longest + 1)]
    return F.concat(*each)


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", longest: int = 4,
          min_count: int = 2, max_texts: int = MAX_TEXTS) -> dict:
    """The model: languages, and known words and n-grams with log frequencies per language."""
    ready(docs.sparkSession)
    seen = sample(docs, id_col, text, lang, max_texts).select("lang", F.explode(words(F.col("text"))).alias("word"))
    counts = stored(seen.groupBy("word", "lang").agg(F.count("*").alias("n")), "words")
    parts = counts.select("lang", "n", F.explode(grams(F.col("word"), longest)).alias("word"))
    both = counts.select(F.lit(True).alias("whole"), "word", "lang", "n").unionByName(
        parts.groupBy("word", "lang").agg(F.sum("n").alias("n")).select(F.lit(False).alias("whole"), "word", "lang", "n"))
    entries = both.groupBy("whole", "word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("n"))
    totals = {(r["whole"], r["size"], r["lang"]): r["n"] for r in both.groupBy(
        "whole", F.when(F.col("whole"), 0).otherwise(F.length("word")).alias("size"), "lang").agg(F.sum("n").alias("n")).limit((longest + 1) * MAX_LANGUAGES + 1).collect()}
    langs = sorted({k[2] for k in totals})
    known = stored(entries.filter(F.col("n") >= min_count).select(
        "whole", "word", F.array(*[F.coalesce(F.col("by")[F.lit(x)], F.lit(0)).cast("bigint") for x in langs] or [F.lit(0).cast("bigint")]).alias("by")), "language-model")
    if (size := known.count()) > MAX_ENTRIES:
        raise ValueError(f"a model of {size} entries is too large to broadcast; raise min_count or lower max_texts")
    table = known.toArrow() if size else None
    model: dict = {"langs": langs, "longest": longest, "words": {}, "grams": {}}
    if table is None or not langs:
        return model
    whole = np.array(table["whole"].to_pylist(), dtype=bool)
    names = np.array(table["word"].to_pylist(), dtype=object)
    by = np.array(table["by"].combine_chunks().flatten().to_numpy(), dtype=np.float64).reshape(len(names), len(langs))
    kinds = np.where(whole, 0, [len(x) for x in names])
    scores = np.zeros(by.shape, dtype=np.float32)
    for kind in np.unique(kinds):
        at = kinds == kind
        all_n = np.array([totals.get((kind == 0, int(kind), x), 0) for x in langs], dtype=np.float64)
        scores[at] = np.log((by[at] + 0.5) / (all_n + 0.5 * (at.sum() + 1)))
    model["scores"] = scores
    for i, (is_word, name) in enumerate(zip(whole.tolist(), names.tolist())):
        model["words" if is_word else "grams"][name] = i
    return model


class Predictor:
    """Scores batches of texts; one per task."""

    def __init__(self, model: dict, temper: float):
        import regex

        self.m, self.temper = model, temper
        self.find = regex.compile(WORD).findall
        self.known: dict[str, int] = {}
        self.cache: list[np.ndarray] = []

    def of_word(self, word: str) -> np.ndarray:
        m = self.m
        if (i := m["words"].get(word)) is not None:
            return m["scores"][i]
        marked = f"<{word}>"
        for n in range(min(m["longest"], len(marked)), 0, -1):
            found = [i for i in (m["grams"].get(marked[k:k + n]) for k in range(len(marked) - n + 1)) if i is not None]
            if found:
                return m["scores"][found].mean(axis=0)
        return np.zeros(len(m["langs"]), dtype=np.float32)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if len(self.known) > CACHED_WORDS:
            self.known, self.cache = {}, []
        docs = [self.find(t.lower()) for t in texts]
        for word in set().union(*docs).difference(self.known):
            self.known[word] = len(self.cache)
            self.cache.append(self.of_word(word))
        if not self.m["langs"] or not self.cache:
            return [(UNKNOWN, 0.0)] * len(texts)
        scores, out = np.array(self.cache, dtype=np.float64), []
        for found in docs:
            if not found:
                out.append((UNKNOWN, 0.0))
                continue
            total = scores[[self.known[w] for w in found]].sum(axis=0)
            best = int(np.argmax(total))
            out.append((self.m["langs"][best], float(1 / np.exp((total - total[best]) / (self.temper * math.sqrt(len(found)))).sum())))
        return out


def identify(docs: DataFrame, model: dict, text: str = "text", out: str = "language", temper: float = 1.0) -> DataFrame:
    """All rows and columns, and a struct ``out``: ``lang_pred`` and ``score``. An ``out`` that is
    there already is replaced."""
    shared = ready(docs.sparkSession).sparkContext.broadcast(model)

    def make():
        return Predictor(shared.value, temper).predict

    return docs.withColumn(out, text_udf(make, KIND)(F.col(text).cast("string")))
