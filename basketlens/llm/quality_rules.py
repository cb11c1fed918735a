"""Line-first cleaning: rules per line, then a verdict on how much text the document lost.

Every line that holds a word is judged on its own:

* punctuation: it does not end in a sentence mark, or more than half of its words (four at
  least) end in a shouting or layout mark;
* navigation: three or more of its words are menu or table separators;
* boilerplate: it is short and holds a stock phrase.

Lines that fail are removed. A document is rejected when the removed lines held more than
``max_lost`` percent of its word characters, or when it fails the base test (fewer than
``min_words`` words, or more than ``max_repeated`` percent of them in repeated 3-word windows).

Defined results: a null or empty text has no words, fails the base test and is rejected; ties
(exactly at a limit) pass; equal rows get equal verdicts; other columns are left alone.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, ready, text_udf

# Fixed values of the base counts and of the line rules.
SYMBOLS = b"#*$%&|<>"
SENTENCE_END = tuple(m.encode() for m in (".", "!", "?", "…", ":", ";", "。", "！", "？", '"', "'", "”", "’", "»", ")", "]"))
NOISE_END = (b"!", b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")
SEPARATORS = frozenset(m.encode() for m in ("|", "»", "›", "·", "•", "/", ">"))
BOILERPLATE = tuple(p.encode() for p in (
    "all rights reserved", "licensed under", "released under", "creative commons", "terms of use", "terms of service",
    "privacy policy", "cookie", "javascript", "click here", "subscribe to", "sign up", "log in", "share this",
    "powered by", "skip to content", "copyright ©", "lorem ipsum"))
BOILERPLATE_WORDS = 30

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars"]
KIND = pa.struct([*((f, pa.int64()) for f in FIELDS), ("clean_text", pa.string())])


def chars(raw: bytes) -> int:
    """Code points in words."""
    return len(raw.translate(None, SPACES).decode())


def line_fails(line: bytes, words: list[bytes]) -> bool:
    if not words[-1].endswith(SENTENCE_END):
        return True
    if len(words) >= 4 and 2 * sum(w.endswith(NOISE_END) for w in words) > len(words):
        return True
    if sum(w in SEPARATORS for w in words) >= 3:
        return True
    if len(words) <= BOILERPLATE_WORDS:
        low = line.lower()
        return any(p in low for p in BOILERPLATE)
    return False


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = bytearray(len(words))
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered[i:i + 3] = b"\1\1\1"
    return sum(covered)


def measure(text: str) -> tuple:
    raw = text.encode()
    words: list[bytes] = []
    lines: set[bytes] = set()
    kept, dup, lost = [], 0, 0
    for line in raw.split(b"\n"):
        own = line.split()
        if own:
            dup += line in lines
            lines.add(line)
            words += own
            if line_fails(line, own):
                lost += chars(line)
                continue
        kept.append(line)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), chars(raw), symbols, dup, repeated_words(words), lost, b"\n".join(kept).decode()


def _measure_all():
    return lambda texts: [measure(t) for t in texts]


def verdict(m: str, min_words: int, max_repeated: int, max_lost: int) -> tuple[Column, Column]:
    """(base_failed, kept) from the measures in struct column ``m``."""
    f = lambda name: F.col(f"{m}.{name}")
    failed = (f("n_words") < min_words) | (f("n_repeat_words") * 100 > f("n_words") * max_repeated)
    return failed, ~failed & (f("lost_chars") * 100 <= f("word_chars") * max_lost)


def judge(docs: DataFrame, text: str = "text", out: str = "rules", min_words: int = 50, max_repeated: int = 50,
          max_lost: int = 50) -> DataFrame:
    """All rows and columns, and a struct ``out``: measures, ``clean_text`` (failing lines
    removed), ``base_failed`` and ``kept``. An ``out`` that is there already is replaced."""
    ready(docs.sparkSession)
    measured = docs.withColumn(out, text_udf(_measure_all, KIND)(F.col(text).cast("string")))
    failed, kept = verdict(out, min_words, max_repeated, max_lost)
    return measured.withColumn(out, F.col(out).withField("base_failed", failed).withField("kept", kept))


def clean(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """Documents that pass, with their columns; texts stay whole."""
    mark = "_rules_verdict"
    return judge(docs, text, mark, **limits).filter(F.col(f"{mark}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
