"""Importance resampling against its definition on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basketlens.llm import common, importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text, max_n):
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i:i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)], len(words)


def brute(rows, target, max_n=1, buckets=10_000, percent=10, min_words=20, seed="2024"):
    """(id, n_features, weight, score, rank) per row, as the contract says."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text, max_n)[0]))
    for text in target:
        t.update(map(bucket, features(text, max_n)[0]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    told = []
    for key, text in rows:
        found, n_words = features(text, max_n)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        told.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    fit = sorted((r for r in told if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[:len(fit) * percent // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in told), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def target(spark, texts):
    return spark.createDataFrame([(texts[12],), (None,), ("",), ("W001 w002\nw003 w004\n\n w005",)], "text string")


@pytest.mark.parametrize("max_n,buckets", [(1, 10_000), (2, 7), (3, 10_000)])
def test_definition(docs, target, max_n, buckets):
    extra = [r.text for r in target.collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows_of = docs.unionByName(docs.sparkSession.createDataFrame([(50, "a b\nc d\n\ne\nf a b\nc " + "é ü\n" * 12)], "doc_id long, text string"), allowMissingColumns=True)
    rows.append((50, "a b\nc d\n\ne\nf a b\nc " + "é ü\n" * 12))
    told = importance.resample(rows_of, target, max_n=max_n, buckets=buckets, percent=40)
    assert got(told) == brute(rows, extra, max_n, buckets, 40)


def test_a_common_line_is_broadcast_and_changes_nothing(spark, target, monkeypatch):
    common = "the same line in every text of this table"
    rows = [(k, f"{common}\nown line {k} " + "x y z " * (k % 9) + f"\n{common}") for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    goal = [r.text for r in target.collect()]
    expected = brute(rows, goal, percent=50, min_words=5)
    assert got(importance.resample(frame, target, percent=50, min_words=5)) == expected
    monkeypatch.setattr(common, "HOT", 3)
    assert got(importance.resample(frame, target, percent=50, min_words=5)) == expected
    _, lines = importance.segmented(frame, "text", 1, 10_000, {})
    assert lines.count() == 301 and lines.agg(F.max("times")).first()[0] == 600


def test_repeated_rows_empty_tables_and_clashing_columns(spark, docs, nothing, target):
    text = " ".join(f"v{i}" for i in range(25))
    frame = spark.createDataFrame([(3, text, 1, "r")] * 5 + [(None, text, 2, "s"), (2, text, 3, "t")], "doc_id long, text string, score int, row string")
    told = importance.resample(frame, target, percent=100)
    assert got(told) == brute([(r.doc_id, r.text) for r in frame.collect()], [r.text for r in target.collect()], percent=100)
    kept = importance.resample(frame, target, percent=100, keep=["doc_id", "text", "score", "row"])
    assert kept.columns == ["doc_id", "text", "row", "n_features", "weight", "score", "rank"]
    assert sorted(r.row for r in kept.collect()) == ["r"] * 5 + ["s", "t"]
    assert importance.resample(nothing, target).count() == 0
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(importance.resample(docs, nothing, percent=30)) == brute(rows, [], percent=30)
    with pytest.raises(ValueError):
        importance.resample(docs, target, buckets=0)


def test_no_python_worker(docs, target):
    plan = importance.resample(docs, target)._jdf.queryExecution().executedPlan().toString()
    rows, lines = importance.segmented(docs, "text", 2, 100, {"id": F.col("doc_id")})
    for text in (plan, *[f._jdf.queryExecution().executedPlan().toString() for f in (importance.counts(rows, lines),)]):
        assert "Python" not in text and "Pandas" not in text and "Cartesian" not in text
