"""SentencePiece by distinct chunks, against the library."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from basketlens.llm import sentencepieces as S
from basketlens.llm.queries import PIECES

pytestmark = pytest.mark.skipif(not os.path.exists(PIECES), reason="no vocabulary file")


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor
    return SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def encoder():
    return S.Encoder(S.load(PIECES))


def test_digests_are_the_library(docs, texts, nothing, library):
    rows = S.digests(docs, PIECES).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            ids = library.encode(texts[r.doc_id] or "")
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert S.digests(nothing, PIECES).count() == 0 and S.encode(nothing, PIECES).count() == 0


def test_given_texts_are_the_library(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = S.decode(S.encode(docs, PIECES), PIECES, "pieces.ids").collect()
    for r in rows:
        assert S.ids_of(r.pieces.ids) == library.encode(r.text or "") and r.pieces.n_tokens == len(r.pieces.ids) // 4
        assert r.decoded == library.decode(S.ids_of(r.pieces.ids))


def test_odd_texts_are_the_library(encoder, library):
    draw = random.Random(1)
    parts = ["a", "b", " ", "▁", "é", "日", "\n", "\t", "\x00", "\U0001f600", "the", " th", "ing", "1", "   ", "́", "İ", "\xa0", "​", "\r", "x" * 60, "<s>"]
    odd = ["".join(draw.choices(parts, k=draw.randint(0, 30))) for _ in range(5000)]
    odd += ["a" * 30000, "ab" * 3000, " " * 5000, "the" * 2000, "日本" * 4000]
    assert [S.ids_of(x) for x in encoder.encode(odd)] == library.encode(odd)
    both = [encoder.segment(t) for t in odd if 1 < len(t) <= S.SHORT], [encoder.by_heap(list(t)) for t in odd if 1 < len(t) <= S.SHORT]
    assert both[0] == both[1]


def test_any_ids_decode_as_the_library_does(encoder, library):
    draw = random.Random(2)
    for k in range(4000):
        ids = [draw.randrange(0, 32000 if k % 2 else 300) for _ in range(draw.randint(0, 12))]
        assert encoder.decode(ids) == library.decode(ids)
    assert encoder.decode([-1, 10 ** 6]) == ""


def test_a_word_of_a_million_letters(encoder):
    ids = S.ids_of(encoder.encode(["q" * 1_000_000])[0])
    assert encoder.decode(ids) == "q" * 1_000_000


def test_a_small_table_changes_nothing(encoder, library, monkeypatch):
    monkeypatch.setattr(S, "TABLE_CHUNKS", 1)
    texts = ["one two three", "two three four", "", "one one"]
    assert [S.ids_of(encoder.encode([t])[0]) for t in texts] == library.encode(texts)


def test_clashing_columns_nulls_and_refused_files(spark, nothing, tmp_path):
    frame = spark.createDataFrame([(1, "a b", "x", "y"), (2, None, "x", "y")], "k int, text string, pieces string, decoded string")
    coded = S.encode(frame, PIECES)
    assert coded.columns == frame.columns
    back = S.decode(coded, PIECES, "pieces.ids")
    assert [tuple(r) for r in back.select("k", "decoded", "pieces.n_tokens").orderBy("k").collect()] == [(1, "a b", 2), (2, "", 0)]
    none = frame.select("k", F.lit(None).cast("binary").alias("ids"))
    assert {r.decoded for r in S.decode(none, PIECES, "ids").collect()} == {""}
    large = tmp_path / "large"
    large.write_bytes(b"\0" * (S.MAX_FILE_BYTES + 1))
    with pytest.raises(ValueError):
        S.load(str(large))
