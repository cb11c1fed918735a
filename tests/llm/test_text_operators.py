"""Operators that look at one text at a time, against their definitions and public libraries."""

import hashlib
import math
import os
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.llm import bpe, cotraining, language_id, quality_rules, token_counts
from basketlens.llm.common import table
from basketlens.llm.queries import PIECES, QUERIES, WORD_BPE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def column(rows, key, value):
    return {r[key]: r[value] for r in rows}


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(windows) < 2000 else set()
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_rule_counts_are_the_definitions(docs, texts):
    rows = quality_rules.judge(docs).select("doc_id", "rules.*").filter("doc_id IS NOT NULL").collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        if r.doc_id != 14:
            assert got == base_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_lines_fail_by_rule(docs):
    rows = column(quality_rules.judge(docs).collect(), "doc_id", "rules")
    assert rows[16]["kept"] and rows[16]["clean_text"].startswith("w030")
    assert not rows[1]["kept"] and rows[1]["lost_chars"] == rows[1]["word_chars"]  # no sentence mark
    assert rows[17]["n_dup_lines"] == 1 and not rows[18]["kept"] and not rows[6]["kept"]
    f = lambda line: quality_rules.line_fails(line.encode(), line.encode().split())
    assert f("no mark at the end") and f("AAA!! BBB!! CCC!! DDD!!") and f("Home | News | About | More.") and f("See our cookie policy.")
    assert not f("A plain sentence.") and not f("What? Yes! No.") and not f("It is “quoted.”")


def test_clean_keeps_columns(docs, nothing):
    assert quality_rules.clean(docs).columns == docs.columns and quality_rules.clean(docs).count() == 1
    assert quality_rules.clean(nothing).count() == 0


@pytest.mark.skipif(not os.path.exists(WORD_BPE), reason="no tokenizer file")
def test_bpe_is_the_library(docs, texts, nothing):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(WORD_BPE)
    rows = bpe.digests(docs, WORD_BPE).filter("doc_id IS NOT NULL").collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(nothing, WORD_BPE).count() == 0


@pytest.mark.skipif(not os.path.exists(WORD_BPE), reason="no tokenizer file")
def test_every_token_and_odd_text_encodes_as_the_library_does(spark, folder):
    from tokenizers import Tokenizer
    library, encoder = Tokenizer.from_file(WORD_BPE), bpe.Encoder(bpe.load(WORD_BPE))
    odd = ["\x00\x85 fi ﬁ ǅ", "x\x1cy", "<|ENDOFTEXT|>", "İstanbul", "áé", "aaaa's'll", *list(encoder.v.ids)[::53]]
    odd += [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").limit(60).collect()]
    assert [bpe.ids_of(x) for x in encoder.encode(odd)] == [e.ids for e in library.encode_batch(odd, add_special_tokens=False)]


@pytest.mark.skipif(not os.path.exists(WORD_BPE), reason="no tokenizer file")
def test_long_words_take_linear_memory():
    import resource

    from tokenizers import Tokenizer
    library, encoder = Tokenizer.from_file(WORD_BPE), bpe.Encoder(bpe.load(WORD_BPE))
    encoder.encode(["warm"])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    texts = ["q" * 1_000_000, "theing" * 170_000, "a1" * 20_000]
    coded = encoder.encode(texts)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000  # kilobytes
    for text, ids in zip(texts, coded):
        assert bpe.ids_of(ids) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.skipif(not os.path.exists(WORD_BPE), reason="no tokenizer file")
def test_one_worker_encodes_and_decodes(docs):
    plan = bpe.digests(docs, WORD_BPE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert bpe.Decoder(bpe.load(WORD_BPE)).decode(b"\xff\xff\xff\x7f") == ""


@pytest.mark.skipif(not os.path.exists(PIECES), reason="no vocabulary file")
def test_token_counts_are_the_library(docs, texts, nothing):
    from tokenizers import Tokenizer, models
    pieces = token_counts.load(PIECES)
    vocabulary = [("<unk>", 0.0), *[(f"<0x{i:02X}>", -50.0) for i in range(256)], *pieces.scores.items()]
    library = Tokenizer(models.Unigram(vocabulary, 0, True))
    rows = token_counts.count_tokens(docs, PIECES).select("doc_id", "tokens.*").filter("doc_id IS NOT NULL").collect()
    for r in rows:
        words = WORD.findall(texts[r.doc_id] or "")
        assert r.n_pretokens == len(words)
        assert r.n_tokens == sum(len(library.encode("▁" + w).ids) for w in words)
    assert token_counts.count_tokens(nothing, PIECES).count() == 0


def test_tie_goes_to_fewer_tokens():
    pieces = token_counts.Pieces({"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -2.0}, -20.0, 2)
    assert token_counts.Counter(pieces).count(["ab"]) == [(1, 2)]


def test_language_by_words_then_by_grams(spark, nothing):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("the house and the tree", "en"),
                                                        ("der Hund und die Katze", "de"), ("das Haus und der Baum", "de"), ("ignored", None), (None, "en")] * 3)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "the dog"), (2, "und der Hund"), (3, "Hundes"), (4, None), (5, "12 !?"), (6, ""), (7, "ΩΩ"), (8, "the dog")], "k int, text string")
    got = {r.k: (r.language.lang_pred, r.language.score) for r in language_id.identify(asked, model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5, 6)] == ["en", "de", "de", "und", "und", "und"]
    assert got[1] == got[8] and got[4][1] == 0.0 and all(0 <= s <= 1 for _, s in got.values())
    empty = language_id.learn(nothing)
    assert {r.language.lang_pred for r in language_id.identify(asked, empty).collect()} == {"und"}


def test_language_held_out_accuracy(spark, folder):
    told = QUERIES["op7_language_id"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = told.filter("held_out AND lang IS NOT NULL").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) > 0


def test_cotraining_learns_and_keeps_clean_documents(spark, folder):
    told = QUERIES["op2_quality_classifier"](spark, folder)
    assert told.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    rows = told.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good) and sum(r.kept for r in bad) <= 0.25 * len(bad)


def test_cotraining_defined_results(spark, docs, nothing):
    one_kind = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert cotraining.train(docs, one_kind) is None and cotraining.train(nothing, one_kind) is None
    assert {(r.quality_view.score, r.quality_view.kept) for r in cotraining.score(docs, None).collect()} == {(0.5, True)}
    labels = spark.createDataFrame([(k, int(k < 10)) for k in range(1, 21)] + [(99, 0), (3, None), (1, 1)], "doc_id long, quality int")
    scored = cotraining.score(docs, cotraining.train(docs, labels)).collect()
    assert len(scored) == docs.count() and all(0 < r.quality_view.score < 1 for r in scored)


class InMemory:
    """The pool by plain loops over all documents."""

    def __init__(self, rows):
        self.views = [cotraining.dense([r[f"{v}_at"] for r in rows], [r[v] for r in rows], size) for v, size in zip("ab", cotraining.SIZES)]
        self.group, self.size = [r.grp for r in rows], len(rows)

    def histograms(self, models):
        out = np.zeros((2, cotraining.BINS), dtype=np.int64)
        for v, (model, x) in enumerate(zip(models, self.views)):
            for odds in model.odds(x):
                out[v, min(max(math.floor((odds + 32) * 64), 0), 4095)] += 1
        return out

    def slots(self, models, cuts):
        found = {}
        for me, cut in enumerate(cuts):
            if cut is not None:
                for odds, other, g in zip(models[me].odds(self.views[me]), self.views[1 - me], self.group):
                    at = min(max(math.floor((odds + 32) * 64), 0), 4095)
                    if at <= cut[0] or at >= cut[1]:
                        n, sums = found.get((me, int(at >= cut[1]), g), (0, 0))
                        found[me, int(at >= cut[1]), g] = (n + 1, sums + np.rint(other.astype(np.float64) * (1 << 20)).astype(np.int64))
        return found


def test_cotraining_exchanges_over_all_documents_as_plain_loops_do(spark, folder, monkeypatch):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    labelled = labels.select("doc_id").distinct().count()
    seen, real = [], cotraining.Pool

    def both(rows):
        seen.append((real(rows), InMemory(rows.collect())))
        return seen[-1][0]
    monkeypatch.setattr(cotraining, "Pool", both)
    more = docs.unionByName(docs.filter("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id") + 10 ** 6)).repartition(5)
    models = [cotraining.train(d, labels) for d in (docs, more)]
    assert [m["pool"] for m in models] == [docs.count() - labelled, 2 * docs.count() - labelled]  # it grows with the table
    assert all(m["rounds"] == cotraining.ROUNDS for m in models)
    monkeypatch.setattr(cotraining, "Pool", lambda rows: seen[0][1])
    plain = cotraining.train(docs.repartition(3), labels)
    for a, b in zip(models[0]["views"], plain["views"]):
        for x, y in zip(a, b):
            assert np.allclose(x, y, atol=1e-9)


def test_limits_take_whole_bins_and_never_cross_the_middle():
    h = np.zeros(cotraining.BINS, dtype=np.int64)
    h[[10, 2000, 2100, 4000]] = 5, 5, 5, 50
    assert cotraining.limits(h, 20, 0.5) == (2000, 4000) and cotraining.limits(h, 10, 0.5) == (10, 4000)
    assert cotraining.limits(h, 1000, 0.5) == (2047, 2048) and cotraining.limits(h * 0, 10, 0.5) == (2047, 2048)


def test_a_labelled_id_that_fills_the_table_counts_once(spark, docs):
    labels = spark.createDataFrame([(k, int(k < 10)) for k in range(1, 21)], "doc_id long, quality int")
    copies = docs.filter("doc_id = 12").limit(1).crossJoin(spark.range(3000)).select(*docs.columns[:-1], docs["id"])
    rows = cotraining.featured(docs.unionAll(copies), labels, "doc_id", "text", "quality", ("source", "lang"), 100)
    assert rows.filter("y >= 0").count() > 3000 and rows.filter("y >= 0").select("id_hash").distinct().count() == 20
    a, b = cotraining.train(docs, labels), cotraining.train(docs.unionAll(copies), labels)
    assert all(np.allclose(x[2], y[2]) for x, y in zip(a["views"], b["views"]))
