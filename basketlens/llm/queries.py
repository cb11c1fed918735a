"""Registered queries of this package: name -> (spark, folder) -> DataFrame, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, conversations, cotraining, embedding_dedup, importance, language_id, lm_scoring, mixing, ngram_join, quality_rules, sentencepieces, token_counts, warc
from .common import bucket, table
from .sql import ORACLES  # noqa: F401  (registered beside the queries)


# Places of the vocabulary files; a cluster sets them where its driver keeps its copies.
WORD_BPE = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "word_bpe_49k.json")
PIECES = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")


def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.link(table(spark, folder, "documents"))


def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    model = cotraining.train(docs, table(spark, folder, "labels"))
    told = cotraining.score(docs, model)
    return told.select("doc_id", *[F.col(f"quality_view.{c}") for c in ("score", "text_score", "meta_score", "kept")])


def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    told = lm_scoring.score(docs, train=bucket("doc_id", 7) != 2, heaps=None)
    return told.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), WORD_BPE)


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages"))


def op6_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    rest = bucket("doc_id", 3)
    model = language_id.learn(docs.filter(rest != 1))
    told = language_id.identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", (rest == 1).alias("held_out"), "language.lang_pred", "language.score")


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, target_entropy=0.95).select("doc_id", "source", "mix.epoch", "mix.block", F.round("mix.weight", 9).alias("weight"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = quality_rules.judge(table(spark, folder, "documents").select("doc_id", "text"))
    return rules.select("doc_id", *[F.col(f"rules.{c}") for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")])


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, PIECES).select("doc_id", "tokens.n_pretokens", "tokens.n_tokens")


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepieces.digests(table(spark, folder, "documents"), PIECES)


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, folder, "conversations")), present="present")


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_quality_classifier, op3_lm_scoring, op4_bpe, op5_warc, op6_embedding_dedup, op7_language_id, op8_mixing, op9_quality_rules, op10_token_counts, op11_importance_resampling, op12_sentencepiece, op13_conversation_repair)}
