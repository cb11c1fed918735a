"""Training-data pipeline over ``documents``: classify, clean, deduplicate, mix, tokenize.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketlens.llm import bpe, cotraining, mixing, ngram_join, quality_rules
from basketlens.llm.common import ready, scratch, table
from basketlens.llm.queries import WORD_BPE


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    mark = "_quality_view"
    model = cotraining.train(docs, table(spark, sf_dir, "labels"))
    return cotraining.score(docs, model, out=mark).filter(F.col(f"{mark}.kept")).drop(mark)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, texts whole."""
    return quality_rules.clean(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.first_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the tempered mixture of sources shows them."""
    return mixing.mix(docs, out="_mix", target_entropy=0.95).drop("_mix")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    return bpe.digests(docs, WORD_BPE, keep=["doc_id", "source"])


STAGES = [("quality classifier", classify), ("quality rules", clean), ("n-gram Jaccard join", deduplicate), ("mixing", mix), ("BPE", encode)]
ORACLE_SQL = None  # a fitted classifier and a tokenizer are not SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
