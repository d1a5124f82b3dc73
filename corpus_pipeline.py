"""The corpus pipeline: language, toxicity, near-duplicates, mix, tokens. Each stage takes (spark, docs, sf_dir); run() chains them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import bpe, langid, mixing, nearcopies, simhash, toxicity
from foliant.llm.common import materialize
from foliant.llm.queries import CATEGORIES, vocabulary

#: A document goes if its language is und or wins by less than this share of its n-grams.
LEAST_MARGIN = 0.001


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep(docs, langid.fit(docs), LEAST_MARGIN)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = toxicity.with_low_quality(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep(docs, toxicity.fit(docs, labels, CATEGORIES), "toxic")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs, nearcopies.near_copies)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resampled(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language ID", language), ("toxicity", not_toxic), ("near-dedup", near_dedup), ("mixing", mixed), ("BPE", tokens)]
#: Classifiers and XXH64 have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
