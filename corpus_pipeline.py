"""A corpus pipeline of five operators: rules, toxicity, near duplicates, mixing and tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import mixing, probminhash, quality_rules, sentencepiece_codec, toxicity
from textloom.llm.common import fold, materialise, read, small_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines above the limits."""
    return quality_rules.clean(docs)


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from the labels of the fitting folds."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.score(docs, model, "_toxic").where(F.col("_toxic") < 0.5).drop("_toxic")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return probminhash.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the curriculum takes, range-sorted by training position."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every copy, and whether decoding them gives the text back."""
    return sentencepiece_codec.encode(docs.select("doc_id", "text"))


def _batched(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, _batched(stage)) for name, stage in [("quality_rules", quality), ("toxicity", nontoxic), ("near_dedup", near_dedup), ("mixing", mixed), ("tokens", tokens)]]

#: Learned scores, MinHash and suffix arrays can't be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; the size of Arrow batches is the caller's again at the end."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, docs = spark.conf.get(key), read(spark, sf_dir, "documents")
    try:
        for _, stage in STAGES:
            docs = materialise(stage(spark, docs, sf_dir))
    finally:
        spark.conf.set(key, before)
    return docs
