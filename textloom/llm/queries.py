"""The queries opN_<name> of this subpackage, with production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, collocations, html_extract, langid, license_scan, merkle, mixing, probminhash, quality_classifier, quality_rules, sentencepiece_codec, token_counts, toxicity
from .common import fold, read


def _held_out(parts: int, part: int):
    """Whether the row's fold is the one kept from fitting; a row without an id is in none."""
    return F.coalesce(fold("doc_id", parts) == part, F.lit(False)).alias("held_out")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.verdicts(read(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality_rules.BASE, "base_failed", "kept", "n_removed_words")


def op2_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    scored = toxicity.score(docs, model, offences="offending_sentences").drop("text")
    return scored.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending_sentences")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, read(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    scored = quality_classifier.score(docs, model).drop("text")
    return scored.select("doc_id", _held_out(4, 2), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, fold("doc_id", 4) != 2)
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read(spark, sf_dir, "documents")).drop("first_start")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From an empty cache, so each distinct content is encoded on every run."""
    return token_counts.count(read(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides the crc32 of the id, the proof is tried on a row whose n_chars is one more."""
    docs = read(spark, sf_dir, "documents")
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    tampered = merkle.leaf(*[more if c == "n_chars" else F.col(c) for c in merkle.COLUMNS])
    return merkle.proofs(merkle.manifest(docs, claimed=F.when((fold("doc_id", 7) == 0) & more.isNotNull(), tampered)))


QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_probminhash, op3_html_extraction, op4_ann, op5_toxicity, op6_quality_classifier, op7_sentencepiece, op8_language_id, op9_license_scan, op10_mixing, op11_collocations, op12_token_counts, op13_merkle)
}
ORACLES = {"op1_quality_rules": quality_rules.ORACLE, "op9_license_scan": license_scan.oracle(), "op10_mixing": mixing.ORACLE, "op11_collocations": collocations.ORACLE, "op13_merkle": merkle.ORACLE}
