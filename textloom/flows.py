"""The three flows from files to files: a tokenizer, a token file, preference pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import stream, tokenizer
from .sources import corpus, tokenfile
from .sources.shared import discard, materialise
from .streaming import pairs

LINES = 1 << 40  # lines of a file at most


def _kept(spark: SparkSession, paths: list[str], settings: dict) -> tuple[DataFrame, dict[str, int]]:
    """The kept documents (doc_id, text), written, numbered in reading order, and how many were kept and dropped."""
    docs = materialise(corpus.iter_documents(spark, paths, **settings))
    stats = corpus.corpus_stats(docs).first().asDict()
    if not stats["kept"]:
        raise ValueError(f"no documents found in {paths}")
    kept = docs.where("kept").select((F.col("file_idx").cast("long") * LINES + F.col("line_no")).alias("doc_id"), "text")
    kept._textloom_path = docs._textloom_path
    return kept, stats


def train_tokenizer(spark: SparkSession, paths: list[str], out: str, vocab_size: int, driver_words: int = tokenizer.DRIVER_WORDS, **settings) -> dict[str, int]:
    """Corpus files -> a tokenizer file. Returns kept, dropped and vocab_size (with the EOT)."""
    docs, stats = _kept(spark, paths, settings)
    merges, vocab = tokenizer.train(docs, vocab_size, driver_words=driver_words)
    corpus.save_tokenizer(spark, merges, vocab, out)
    discard(docs)
    return stats | {"vocab_size": len(vocab)}


def prepare_tokens(spark: SparkSession, tokenizer_file: str, paths: list[str], out: str, **settings) -> dict[str, int]:
    """Corpus files and a tokenizer file -> a flat token file, EOT behind every document. Returns kept, dropped and num_tokens."""
    merges, vocab = corpus.load_tokenizer(spark, tokenizer_file)
    docs, stats = _kept(spark, paths, settings)
    tokenfile.write(stream.placed(tokenizer.encode(docs, merges, eot=True)), out, len(vocab))
    discard(docs)
    return stats | {"num_tokens": tokenfile.Store.open(out).num_tokens}


def make_pairs(spark: SparkSession, candidates: str, out: str, mode: str = "rule", **settings) -> dict[str, int]:
    """A folder of JSON lines (streaming.pairs.CANDIDATES) -> preference pairs, in place of those that `out` has. Returns prompts by outcome."""
    found, kept = pairs.records(materialise(pairs.exploded(spark.read.schema(pairs.CANDIDATES).json(candidates))), mode, **settings)
    found = materialise(found.select("status"))
    corpus.write_pairs(kept, out)
    stats = {r["status"]: r["n"] for r in found.groupBy("status").agg(F.count("*").alias("n")).collect()}
    discard(found)
    return stats
