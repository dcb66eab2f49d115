"""Streaming forms: pretoken counts that grow with arriving documents, and duplicates within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def running_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of a stream of documents; a document is one row, so no pretoken is cut. Write in update mode."""
    return docs.select(F.explode(X.pretokens(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def kept_once(docs: DataFrame, time: str, delay: str = "1 hour", text: str = "text", max_latin_ratio: float = 0.05) -> DataFrame:
    """Kept documents of a stream, each text once within the delay; later ones are late data and dropped."""
    kept = docs.where(X.keep_story(text, max_latin_ratio)).withColumn(text, X.strip(text))
    return kept.withWatermark(time, delay).dropDuplicatesWithinWatermark([text])


def windowed_counts(docs: DataFrame, time: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(window, n_docs, n_chars) by event time."""
    return docs.withWatermark(time, delay).groupBy(F.window(time, width)).agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))
