"""Token counts of texts by way of a cache of digests.

The cache is a Parquet table (version, content, n_tokens). `version` is the digest of the tokenizer's file and of its library's name and
version, and the table's partition column: another tokenizer, or another release of the library, finds none of the counts.
`content` is the digest of a text with everything replaced that can't change its count: null is the empty text, and the sign U+2581,
by which the tokenizer itself writes a space, is a space.

Texts are digested where they are read. Only digests are compared with the cache; those that it lacks are the misses. Each
distinct miss brings one of its texts along by an aggregation with partial results, so copies that a third of all rows hold are one
row for each task; where the misses are few (BROADCAST digests at most, 2 MB) all other texts are left out before it. The misses are encoded
once each and appended. Then all rows look their count up by digest, spread by salts.

An append that is cut off leaves nothing behind, and one that two jobs make at once repeats equal counts, which are read as one.

Defined cases: null and empty texts have as many tokens as the library gives for the empty text (none); repeated rows count each and are encoded once;
rows pass through with null ids; an empty table gives no rows and adds nothing to the cache. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, held, looked_up, materialise, own_dir, parts, tidy

MODEL, LIMIT, BROADCAST = public_tokenizers.path("piece_bpe_32k.model"), 4096, 1 << 16
SPACE = "▁"

_CACHE = "content binary, n_tokens long"


def version(model: str = MODEL) -> str:
    """The digest of the tokenizer's file and of the library that reads it."""
    with open(model, "rb") as f:
        own = hashlib.sha256(f.read()).hexdigest()
    return hashlib.sha256(f"sentencepiece {sentencepiece.__version__} {own}".encode()).hexdigest()


def cached(spark: SparkSession, cache: str, model: str = MODEL) -> DataFrame:
    """(content, n_tokens) of the tokenizer's version; a cache that isn't there yet is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _CACHE)
    rows = spark.read.schema(f"{_CACHE}, version string").parquet(cache).where(F.col("version") == version(model))
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def _encoder(model: str):
    table = held("sentencepiece counts")
    if model not in table:
        table[model] = sentencepiece.SentencePieceProcessor(model_file=model)
    return table[model]


def _counted(model: str):
    def counted(batches):
        for batch in batches:
            for part in parts(batch, 256, 4 << 20):
                n = [len(ids) for ids in _encoder(model).encode(part.column("text").to_pylist(), num_threads=1)]
                yield pa.RecordBatch.from_arrays([part.column("content"), pa.array(n, pa.int64())], names=["content", "n_tokens"])

    return counted


def _text():
    return F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit(SPACE), F.lit(" "))


def _digest():
    return F.unhex(F.sha2(_text(), 256))


def fill(docs: DataFrame, cache: str, model: str = MODEL, contents: DataFrame | None = None) -> int:
    """Encode the texts of the documents that the cache lacks, append their counts, and tell how many they were.

    contents: the digests of the documents, if they are written already.
    """
    spark = docs.sparkSession
    contents = docs.select(_digest().alias("content")) if contents is None else contents.select("content")
    missing = materialise(contents.distinct().join(cached(spark, cache, model), "content", "left_anti"))
    n = missing.count()
    if n:
        texts = docs.select(_digest().alias("content"), _text().alias("text"))
        few = texts.join(F.broadcast(missing), "content", "left_semi") if n <= BROADCAST else texts
        once = few.groupBy("content").agg(F.any_value("text").alias("text"))
        once = once if n <= BROADCAST else once.join(missing, "content", "left_semi")
        new = once.mapInArrow(tidy(_counted(model), "sentencepiece counts"), _CACHE)
        new.withColumn("version", F.lit(version(model))).write.partitionBy("version").mode("append").parquet(cache)
    discard(missing)
    return n


def count(docs: DataFrame, cache: str | None = None, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document.

    cache: a folder that stays from run to run; without one a new cache is begun and what it holds goes with the application.
    """
    spark = docs.sparkSession
    cache = cache or f"{own_dir(spark)}/{uuid.uuid4().hex}"
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    digested = materialise(docs.select("doc_id", size, _digest().alias("content"), F.monotonically_increasing_id().alias("row")))
    fill(docs, cache, model, digested)
    found = looked_up(digested, cached(spark, cache, model), ["content"], "row")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
