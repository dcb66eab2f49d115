"""Corpus files, token stores, tokenizer and pair files as DataFrames.

Paths may be in any file system that Spark reads; listing goes through Hadoop's API. Corpus rows carry file_idx and
line_no, since the order of documents has a meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.order import first_kept

SUFFIXES = (".txt", ".jsonl")


def expand_corpus_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files as given; a directory's own .txt and .jsonl files, sorted. Missing paths raise FileNotFoundError."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for given in paths:
        path = jvm.org.apache.hadoop.fs.Path(given)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            raise FileNotFoundError(given)
        if fs.getFileStatus(path).isDirectory():
            found = [f.getPath().toString() for f in fs.listStatus(path) if f.isFile()]
            out += sorted(f for f in found if f.endswith(SUFFIXES))
        else:
            out.append(path.toString())
    return out


def _qualified(spark: SparkSession, paths: str | list[str]) -> list:
    """The paths as Hadoop paths with their scheme, so that two names of one file are equal."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = [jvm.org.apache.hadoop.fs.Path(p) for p in ([paths] if isinstance(paths, str) else paths)]
    return [p.getFileSystem(conf).makeQualified(p) for p in found]


def _once(paths: list) -> list[str]:
    return sorted({p.toString() for p in paths})


def _files(spark: SparkSession, paths: list) -> DataFrame:
    """(file_idx, file): the paths in their order, as readers name them; a path that is given twice is read for each time."""
    named = [(i, p.toUri().toString()) for i, p in enumerate(paths)]
    return spark.createDataFrame(named, "file_idx int, path string").select("file_idx", _plain("path").alias("file"))


def _plain(path: str) -> Column:
    """A path's name whichever way a reader writes its scheme."""
    return F.regexp_replace(F.col(path), "^file:/+", "/")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file_idx, line_no, value) of text files: one scan for all of them, each line numbered within its file.

    Spark hands a split's rows out in order, so a line's number is its place in its split and the lines of the splits before it.
    """
    paths = _qualified(spark, paths)
    lines = spark.read.text(_once(paths)).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"))
    lines = lines.withColumn("row", F.monotonically_increasing_id())
    splits = lines.groupBy("path", "split").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a file's splits
    starts = splits.select("path", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    starts = starts.withColumn("file", _plain("path")).join(F.broadcast(_files(spark, paths)), "file")  # as many rows as paths
    joined = lines.join(F.broadcast(starts.select("path", "split", "first", "start", "file_idx")), ["path", "split"])  # as many rows as splits
    return joined.select("file_idx", (F.col("start") + F.col("row") - F.col("first")).alias("line_no"), "value")


def read_jsonl(spark: SparkSession, paths: str | list[str], field: str = "text_ja") -> DataFrame:
    """(file_idx, line_no, text): a line each, blank lines left out, a missing or null field as empty; bad JSON raises."""
    lines = read_lines(spark, paths).where(X.strip("value") != "")
    record = F.from_json("value", T.StructType([T.StructField(field, T.StringType())]), {"mode": "FAILFAST"})
    return lines.select("file_idx", "line_no", F.coalesce(record[field], F.lit("")).alias("text"))


def read_txt(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file_idx, line_no 0, text): each file as one document, neither stripped nor filtered; an empty file is an empty document."""
    paths = _qualified(spark, paths)
    whole = spark.read.text(_once(paths), wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    found = F.broadcast(_files(spark, paths)).join(whole.withColumn("file", _plain("path")), "file", "left")
    return found.select("file_idx", F.lit(0).cast("long").alias("line_no"), X.newlines(F.coalesce("value", F.lit(""))).alias("text"))


def _documents(spark: SparkSession, files: list[tuple[int, str]], field: str, max_latin_ratio: float) -> DataFrame:
    """(file_idx, line_no, text, kept) of numbered files; all of a kind are one scan."""
    out = spark.createDataFrame([], "file_idx int, line_no long, text string, kept boolean")
    numbered = lambda own: F.element_at(F.array(*[F.lit(i) for i, _ in own]), F.col("file_idx") + 1).alias("file_idx")
    if texts := [(i, p) for i, p in files if p.endswith(".txt")]:
        out = out.unionByName(read_txt(spark, [p for _, p in texts]).select(numbered(texts), "line_no", "text", F.lit(True).alias("kept")))
    if lines := [(i, p) for i, p in files if not p.endswith(".txt")]:
        kept = X.keep_story("text", max_latin_ratio)
        text = F.when(kept, X.strip("text")).otherwise(F.col("text")).alias("text")
        out = out.unionByName(read_jsonl(spark, [p for _, p in lines], field).select(numbered(lines), "line_no", text, kept.alias("kept")))
    return out


def iter_documents(spark: SparkSession, paths: list[str], field: str = "text_ja", max_docs: int | None = None, max_latin_ratio: float = 0.05) -> DataFrame:
    """(file_idx, line_no, text, kept) of a corpus in reading order; kept texts are stripped.

    With max_docs rows end at the last one that the reader would have looked at: the max_docs-th kept document. Files are then counted
    in groups that double, and those behind the group that completes max_docs aren't opened.
    """
    files = list(enumerate(expand_corpus_paths(spark, paths)))
    if max_docs is None:
        return _documents(spark, files, field, max_latin_ratio)
    end, found, group = 0, 0, 1
    while end < len(files) and found < max_docs:
        found += _documents(spark, files[end : end + group], field, max_latin_ratio).where("kept").count()
        end, group = end + group, group * 2
    return first_kept(_documents(spark, files[:end], field, max_latin_ratio), ["file_idx", "line_no"], "kept", max_docs)


def read_chunks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file_idx, chunk_no, chunk): text files in chunks of a line and its end, so that a file of any size is read in splits.

    The chunks of a file are its text, line ends being \\n; an empty file has none.
    """
    lines = read_lines(spark, paths)
    ends = spark.createDataFrame([(i, _ends_a_line(spark, p)) for i, p in enumerate(_qualified(spark, paths))], "file_idx int, ended boolean")
    last = lines.groupBy("file_idx").agg(F.max("line_no").alias("last")).join(F.broadcast(ends), "file_idx")  # a row for each path
    closed = (F.col("line_no") < F.col("last")) | F.col("ended")
    return lines.join(F.broadcast(last), "file_idx").select("file_idx", F.col("line_no").alias("chunk_no"), F.concat("value", F.when(closed, "\n").otherwise("")).alias("chunk"))


def _ends_a_line(spark: SparkSession, path) -> bool:
    """Whether a file's last byte ends a line."""
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getFileStatus(path).getLen()
    if not size:
        return False
    stream = fs.open(path)
    try:
        stream.seek(size - 1)
        return stream.read() in (10, 13)
    finally:
        stream.close()


def story_openings(lines: DataFrame, n: int, skip: int = 0, end: str = "。", order: str = "line_no") -> DataFrame:
    """(order, opening): the first n usable openings of the rows (order, text) from raw line `skip` on."""
    found = lines.where(F.col(order) >= skip).select(order, X.opening("text", end).alias("opening")).where("opening IS NOT NULL")
    return found.orderBy(order).limit(n)


def corpus_stats(documents: DataFrame) -> DataFrame:
    """One row: how many documents were kept and dropped."""
    return documents.agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


def write_tokens(stream: DataFrame, path: str, vocab_size: int) -> None:
    """(pos, token_id) as Parquet, and its metadata (dtype, num_tokens) in <path>.meta.

    Rows carry their position; a stream of placed documents is range-partitioned by it already, so nothing is sorted.
    """
    stream.select("pos", "token_id").write.mode("overwrite").parquet(path)
    meta = stream.sparkSession.read.parquet(path).agg(F.count("*").alias("num_tokens"), F.lit(dtype(vocab_size)).alias("dtype"))
    meta.write.mode("overwrite").json(f"{path}.meta")


def dtype(vocab_size: int) -> str:
    return "uint16" if vocab_size <= 1 << 16 else "uint32"


def load_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stream; raises if it hasn't as many tokens as its metadata says."""
    stream = spark.read.parquet(path)
    expected, found = spark.read.json(f"{path}.meta").first()["num_tokens"], stream.count()
    if expected != found:
        raise ValueError(f"{path}: {found} tokens, its metadata says {expected}")
    return stream


TOKENIZER = T.StructType([T.StructField("merges", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("vocab", T.MapType(T.StringType(), T.IntegerType()))])


def save_tokenizer(spark: SparkSession, merges: list[tuple[str, str]], vocab: dict[str, int], path: str) -> None:
    row = ([list(m) for m in merges], vocab)
    spark.createDataFrame([row], TOKENIZER).coalesce(1).write.mode("overwrite").json(path)


def load_tokenizer(spark: SparkSession, path: str) -> tuple[list[tuple[str, str]], dict[str, int]]:
    row = spark.read.schema(TOKENIZER).json(path).first()
    return [tuple(m) for m in row["merges"]], dict(row["vocab"])


PAIR = T.StructType([
    T.StructField("prompt", T.StringType()), T.StructField("chosen", T.StringType()), T.StructField("rejected", T.StringType()), T.StructField("judge", T.StringType()),
    T.StructField("rule_scores", T.ArrayType(T.DoubleType())), T.StructField("rule_penalties", T.ArrayType(T.MapType(T.StringType(), T.DoubleType()))), T.StructField("llm_reasons", T.ArrayType(T.StringType())),
])


def write_pairs(pairs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Pairs as JSON lines, one record each, absent fields left out, in place of what is there: written again they are there once."""
    own = [c for c in PAIR.names if c in pairs.columns]
    pairs.select(F.to_json(F.struct(*own)).alias("value")).write.mode(mode).text(path)


def append_pairs(pairs: DataFrame, path: str) -> None:
    """Pairs appended to those that are there."""
    write_pairs(pairs, path, "append")


def load_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Preference pairs; blank lines are skipped, bad JSON and missing prompt, chosen or rejected raise."""
    rows = spark.read.text(path).where(X.strip("value") != "").select(F.from_json("value", PAIR, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    need = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"a pair has no {c}")).cast("string")).alias(c)
    return rows.select(*[need(c) for c in ("prompt", "chosen", "rejected")], *PAIR.names[3:])
