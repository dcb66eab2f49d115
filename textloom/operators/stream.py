"""The flat token stream of a corpus, its split, its windows and batches.

A document's place is the number of tokens before it, by running sums over range partitions, so tokens are placed without
a sort of the stream: documents are shuffled and written once, whole. Batches and windows slice documents; only stored
streams are handled token by token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise
from .order import running_before


def placed(encoded: DataFrame, eot: int | None = None) -> DataFrame:
    """(start, n, doc_id, ids): each document's tokens, their number and the position of the first, in the order of doc_id.

    Rows of one id are documents of their own, in the order of a hash of their tokens; those without an id come last.
    Null ids of tokens count as none. The encoding is written once; only ids, hashes and lengths are sorted, and the starts joined back.
    """
    ids = F.col("ids") if eot is None else F.concat("ids", F.array(F.lit(eot)))
    sized = encoded.select("doc_id", F.coalesce(ids, F.array().cast(encoded.schema["ids"].dataType)).alias("ids"), F.monotonically_increasing_id().alias("row"))
    rows = materialise(sized.withColumn("n", F.size("ids").cast("long")).withColumn("hash", F.xxhash64("ids")))
    starts = running_before(rows.select("doc_id", "hash", "row", "n"), [F.col("doc_id").isNull(), F.col("doc_id"), F.col("hash"), F.col("row")], {"start": "n"})
    return rows.join(starts.select("row", "start"), "row").select("start", "n", "doc_id", "ids")


def places(docs: DataFrame, size: Column, text: str = "text") -> DataFrame:
    """(doc_id, digest, copies, n, start): where documents of `size` tokens will stand, without encoding them.

    A row for equal documents, which stand one after the other; the order is that of doc_id, null last, and of the digest.
    """
    digest = F.unhex(F.md5(F.coalesce(F.concat(F.lit("="), F.col(text)), F.lit("-"))))
    sized = docs.select("doc_id", digest.alias("digest"), F.coalesce(size.cast("long"), F.lit(0)).alias("n")).groupBy("doc_id", "digest", "n").agg(F.count("*").alias("copies"))
    sized = materialise(sized.withColumn("all", F.col("n") * F.col("copies")))
    return running_before(sized, [F.col("doc_id").isNull(), F.col("doc_id"), F.col("digest")], {"start": "all"}).select("doc_id", "digest", "copies", "n", "start")


def drawn_documents(docs: DataFrame, placed_: DataFrame, starts: DataFrame, seq_len: int, encode, span: int = 1 << 16, text: str = "text") -> DataFrame:
    """(start, n, doc_id, ids) of the documents that drawn windows meet: only these are encoded, by encode(documents) -> (doc_id, ids)."""
    block = lambda pos: F.floor(pos / span)
    copies = placed_.where("n > 0").withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: F.col("start") + k * F.col("n"))))
    copies = copies.withColumn("block", F.explode(F.sequence(block(F.col("start")), block(F.col("start") + F.col("n") - 1))))
    wanted = starts.select(F.col("start").alias("at")).withColumn("block", F.explode(F.sequence(block(F.col("at")), block(F.col("at") + seq_len))))
    met = copies.join(wanted, "block").where((F.col("start") <= F.col("at") + seq_len) & (F.col("start") + F.col("n") > F.col("at")))
    met = materialise(met.select("doc_id", "digest", "start", "n").distinct())
    digest = F.unhex(F.md5(F.coalesce(F.concat(F.lit("="), F.col(text)), F.lit("-"))))
    some = docs.select(F.struct("doc_id", digest.alias("digest")).alias("doc_id"), F.col(text).alias("text"))
    keys = met.select(F.struct("doc_id", "digest").alias("doc_id")).distinct()
    some = some.join(keys, some["doc_id"].eqNullSafe(keys["doc_id"]), "left_semi").dropDuplicates(["doc_id"])
    ids = encode(some).select(F.col("doc_id").alias("key"), "ids")
    return met.join(ids, F.struct("doc_id", "digest").eqNullSafe(F.col("key"))).select("start", "n", "doc_id", "ids")


def first_documents(docs: DataFrame, least: Column, n: int) -> DataFrame:
    """The documents, in the order of placed ones, that hold the first n tokens, and perhaps some more.

    least: at least so many tokens a document has (its pretokens, say), so the rest need not be encoded.
    """
    sized = docs.select("doc_id", least.cast("long").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"))
    last = running_before(sized, [F.col("doc_id").isNull(), F.col("doc_id")], {"before": "n"}).where(F.col("before") < n)
    bounds = last.agg(F.max("doc_id").alias("id"), F.max(F.col("doc_id").isNull()).alias("null")).first()
    inside = F.col("doc_id") <= F.lit(bounds["id"])
    return docs.where(F.coalesce(inside, F.lit(bool(bounds["null"])))) if bounds["null"] is not None else docs


def token_stream(documents: DataFrame) -> DataFrame:
    """(pos, doc_id, token_id) of placed documents."""
    return documents.select("start", "doc_id", F.posexplode("ids").alias("at", "token_id")).select((F.col("start") + F.col("at")).alias("pos"), "doc_id", "token_id")


def count_tokens(documents: DataFrame) -> int:
    return documents.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def meta(stream: DataFrame, vocab_size: int) -> DataFrame:
    kind = F.when(F.lit(vocab_size) <= 65536, "uint16").otherwise("uint32")
    return stream.agg(F.count("*").alias("num_tokens"), kind.alias("dtype"))


def cut_at(n: int, val_fraction: float) -> int:
    if not 0 < val_fraction < 1:
        raise ValueError(f"val_fraction must lie between 0 and 1, got {val_fraction}")
    return int(n * (1 - val_fraction))


def split_train_val(stream: DataFrame, val_fraction: float, n: int | None = None) -> DataFrame:
    """The stream with `split`: the last val_fraction of the positions is 'val'."""
    n = stream.count() if n is None else n
    return stream.withColumn("split", F.when(F.col("pos") < cut_at(n, val_fraction), "train").otherwise("val"))


def windows(stream: DataFrame, seq_len: int, max_windows: int | None = None, n: int | None = None) -> DataFrame:
    """(window_id, x, y): windows of seq_len tokens from the start and the same shifted by one.

    For a stored stream. Each token belongs to its window and, at a window's first place, to the one before as its last
    target: a grouping without a join that shuffles seq_len + 1 tokens for each window.
    """
    n = stream.count() if n is None else n
    count = max(0, (n - 1) // seq_len) if n else 0
    count = count if max_windows is None else min(count, max_windows)
    own = F.floor(F.col("pos") / seq_len).cast("long")
    ids = F.when(F.col("pos") % seq_len == 0, F.array(own, own - 1)).otherwise(F.array(own))
    rows = stream.select("pos", "token_id", F.explode(ids).alias("window_id")).where((F.col("window_id") >= 0) & (F.col("window_id") < count))
    grouped = rows.groupBy("window_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token_id"))), lambda s: s["token_id"]).alias("w"))
    return grouped.select("window_id", F.slice("w", 1, seq_len).alias("x"), F.slice("w", 2, seq_len).alias("y"))


def document_windows(documents: DataFrame, seq_len: int, max_windows: int | None = None) -> DataFrame:
    """windows() of placed documents: whole stretches of tokens are shuffled, a row for each document and window."""
    n = count_tokens(documents)
    count = max(0, (n - 1) // seq_len) if n else 0
    count = count if max_windows is None else min(count, max_windows)
    start, size = F.col("start"), F.size("ids")
    low, high = F.greatest(F.floor((start - 1) / seq_len), F.lit(0)), F.least(F.floor((start + size - 1) / seq_len), F.lit(count - 1))

    def stretch(w):
        begin = F.greatest(w * seq_len, start)
        end = F.least(w * seq_len + seq_len + 1, start + size)
        return F.struct(w.alias("window_id"), begin.alias("pos"), F.slice("ids", (begin - start + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int")).alias("ids"))

    parts = documents.where((size > 0) & (low <= high)).select(F.explode(F.transform(F.sequence(low, high), stretch)).alias("p")).select("p.*")
    w = parts.groupBy("window_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda s: s["ids"])).alias("w"))
    return w.select("window_id", F.slice("w", 1, seq_len).alias("x"), F.slice("w", 2, seq_len).alias("y"))


def sequential_batches(windowed: DataFrame, batch: int, max_batches: int) -> DataFrame:
    """(batch_id, row, x, y) of the first batch * max_batches windows."""
    w = windowed.where(F.col("window_id") < batch * max_batches)
    return w.select(F.floor(F.col("window_id") / batch).alias("batch_id"), (F.col("window_id") % batch).cast("int").alias("row"), "x", "y")


def shifted_targets(documents: DataFrame) -> DataFrame:
    """(pos, input, target): each token of placed documents and the next one.

    Inside a document the shift needs no other row; its last token meets the first of the next document by an equi-join
    of one row for each document.
    """
    some = documents.where(F.size("ids") > 0).withColumn("_next", F.col("start") + F.size("ids"))
    firsts = documents.where(F.size("ids") > 0).select(F.col("start").alias("_next"), F.get("ids", F.lit(0)).alias("_first"))
    after = F.concat(F.slice("ids", F.lit(2), F.size("ids")), F.array("_first"))
    pairs = some.join(firsts, "_next", "left").select("start", F.posexplode(F.arrays_zip(F.col("ids").alias("input"), after.alias("target"))).alias("at", "p"))
    return pairs.where("p.target IS NOT NULL").select((F.col("start") + F.col("at")).alias("pos"), "p.input", "p.target")


def batch_starts(spark, batches: int, batch: int, n: int, seq_len: int, seed: int = 0) -> DataFrame:
    """(batch_id, row, start): windows drawn by a hash of seed, batch and row, so a batch's number is all its state."""
    if n < seq_len + 1:
        raise ValueError(f"{seq_len + 1} tokens or more are needed, got {n}")
    rows = spark.range(batches * batch).select(F.floor(F.col("id") / batch).alias("batch_id"), (F.col("id") % batch).alias("row"))
    return rows.withColumn("start", F.pmod(_hash(F.lit(seed), "batch_id", "row"), F.lit(n - seq_len)))


def _hash(*columns) -> Column:
    """A whole number from the md5 of the columns' texts: any SQL engine gives the same."""
    joined = F.concat_ws(":", *[F.col(c) if isinstance(c, str) else c for c in columns])
    return F.conv(F.substring(F.md5(joined), 1, 12), 16, 10).cast("long")


def random_batches(stream: DataFrame, starts: DataFrame, seq_len: int) -> DataFrame:
    """(batch_id, row, x, y): the drawn windows of a stored stream, gathered by an equi-join on the positions they cover."""
    wanted = starts.select("batch_id", "row", F.posexplode(F.sequence("start", F.col("start") + seq_len)).alias("k", "pos"))
    got = wanted.join(stream.select("pos", "token_id"), "pos")
    w = got.groupBy("batch_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "token_id"))), lambda s: s["token_id"]).alias("w"))
    return w.select("batch_id", "row", F.slice("w", 1, seq_len).alias("x"), F.slice("w", 2, seq_len).alias("y"))


def document_batches(documents: DataFrame, starts: DataFrame, seq_len: int, span: int = 1 << 16) -> DataFrame:
    """random_batches() of placed documents: a drawn window meets the documents that it covers in blocks of `span` positions.

    Tokens aren't made rows: each document gives the stretch that lies in the window.
    """
    block = lambda pos: F.floor(pos / span)
    first, last = F.col("start"), F.col("start") + F.col("n") - 1
    docs = documents.where("n > 0").withColumn("low", block(first)).withColumn("block", F.explode(F.sequence("low", block(last))))
    wanted = starts.select("batch_id", "row", F.col("start").alias("at")).withColumn("at_low", block(F.col("at")))
    wanted = wanted.withColumn("block", F.explode(F.sequence("at_low", block(F.col("at") + seq_len))))
    met = docs.join(wanted, "block").where((F.col("block") == F.greatest("low", "at_low")) & (first <= F.col("at") + seq_len) & (last >= F.col("at")))
    begin, end = F.greatest("at", first), F.least(F.col("at") + seq_len, last)
    parts = met.select("batch_id", "row", F.struct(begin.alias("pos"), F.slice("ids", (begin - first + 1).cast("int"), (end - begin + 1).cast("int")).alias("ids")).alias("p"))
    w = parts.groupBy("batch_id", "row").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda s: s["ids"])).alias("w"))
    return w.select("batch_id", "row", F.slice("w", 1, seq_len).alias("x"), F.slice("w", 2, seq_len).alias("y"))


def shuffled_split(pairs: DataFrame, key: str, val_fraction: float, seed: int = 0) -> DataFrame:
    """pairs with place (from 1, in the order of a hash) and split: the first floor(n * val_fraction) are 'val'.

    The place is the rows in lower hash ranges plus the rank inside the own range.
    """
    placed = _placed(pairs, key, seed)
    n = pairs.count()
    return placed.withColumn("split", F.when(F.col("place") <= int(n * val_fraction), "val").otherwise("train"))


def _placed(rows: DataFrame, key: str, seed) -> DataFrame:
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    rows = rows.withColumn("_h", h).withColumn("_range", F.substring("_h", 1, 3))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 rows at most
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_h", key))
    return rows.join(starts, "_range").withColumn("place", (F.col("_start") + inside).cast("long")).drop("_h", "_range", "_start")


def epoch_batches(rows: DataFrame, key: str, batch: int, epochs: int, seed: int = 0) -> DataFrame:
    """rows for each epoch in that epoch's hash order, with step (from 0) and batch_row; the last batch may be smaller."""
    parts = []
    for epoch in range(epochs):
        placed = _placed(rows, key, f"{seed}/{epoch}")
        at = F.col("place") - 1
        parts.append(placed.select(F.lit(epoch).alias("epoch"), F.floor(at / batch).alias("step"), (at % batch).alias("batch_row"), *rows.columns))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
