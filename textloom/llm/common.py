"""What the operators of this subpackage share: reading, materialising, folds and row keys."""

from __future__ import annotations

import ctypes

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, materialise, own_dir, shared_dir, unused  # noqa: F401

SALTS, ARROW_ROWS = 32, 1024
BYTES = 48 << 20  # of text that a fitting sample holds at most


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_HELD: dict[str, dict] = {}


def held(name: str) -> dict:
    """A table that a Python worker keeps from task to task, until it runs a function that doesn't name it."""
    return _HELD.setdefault(name, {})


def _drop(keep: tuple[str, ...]) -> None:
    for name, table in _HELD.items():
        if name not in keep:
            table.clear()


def _give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task holds no more than it uses."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc alone
        trim(0)


def tidy(work, *keep: str):
    """An Arrow function that gives its memory back at a task's end, and at the start what other functions left, but for `keep`."""

    def tidied(batches):
        _drop(keep)
        try:
            yield from work(batches)
        finally:
            _give_back()

    return tidied


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ARROW_ROWS rows at most in this session, as the operators cut them anyway: whole texts are large rows,
    and a batch is held by the JVM and the worker, both ways. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)


def parts(batch, rows: int, size: int = 16 << 20, column: str = "text"):
    """A record batch in pieces of at most `rows` rows and, but for single rows beyond it, `size` bytes of text or numbers."""
    held_by = batch.column(column)
    lengths = pc.multiply(pc.list_value_length(held_by), 8) if pa.types.is_list(held_by.type) else pc.binary_length(held_by)
    lengths = pc.fill_null(lengths, 0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= rows or held + n > size):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % parts


def row_key(*columns: str) -> Column:
    """A 128-bit key of a row's columns; rows that are equal in them share it, nulls differ from empty texts."""
    return F.unhex(F.md5(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns])))


def salt(*columns: str) -> Column:
    """One of SALTS numbers by a hash of the columns; nulls count as nothing."""
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def salts_held(by: Column) -> Column:
    """Aggregate: the salts that a group's rows have, as the bits of a number."""
    return F.bit_or(F.pow(F.lit(2.0), by).cast("long"))


def for_each_salt(table: DataFrame, held: str, name: str) -> DataFrame:
    """The table's rows once for each of the salts in its column `held`, which goes."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit(F.col(held), k) == 1)
    return table.withColumn(name, F.explode(bits)).drop(held)


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """rows with the table's one row for their keys. A key of very many rows stays spread over SALTS salts of `by`.

    The table's row is repeated only for the salts that its key's rows have. Keys must not be null.
    """
    s, held = unused("salt", rows, table), unused("salts", rows, table)
    salted = rows.withColumn(s, salt(by))
    masks = salted.groupBy(*keys).agg(salts_held(F.col(s)).alias(held))
    return salted.join(for_each_salt(table.join(masks, keys), held, s), [*keys, s], how).drop(s)


def with_least(rows: DataFrame, keys: list[str], value: str, out: str, count: str | None = None, having: str | None = None) -> DataFrame:
    """rows with the least `value` of the rows that share its keys (and their number, as `count`); keys without `having` go.

    One aggregation with partial sums, joined back once for each salt that the key has, so a key that a third of all rows
    share is never one task's. Keys must not be null.
    """
    s, held, n = unused("salt", rows), unused("salts", rows), count or unused("n", rows)
    salted = rows.withColumn(s, salt(value))
    whole = salted.groupBy(*keys).agg(F.min(value).alias(out), F.count("*").alias(n), salts_held(F.col(s)).alias(held))
    whole = whole if having is None else whole.where(having)
    return salted.join(for_each_salt(whole if count else whole.drop(n), held, s), [*keys, s]).drop(s)


def sampled_ids(labels: DataFrame, keep: Column, label: str, limit: int, kind: str = "int") -> DataFrame:
    """At most `limit` labelled ids with their label, by the order of md5(doc_id): the same rows on every run.

    An id that bears both labels takes the larger one; null ids and null labels are left out.
    """
    return (
        labels.where(keep & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max(F.col(label).cast(kind)).alias("label"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(limit)
    )


def texts_of(docs: DataFrame, ids: DataFrame, limit: int, size: int = BYTES):
    """The whole texts of at most `limit` sampled ids and `size` bytes in all, one for each id, as pandas (doc_id, text, label).

    Both bounds take the ids in the order of md5(doc_id); a text that would exceed `size` is left out.
    """
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).limit(limit)
    )
    upto = F.sum(F.octet_length("text")).over(Window.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id"))  # `limit` rows at most
    got = rows.withColumn("upto", upto).where(F.col("upto") <= size).drop("upto").toPandas()
    return got.sort_values("doc_id", kind="stable").reset_index(drop=True)
