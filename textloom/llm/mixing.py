"""Mixing sources to target weights as a time-varying curriculum.

Sources, ordered by code point with null last, weigh `weights` in turn. They share `budget` times all words; a target
stops at `most` times its source's size and the excess is shared anew by weight. Sorted by size over weight this is one
pass: a source is full if its share of what is left, among those not yet full, reaches its stop.

Training time runs from 0 to 1. A source's weight at time t is target * (1 + slope * (2t - 1)): flat, rising or falling.
Its integral, the words that are demanded up to t, is target * (t + slope * (t*t - t)). The source's documents queue in
the order of the md5 of their id and their text's md5, once for each pass; a copy whose middle word is the demand at time t has training position t,
and one whose middle word lies beyond the target has none and isn't taken. So the words taken miss the target by half a
document at most, and no document is taken more than `most` (2) times. `mix` range-sorts the copies by
position; `plan` does the same without the texts and sums up for each document what the sorted mix holds.

Queue places come from sums over (source, first digits of the md5) and a running sum inside each such bucket, so a hot
source is spread over 4,096 tasks, and null ids by their texts. Sources can be as many as hosts: their order and the
sharing are running sums over range partitions.

Defined cases: null or empty texts have size 0 and are never taken; null ids queue as the empty id; repeated rows are
separate documents; an empty table gives no rows. Further columns, of any name, are passed through by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import running_before
from .common import materialise

WEIGHTS, BUDGET, MOST = (5, 2, 1), 1.5, 2
SLOPES = (0.0, 1.0, -1.0)  # of the weights' schedules: flat, rising, falling
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _in_turn(values, place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), ((place - 1) % len(values) + 1).cast("int"))


def _queued(docs: DataFrame) -> DataFrame:
    """(row, doc_id, size, from, key, bucket): the documents' own columns are inside `row`."""
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", words().alias("size"), source.alias("from"), key.alias("key"))
    return rows.withColumn("bucket", F.substring("key", 1, 3))


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST, slopes=SLOPES) -> DataFrame:
    """From (from, source_size), one row for each source ("=" and its name, or "-" for null): (from, source_size, target, slope)."""
    null_last = [F.col("from") == "-", F.col("from")]
    placed = running_before(sizes.select("from", "source_size", F.lit(1).alias("one")), null_last, {"place": "one"}).withColumn("place", F.col("place") + 1)
    placed = placed.withColumn("weight", _in_turn(weights, F.col("place"))).withColumn("slope", _in_turn(slopes, F.col("place")))
    total, weight = placed.agg(F.sum("source_size"), F.sum("weight")).first()
    if total is None:
        return placed.select("from", "source_size", F.lit(0.0).alias("target"), "slope")
    out = running_before(placed, [F.col("source_size") / F.col("weight"), F.col("place")], {"sizes_before": "source_size", "weights_before": "weight"})
    out = out.withColumn("left", F.lit(budget * total) - most * F.col("sizes_before")).withColumn("sharing", F.lit(weight) - F.col("weights_before"))
    out = out.withColumn("stop", (most * F.col("source_size")).cast("double")).withColumn("full", F.col("left") * F.col("weight") >= F.col("stop") * F.col("sharing"))
    level = out.where(~F.col("full")).agg(F.max(F.col("left") / F.col("sharing"))).first()[0]  # None where all are full
    target = F.when(F.col("full"), F.col("stop")).otherwise(F.lit(level).cast("double") * F.col("weight"))
    return out.select("from", "source_size", target.alias("target"), "slope")


def _time(share: Column, slope: Column) -> Column:
    """The time t with t + slope * (t*t - t) = share."""
    b = 1 - slope
    return F.when(slope == 0, share).otherwise((F.sqrt(b * b + 4 * slope * share) - b) / (2 * F.when(slope == 0, 1.0).otherwise(slope)))


def curriculum(docs: DataFrame, **settings) -> DataFrame:
    """(row, doc_id, size, source_size, target, from, end, positions): the training positions of the copies taken; end: the
    words of the source's queue up to the document's last."""
    queued = _queued(docs)
    buckets = materialise(queued.groupBy("from", "bucket").agg(F.sum("size").alias("sum")))
    sizes = buckets.groupBy("from").agg(F.sum("sum").alias("source_size"))
    before = Window.partitionBy("from").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 rows for each source
    starts = buckets.select("from", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    starts = starts.join(targets(sizes, **settings), "from")
    inside = Window.partitionBy("from", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = queued.withColumn("to", F.sum("size").over(inside)).join(starts, ["from", "bucket"])
    middle = F.col("start") + F.col("to") - F.col("size") / 2
    most = settings.get("most", MOST)
    copies = [F.when((F.col("size") > 0) & (middle + k * F.col("source_size") < F.col("target")), _time((middle + k * F.col("source_size")) / F.col("target"), F.col("slope"))) for k in range(most)]
    end = (F.col("start") + F.col("to")).cast("long").alias("end")
    return out.select("row", "doc_id", "size", "source_size", "target", "from", end, F.array_compact(F.array(*copies)).alias("positions"))


def plan(docs: DataFrame, **settings) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, first_position, first_start.

    The last three come from the mix itself: all copies, range-sorted by position, each with the words that the mix holds
    before it (of which first_start is the first copy's).
    """
    docs = docs.select("doc_id", "source", "text")
    dealt = materialise(curriculum(docs, **settings).select("doc_id", "size", "source_size", "target", "from", "end", "positions"))
    copies = dealt.select("from", "end", "size", "doc_id", F.explode("positions").alias("position"))
    ordered = running_before(copies, ["position", "doc_id", "from", "end"], {"start": "size"})
    key = ["from", "end", "size"]  # only documents of size 0 share an end with another one of their source
    taken = ordered.groupBy(*key).agg(F.sum("size").alias("taken"), F.min("position").alias("position"), F.min("start").alias("first_start"))
    out = dealt.join(taken, key, "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.round("position", 6).alias("first_position"), "first_start")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The taken copies in the documents' own columns, range-sorted by training position."""
    return curriculum(docs, **settings).select("row", "doc_id", F.explode("positions").alias("position")).orderBy("position", "doc_id").select("row.*")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, CASE (place - 1) % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS slope FROM p),
r AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER o, 0) AS remaining,
    sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS sharing
  FROM w WINDOW o AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT *, remaining * weight >= 2.0::DOUBLE * source_size * sharing AS is_full FROM r),
t AS (SELECT *, CASE WHEN is_full THEN 2.0::DOUBLE * source_size ELSE (SELECT max(remaining / sharing) FROM f WHERE NOT is_full) * weight END AS target FROM f),
q AS (
  SELECT doc_id, size, source_size, target, slope,
    sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2 AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), y AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE (middle < target)::INT + (middle + source_size < target)::INT END AS copies, middle / target AS share FROM q
)
SELECT doc_id, size, source_size, target, size * copies AS taken,
  CASE WHEN copies = 0 THEN NULL ELSE round(CASE WHEN slope = 0 THEN share ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) END, 6) END AS first_position
FROM y
"""
