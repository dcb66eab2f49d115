"""Running sums and prefixes over a global order, without gathering rows in one task.

Rows are range-partitioned by the order, so hashed, sparse or repeated keys make no difference; only one sum for each
partition goes through a single task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import discard, materialise, unused

def _sums_of(values: list[str], part: str, names: list[str]):
    """A function of Arrow batches that adds the partition's number and the sums over the partition's earlier rows."""

    def summed(batches):
        from pyspark import TaskContext

        held, number = [0] * len(values), TaskContext.get().partitionId()
        for batch in batches:
            added = [pa.array(np.full(batch.num_rows, number, np.int64))]
            for k, v in enumerate(values):
                own = pc.fill_null(batch.column(v).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
                upto = np.cumsum(own) + held[k]
                added.append(pa.array(upto - own))
                held[k] = int(upto[-1]) if len(upto) else held[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, part, *names])

    return summed


def running_before(df: DataFrame, order: list[str | Column], sums: dict[str, str]) -> DataFrame:
    """df with, for each new column of `sums`, the sum of a whole-number column over all rows before this one in the order.

    Rows that are equal in the order stand in any order among themselves, the same for all sums; they share a partition,
    so an order with a last column that tells rows apart splits them. Null values count as 0. The result is written.
    """
    part = unused("part", df)
    inside = {out: unused(f"inside_{out}", df) for out in sums}
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    added = [T.StructField(c, T.LongType()) for c in (part, *inside.values())]
    rows = materialise(placed.mapInArrow(_sums_of(list(sums.values()), part, list(inside.values())), T.StructType([*df.schema.fields, *added])))
    whole = rows.groupBy(part).agg(*[F.sum(value).alias(inside[out]) for out, value in sums.items()])
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = whole.select(part, *[F.coalesce(F.sum(inside[out]).over(earlier), F.lit(0)).alias(out) for out in sums])
    joined = rows.join(F.broadcast(starts), part)  # as many rows as shuffle partitions
    return joined.select(*df.columns, *[(F.col(out) + F.col(inside[out])).cast("long").alias(out) for out in sums])


def first_kept(df: DataFrame, order: list[str], kept: str, n: int) -> DataFrame:
    """The rows up to the n-th kept one in the order: those before which fewer than n rows are kept. Rows equal in the order stay together.

    Only the order's columns are sorted, by ranges; the rows themselves are filtered by the last of them.
    """
    if n <= 0:
        return df.limit(0)
    before, one = unused("before", df), unused("one", df)
    narrow = materialise(df.select(*order, F.coalesce(F.col(kept), F.lit(False)).cast("int").alias(one)))  # sampling and sorting would ask for `kept` each
    last = running_before(narrow, [*map(F.col, order)], {before: one}).where(F.col(before) < n).agg(F.max(F.struct(*order)).alias("last")).first()["last"]
    discard(narrow)
    if last is None:
        return df
    return df.where(F.struct(*order) <= F.struct(*[F.lit(last[c]).cast(df.schema[c].dataType).alias(c) for c in order]))
