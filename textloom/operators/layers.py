"""Operators of the model's layers that need more than one row: causal attention and the embedding look-up."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 256


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def tile_states(q: np.ndarray, k: np.ndarray, v: np.ndarray, seen: np.ndarray, heads: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What queries (rows) know after some keys: for each head the largest score, the sum of exp(score - largest), and the values weighted by them.

    seen: which keys each query may see. A query that sees none has -inf, 0 and zeros.
    """
    width = q.shape[1] // heads
    split = lambda x: x.reshape(len(x), heads, -1).transpose(1, 0, 2)
    scores = np.where(seen[None], split(q) @ split(k).transpose(0, 2, 1) / np.sqrt(width), -np.inf)
    top = scores.max(2, initial=-np.inf)
    with np.errstate(invalid="ignore"):
        weight = np.where(seen[None], np.exp(scores - top[:, :, None]), 0.0)
    return top.T, weight.sum(2).T, (weight @ split(v)).transpose(1, 0, 2).reshape(len(q), -1)


def merged_states(one: tuple, other: tuple) -> tuple:
    """The state after the keys of both; in any order and grouping the same but for rounding."""
    top = np.maximum(one[0], other[0])
    with np.errstate(invalid="ignore"):
        a, b = (np.where(np.isneginf(x[0]), 0.0, np.exp(x[0] - top)) for x in (one, other))
    spread = lambda x, like: np.repeat(x, like.shape[-1] // x.shape[-1], axis=-1)
    return top, one[1] * a + other[1] * b, one[2] * spread(a, one[2]) + other[2] * spread(b, other[2])


def causal_attention(queries: DataFrame, cache: DataFrame, heads: int, size: int, seq: str = "seq", pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """queries (seq, pos, q, ...) with `out`: multi-head attention to the keys and values of earlier and the same positions.

    cache: (seq, pos, k, v); it may hold positions from before the queries' (an offset), as a cache of keys and values does.
    `size` numbers are cut into `heads` parts, each with a softmax of its own. Blocks of `block` queries meet blocks of as many keys in tiles,
    each of which gives a mergeable state for a query; a query's states are merged in passing, row by row. So what is shuffled
    is a row for each query and block of keys, and no task holds more than a tile, however long a sequence is. (seq, pos) is unique and not null.
    """
    if size % heads:
        raise ValueError(f"{size} numbers can't be cut into {heads} heads")
    own, theirs = "_block", "_keys"
    numbered = lambda df, name: df.withColumn(name, F.floor(F.col(pos) / block).cast("long"))
    asked = numbered(queries.select(seq, pos, "q"), own)
    keys = numbered(cache.select(seq, pos, "k", "v"), theirs)
    tiles = asked.select(seq, own).distinct().join(keys.select(seq, theirs).distinct(), seq).where(F.col(theirs) <= F.col(own))
    kinds = [queries.schema[c] for c in (seq, pos)]
    numbers = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("top", "total", "values")]

    def tile(one: pa.Table, other: pa.Table) -> pa.Table:
        q, k, v = _matrix(one["q"]).reshape(-1, size), _matrix(other["k"]).reshape(-1, size), _matrix(other["v"]).reshape(-1, size)
        seen = other[pos].to_numpy()[None] <= one[pos].to_numpy()[:, None]
        some = seen.any(1)
        states = tile_states(q, k, v, seen, heads) if len(k) else (np.zeros((len(q), heads)), np.zeros((len(q), heads)), np.zeros((len(q), size)))
        columns = [one[c].combine_chunks().filter(pa.array(some)) for c in (seq, pos)]
        return pa.Table.from_arrays([*columns, *(pa.array(list(s[some]), pa.list_(pa.float64())) for s in states)], names=[seq, pos, "top", "total", "values"])

    apart = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both sides may come from one frame
    left, right = apart(asked.join(tiles, [seq, own])), apart(keys.join(tiles, [seq, theirs]))
    states = left.groupBy(seq, own, theirs).cogroup(right.groupBy(seq, own, theirs)).applyInArrow(tile, T.StructType([*kinds, *numbers]))

    def merged(batches):
        held = None
        for batch in batches:
            done = []
            for s, p, *state in zip(*(batch.column(c).to_pylist() for c in (seq, pos, "top", "total", "values")), strict=True):
                state = tuple(map(np.array, state))
                if held is not None and held[0] == (s, p):
                    held = ((s, p), merged_states(held[1], state))
                else:
                    done += [held] if held is not None else []
                    held = ((s, p), state)
            yield finished(done)
        yield finished([held] if held is not None else [])

    def finished(done):
        out = [x[2] / np.repeat(x[1], size // heads) for _, x in done]
        columns = [pa.array([k[i] for k, _ in done], arrow.field(i).type) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.float64()))], names=[seq, pos, "out"])

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType(kinds))
    in_turn = states.repartition(seq, pos).sortWithinPartitions(seq, pos)
    found = in_turn.mapInArrow(merged, T.StructType([*kinds, T.StructField("out", T.ArrayType(T.DoubleType()))]))
    return queries.drop("out").join(found, [seq, pos])


def embedded(tokens: DataFrame, table: DataFrame, token: str = "token_id", row: str = "id", vector: str = "vector") -> DataFrame:
    """tokens with the vector of their id; an id that the table hasn't raises."""
    out = tokens.join(table.select(F.col(row).alias(token), F.col(vector).alias(vector)), token, "left")
    missing = F.raise_error(F.concat(F.lit("unknown id "), F.col(token).cast("string"))).cast(table.schema[vector].dataType)
    return out.withColumn(vector, F.coalesce(F.col(vector), missing))
