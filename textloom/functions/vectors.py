"""Array expressions of the model's layers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def rms_norm(x: Column, gain: Column | None = None, eps: float = 1e-6) -> Column:
    scale = F.sqrt(_sum(F.transform(x, lambda v: v * v)) / F.size(x) + F.lit(eps))
    out = bound(scale, lambda r: F.transform(x, lambda v: v / r))
    return F.zip_with(out, gain, lambda v, g: v * g) if gain is not None else out


def _angle(position: Column, i: Column, size: int, base: float) -> Column:
    return position * F.pow(F.lit(float(base)), -2.0 * i / F.lit(float(size)))


def rope(x: Column, position: Column, size: int, base: float = 10000.0, max_seq_len: int | None = None) -> Column:
    """Rotate a vector of `size` numbers by its position: its first half pairs with its second."""
    if size % 2:
        raise ValueError(f"the size of a rotated vector must be even, got {size}")
    if max_seq_len is not None:
        position = F.when(position < max_seq_len, position).otherwise(F.raise_error(F.lit(f"position beyond {max_seq_len}")).cast("long"))
    half = size // 2
    a, b = F.slice(x, 1, half), F.slice(x, half + 1, half)
    turned = lambda one, other, sign: F.transform(one, lambda v, i: v * F.cos(_angle(position, i, size, base)) + sign * F.get(other, i) * F.sin(_angle(position, i, size, base)))
    return F.concat(turned(a, b, -1.0), turned(b, a, 1.0))


def swiglu_hidden(d: Column | int, multiple: Column | int = 64) -> Column:
    """The next multiple of `multiple` from floor(8d / 3)."""
    d, multiple = (F.lit(x) if isinstance(x, int) else x for x in (d, multiple))
    return (F.ceil(F.floor(8 * d / 3) / multiple) * multiple).cast("int")


def matrix_times(rows: list[list[float]], x: Column) -> Column:
    return F.array(*[dot(F.array(*map(F.lit, map(float, row))), x) for row in rows])


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def swiglu(x: Column, gate: list[list[float]], up: list[list[float]], down: list[list[float]]) -> Column:
    inner = F.zip_with(matrix_times(gate, x), matrix_times(up, x), lambda g, u: silu(g) * u)
    return matrix_times(down, inner)


def softmax(x: Column) -> Column:
    shares = lambda e: bound(_sum(e), lambda total: F.transform(e, lambda v: v / total))
    return bound(bound(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top))), shares)


def log_softmax_at(x: Column, target: Column) -> Column:
    """Log probability of the (0-based) target among logits x."""
    return bound(F.array_max(x), lambda top: F.get(x, target) - top - F.log(_sum(F.transform(x, lambda v: F.exp(v - top)))))


def top_k_mask(x: Column, k: int) -> Column:
    """Logits below the k-th largest as null; ties with it stay."""
    least = F.get(F.sort_array(x, asc=False), F.least(F.lit(k), F.size(x)) - 1)
    return bound(least, lambda low: F.transform(x, lambda v: F.when(v >= low, v)))


def sample_index(x: Column, draw: Column, temperature: float, k: int | None = None) -> Column:
    """The (0-based) index drawn from logits x: of the k largest and their ties, by their softmax at the temperature.

    draw: a number from 0 to below 1 for each row; temperature 0 takes the first largest.
    """
    if temperature < 0:
        raise ValueError(f"the temperature must not be negative, got {temperature}")
    if temperature == 0:
        return (F.array_position(x, F.array_max(x)) - 1).cast("long")
    kept = x if k is None else F.transform(top_k_mask(x, k), lambda v: F.coalesce(v, F.lit(float("-inf"))))
    start = F.struct(F.lit(0.0).alias("upto"), F.lit(0).cast("long").alias("at"))
    step = lambda u: lambda a, p: F.struct((a["upto"] + p).alias("upto"), (a["at"] + F.when(a["upto"] + p <= u, 1).otherwise(0)).cast("long").alias("at"))
    found = bound(draw, lambda u: F.aggregate(softmax(F.transform(kept, lambda v: v / F.lit(float(temperature)))), start, step(u), lambda a: a["at"]))
    return F.least(found, F.size(x).cast("long") - 1)


def num_params(vocab: int, d: int, layers: int, hidden: int, tied: bool = False) -> int:
    """Parameters of embeddings, attention, gated layers and norms."""
    return vocab * d * (1 if tied else 2) + layers * (4 * d * d + 3 * d * hidden + 2 * d) + d
