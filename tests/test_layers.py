import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import vectors as V
from textloom.operators import layers


def test_attention_of_heads_equals_a_plain_one(spark):
    draw = random.Random(1)
    vec = lambda: [draw.gauss(0, 2) for _ in range(6)]
    rows = {s: [(vec(), vec(), vec()) for _ in range(5)] for s in ("a", "b")}
    cache = spark.createDataFrame([(s, i, k, v) for s, r in rows.items() for i, (_, k, v) in enumerate(r)], "seq string, pos long, k array<double>, v array<double>")
    asked = spark.createDataFrame([(s, i, q) for s, r in rows.items() for i, (q, _, _) in enumerate(r) if i >= 2], "seq string, pos long, q array<double>")  # behind a cache of two
    for r in layers.causal_attention(asked, cache, 3, 6).collect():
        for h in range(3):
            at = slice(2 * h, 2 * h + 2)
            seen = rows[r["seq"]][: r["pos"] + 1]
            w = [math.exp(sum(x * y for x, y in zip(r["q"][at], k[at])) / math.sqrt(2)) for _, k, _ in seen]
            want = [sum(a * v[at][j] for a, (_, _, v) in zip(w, seen)) / sum(w) for j in range(2)]
            assert all(abs(x - y) < 1e-9 for x, y in zip(r["out"][at], want))
    large = spark.createDataFrame([("a", 0, [1e4] * 2, [1e4] * 2, [3.0, 4.0])], "seq string, pos long, q array<double>, k array<double>, v array<double>")
    assert layers.causal_attention(large.select("seq", "pos", "q"), large.select("seq", "pos", "k", "v"), 1, 2).first()["out"] == [3.0, 4.0]
    with pytest.raises(ValueError):
        layers.causal_attention(asked, cache, 4, 6)


def test_draws_follow_the_softmax_of_the_largest(spark):
    x = F.array(*map(F.lit, [0.0, 2.0, 1.0, -5.0]))
    draws = spark.range(1000).select(V.sample_index(x, F.col("id") / 1000.0, 0.5, 3).alias("t")).groupBy("t").count().collect()
    weights = [math.exp(v / 0.5) for v in (0.0, 2.0, 1.0)]
    assert {r["t"] for r in draws} == {0, 1, 2} and all(abs(r["count"] / 1000 - weights[r["t"]] / sum(weights)) < 0.003 for r in draws)
    assert spark.range(1).select(V.sample_index(x, F.lit(0.9), 0.0).alias("t")).first()["t"] == 1
    with pytest.raises(ValueError):
        V.sample_index(x, F.lit(0.5), -1.0)


def test_embedding_look_up(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "id long, vector array<double>")
    got = layers.embedded(spark.createDataFrame([(0, 1), (1, 0)], "pos long, token_id long"), table).collect()
    assert {r["pos"]: r["vector"] for r in got} == {0: [2.0], 1: [1.0]}
    with pytest.raises(Exception, match="unknown id"):
        layers.embedded(spark.createDataFrame([(0, 5)], "pos long, token_id long"), table).collect()


def plain_attention(q, k, v, heads, offset=0):
    width, out = q.shape[1] // heads, np.zeros_like(q)
    for h in range(heads):
        part = slice(h * width, (h + 1) * width)
        scores = q[:, part] @ k[:, part].T / np.sqrt(width)
        scores[np.arange(len(k))[None] > np.arange(len(q))[:, None] + offset] = -np.inf
        weight = np.exp(scores - scores.max(1, keepdims=True))
        out[:, part] = weight / weight.sum(1, keepdims=True) @ v[:, part]
    return out


@pytest.mark.parametrize(("n", "block", "offset"), [(4096, 256, 0), (37, 8, 0), (20, 8, 13), (5, 64, 0)])
def test_attention_by_tiles(spark, n, block, offset):
    draws = np.random.default_rng(n)
    q, k, v = draws.standard_normal((n, 8)) * 3, draws.standard_normal((n + offset, 8)) * 3, draws.standard_normal((n + offset, 8))
    k[1] *= 300  # scores whose exponentials overflow
    rows = lambda **x: spark.createDataFrame([(7, i, *(a[i].tolist() for a in x.values())) for i in range(len(next(iter(x.values()))))], f"seq int, pos long, {', '.join(f'{c} array<double>' for c in x)}")
    asked = rows(q=q).selectExpr("seq", f"pos + {offset} AS pos", "q", "'x' AS note").repartition(3)
    got = layers.causal_attention(asked, rows(k=k, v=v), 2, 8, block=block)
    assert got.columns == ["seq", "pos", "q", "note", "out"]
    found = {r["pos"] - offset: r["out"] for r in got.collect()}
    assert np.allclose([found[i] for i in range(n)], plain_attention(q, k, v, 2, offset), atol=1e-9)


def test_states_merge_in_any_order():
    draws = np.random.default_rng(3)
    q, k, v = draws.standard_normal((5, 8)), draws.standard_normal((30, 8)), draws.standard_normal((30, 8))
    seen = draws.random((5, 30)) < 0.4
    seen[4] = False
    whole = layers.tile_states(q, k, v, seen, 2)
    parts = [layers.tile_states(q, k[a : a + 6], v[a : a + 6], seen[:, a : a + 6], 2) for a in range(0, 30, 6)]
    for order in ([0, 1, 2, 3, 4], [3, 0, 4, 2, 1]):
        state = parts[order[0]]
        for i in order[1:]:
            state = layers.merged_states(state, parts[i])
        pair = layers.merged_states(layers.merged_states(parts[0], parts[1]), layers.merged_states(parts[2], layers.merged_states(parts[3], parts[4])))
        assert all(np.allclose(a, b) and np.allclose(a, c) for a, b, c in zip(whole, state, pair))
