"""Queries over preference optimisation's measures and the model's layers as array expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import layers as L
from ..operators import preference as P
from .texts import _TURNS as TURNS
from .texts import _turns as turns
from .texts import read

BETA = 0.5


def _r(c, name: str):
    return F.round(c, 6).alias(name)


EOT, ROOM = 99, 40


def _encoded(spark, d):
    """Candidates as pairs of ids, a word's length each: the text before, the text, and the text backwards."""
    lengths = lambda c: F.when(F.col(c) != "", F.transform(F.split(c, " "), F.length)).otherwise(F.array().cast("array<int>"))
    rows = turns(spark, d).select(F.floor(F.col("prompt_id") / 4).alias("batch_id"), (F.col("prompt_id") % 4 * 100 + F.col("cand_idx")).alias("row"), lengths("prompt").alias("prompt"), lengths("text").alias("chosen"))
    return P.encode_pairs(rows.withColumn("rejected", F.reverse("chosen")), eot=EOT, max_len=ROOM)


def _joined(c: str):
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


def encode_pairs(spark, d):
    return _encoded(spark, d).select("batch_id", "row", *map(_joined, ("prompt", "chosen", "rejected")))


def collate(spark, d):
    return P.collate(_encoded(spark, d), pad=0).select("batch_id", "seq_no", "which", _joined("idx"), _joined("mask"))


def _logprobs(spark, d):
    """Log probabilities drawn from the events' values."""
    v = F.col("value") / 100
    return read(spark, d, "events").select(F.col("event_type").alias("kind"), "event_id", (-v).alias("pc"), (-v * 2 + 1).alias("pr"), (-v - 0.5).alias("rc"), (-v * 1.5).alias("rr"))


def dpo_loss(spark, d):
    m = P.dpo_loss(_logprobs(spark, d), BETA)
    return m.select(*[_r(F.col(c), c) for c in m.columns])


def dpo_rewards(spark, d):
    r = P.rewards(_logprobs(spark, d), BETA)
    return r.select("event_id", *[_r(F.col(c), c) for c in ("chosen_reward", "rejected_reward", "margin", "loss")])


def batch_means(spark, d):
    """Means of batch means, weighted by size, are the means over all rows."""
    each = P.rewards(_logprobs(spark, d), BETA).groupBy("kind").agg(F.count("*").alias("n"), F.avg("loss").alias("loss"), F.avg("margin").alias("margin"))
    m = P.weighted_means(each, ["loss", "margin"])
    return m.select(_r(F.col("loss"), "loss"), _r(F.col("margin"), "margin"), _r(P.perplexity(F.col("loss")), "perplexity"))


def sequence_logprobs(spark, d):
    rows = read(spark, d, "events").select((F.col("event_id") % 50).alias("seq_no"), F.floor(F.col("event_id") / 50).alias("t"), (-F.col("value") / 100).alias("logp"), (F.col("event_id") % 3 != 0).cast("int").alias("mask"))
    return P.sequence_logprobs(rows).select("seq_no", _r(F.col("logp"), "logp"))


def batch_halves(spark, d):
    rows = read(spark, d, "events").select(F.floor(F.col("event_id") / 8).alias("batch_id"), (F.col("event_id") % 8).alias("seq_no"), (-F.col("value")).alias("logp"))
    out = P.batch_halves(rows)
    return out.select("batch_id", "row", _r(F.col("chosen"), "chosen"), _r(F.col("rejected"), "rejected"))


def d2z_schedule(spark, d):
    """Schedules and steps from the documents' numbers and lengths."""
    total = F.greatest(F.col("n_chars"), F.lit(1))
    steps = read(spark, d, "documents").select("doc_id", total.alias("total"), (F.col("doc_id") % total).alias("warmup"), (F.col("doc_id") * 7 % (total + 2)).alias("step"))
    m = P.d2z_multiplier(F.col("step"), F.col("total"), F.col("warmup"))
    return steps.select("doc_id", "total", "warmup", "step", _r(m, "multiplier"), _r(m * 3e-4, "lr"))


def _vectors(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def _parts(df, column, name: str = "value"):
    return df.select("vec_id", F.posexplode(column).alias("i", "x")).select("vec_id", "i", (F.round("x", 6) + 0.0).alias(name))  # no negative zero


def rmsnorm(spark, d):
    gain = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i / 64.0)
    return _parts(_vectors(spark, d), V.rms_norm(F.col("v"), gain))


def rope(spark, d):
    return _parts(_vectors(spark, d), V.rope(F.col("v"), F.col("vec_id") % 512, 64, max_seq_len=512))


def swiglu_dim(spark, d):
    sizes = read(spark, d, "documents").select("doc_id", F.col("n_chars").alias("d"), (F.col("doc_id") % 64 + 1).alias("multiple"))
    return sizes.select("doc_id", "d", "multiple", V.swiglu_hidden(F.col("d"), F.col("multiple")).cast("long").alias("hidden"))


HIDDEN_ROWS, WIDTH, HEADS, SEQ_ROWS = 8, 64, 4, 10


def _weight(i: int, j: int, k: int) -> float:
    """Weights of three matrices by a formula that SQL has too."""
    return ((i * 7 + j * 3 + k * 5) % 11 - 5) / 16


_GATE, _UP = ([[_weight(i, j, k) for j in range(WIDTH)] for i in range(HIDDEN_ROWS)] for k in (0, 1))
_DOWN = [[_weight(i, j, 2) for j in range(HIDDEN_ROWS)] for i in range(WIDTH)]


def swiglu(spark, d):
    return _parts(_vectors(spark, d), V.swiglu(F.col("v"), _GATE, _UP, _DOWN))


def softmax(spark, d):
    return _parts(_vectors(spark, d), V.softmax(F.transform("v", lambda x: x * 10)))


def softmax_causal(spark, d):
    """Causal attention of HEADS heads in sequences of 10 vectors, which are queries, keys and values at once."""
    rows = _vectors(spark, d).select(F.floor(F.col("vec_id") / SEQ_ROWS).alias("seq"), (F.col("vec_id") % SEQ_ROWS).alias("pos"), "vec_id", "v")
    out = L.causal_attention(rows.select("seq", "pos", "vec_id", F.col("v").alias("q")), rows.select("seq", "pos", F.col("v").alias("k"), "v"), HEADS, WIDTH)
    return _parts(out, F.col("out"))


def embedding_lookup(spark, d):
    """The vectors of the documents' ids modulo 500, as sums of their numbers times place."""
    tokens = read(spark, d, "documents").select("doc_id", (F.col("doc_id") % 500).alias("token_id"))
    out = L.embedded(tokens, _vectors(spark, d), row="vec_id", vector="v")
    return out.select("doc_id", "token_id", _r(V.dot(F.col("v"), F.transform(F.sequence(F.lit(1), F.lit(WIDTH)), lambda i: i.cast("double"))), "total"))


def sampled_next(spark, d):
    """A token drawn by a hash at temperature 0.7 among the 10 largest."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("5:"), F.col("vec_id").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return _vectors(spark, d).select("vec_id", V.sample_index(F.col("v"), draw, 0.7, 10).alias("token"))


def topk_mask(spark, d):
    kept = V.top_k_mask(F.col("v"), 5)
    return _vectors(spark, d).select("vec_id", F.posexplode(kept).alias("i", "logit")).where("logit IS NOT NULL").select("vec_id", "i", _r(F.col("logit"), "logit"))


def greedy_next(spark, d):
    return _vectors(spark, d).select("vec_id", (F.array_position("v", F.array_max("v")) - 1).alias("token"))


def cross_entropy(spark, d):
    rows = read(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"), "label")
    return rows.select((-V.log_softmax_at(F.col("v"), F.col("label"))).alias("l")).agg(_r(F.avg("l"), "loss"), _r(F.exp(F.avg("l")), "perplexity"))


def truncated_ids(spark, d):
    """Texts as their words' lengths; a word of nine letters ends them."""
    from ..operators import quality

    rows = read(spark, d, "conversations").select("conv_id", "turn", F.transform(F.split("text", " "), F.length).alias("ids"))
    return quality.truncated(rows, 9).select("conv_id", "turn", "finished", _joined("ids"))


def num_params(spark, d):
    c = F.col
    return read(spark, d, "documents").select("doc_id", V.num_params(c("n_chars"), c("doc_id") % 64 + 1, c("doc_id") % 7, c("n_chars") % 100).alias("n"))


_LOGP = "lp AS (SELECT event_type AS kind, event_id, -value / 100 AS pc, -value / 100 * 2 + 1 AS pr, -value / 100 - 0.5::DOUBLE AS rc, -value / 100 * 1.5::DOUBLE AS rr FROM events)"
_REWARDS = f"WITH {_LOGP}, rw AS (SELECT *, {BETA}::DOUBLE * (pc - rc) AS chosen_reward, {BETA}::DOUBLE * (pr - rr) AS rejected_reward FROM lp), m AS (SELECT *, chosen_reward - rejected_reward AS margin, greatest(-(chosen_reward - rejected_reward), 0) + ln(1 + exp(-abs(chosen_reward - rejected_reward))) AS loss FROM rw)"
_VALUES = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"
_LENGTHS = "CASE WHEN {0} = '' THEN []::INT[] ELSE list_transform(string_split({0}, ' '), lambda w: length(w)::INT) END"
_TRAINED = f"""(WITH {TURNS} SELECT prompt_id // 4 AS batch_id, prompt_id % 4 * 100 + cand_idx AS r, {_LENGTHS.format('prompt')} AS prompt, {_LENGTHS.format('text')} AS chosen, list_reverse({_LENGTHS.format('text')}) AS rejected FROM turns)"""
_ENC = f"enc AS (SELECT batch_id, r, prompt, list_slice(list_append(chosen, {EOT}), 1, {ROOM} - len(prompt)) AS chosen, list_slice(list_append(rejected, {EOT}), 1, {ROOM} - len(prompt)) AS rejected FROM {_TRAINED} WHERE len(prompt) > 0 AND len(prompt) < {ROOM})"


def _w(k: int) -> str:
    """SQL of the k-th matrix's weights: rows i, columns j."""
    rows, columns = (WIDTH, HIDDEN_ROWS) if k == 2 else (HIDDEN_ROWS, WIDTH)
    return f"(SELECT i, j, ((i * 7 + j * 3 + {k * 5}) % 11 - 5) / 16.0::DOUBLE AS w FROM (SELECT unnest(range(0, {rows})) AS i), (SELECT unnest(range(0, {columns})) AS j))"


ORACLES = {
    "encode_pairs": f"WITH {_ENC} SELECT batch_id, r AS \"row\", array_to_string(prompt, ',') AS prompt, array_to_string(chosen, ',') AS chosen, array_to_string(rejected, ',') AS rejected FROM enc",
    "collate": f"""WITH {_ENC}, s AS (SELECT batch_id, r, 0 AS which, prompt, chosen AS a FROM enc UNION ALL SELECT batch_id, r, 1, prompt, rejected FROM enc),
        w AS (SELECT *, max(len(prompt) + len(a)) OVER (PARTITION BY batch_id) - len(prompt) - len(a) AS gap, max(r) OVER (PARTITION BY batch_id) + 1 AS b FROM s)
        SELECT batch_id, which * b + r AS seq_no, which, array_to_string(list_concat(prompt, a, list_transform(range(0, gap), lambda i: 0)), ',') AS idx,
          array_to_string(list_concat(list_transform(prompt, lambda i: 0), list_transform(a, lambda i: 1), list_transform(range(0, gap), lambda i: 0)), ',') AS mask FROM w""",
    "dpo_loss": _REWARDS + " SELECT round(avg(loss), 6) AS loss, round(avg((margin > 0)::INT), 6) AS reward_accuracy, round(avg(margin), 6) AS reward_margin, round(avg(chosen_reward), 6) AS chosen_reward, round(avg(rejected_reward), 6) AS rejected_reward FROM m",
    "dpo_rewards": _REWARDS + " SELECT event_id, round(chosen_reward, 6) AS chosen_reward, round(rejected_reward, 6) AS rejected_reward, round(margin, 6) AS margin, round(loss, 6) AS loss FROM m",
    "batch_means": _REWARDS + " SELECT round(avg(loss), 6) AS loss, round(avg(margin), 6) AS margin, round(exp(avg(loss)), 6) AS perplexity FROM m",
    "sequence_logprobs": "SELECT event_id % 50 AS seq_no, round(sum(CASE WHEN event_id % 3 <> 0 THEN -value / 100 ELSE 0 END), 6) AS logp FROM events WHERE event_id // 50 >= 1 GROUP BY 1",
    "batch_halves": """WITH b AS (SELECT event_id // 8 AS batch_id, event_id % 8 AS seq_no, -value AS logp, count(*) OVER (PARTITION BY event_id // 8) // 2 AS half FROM events)
        SELECT batch_id, seq_no % half AS "row", round(max(logp) FILTER (seq_no < half), 6) AS chosen, round(max(logp) FILTER (seq_no >= half), 6) AS rejected FROM b GROUP BY 1, 2""",
    "d2z_schedule": """WITH t AS (SELECT doc_id, greatest(n_chars, 1) AS total FROM documents), s AS (SELECT doc_id, total, doc_id % total AS warmup, doc_id * 7 % (total + 2) AS step FROM t),
        m AS (SELECT *, CASE WHEN step < warmup THEN (step + 1)::DOUBLE / warmup ELSE greatest(0, (total - step)::DOUBLE / (total - warmup)) END AS m FROM s)
        SELECT doc_id, total, warmup, step, round(m, 6) AS multiplier, round(m * 0.0003::DOUBLE, 6) AS lr FROM m""",
    "rmsnorm": f"WITH {_VALUES}, n AS (SELECT *, sqrt(avg(x * x) OVER (PARTITION BY vec_id) + 1e-6::DOUBLE) AS r FROM e) SELECT vec_id, i::INT AS i, round(x / r * ((i + 1) / 64.0::DOUBLE), 6) + 0 AS value FROM n",
    "rope": f"""WITH {_VALUES}, a AS (SELECT l.vec_id, l.i, l.x, h.x AS y, (l.vec_id % 512) * pow(10000.0::DOUBLE, -2.0::DOUBLE * l.i / 64) AS w FROM e l JOIN e h ON l.vec_id = h.vec_id AND h.i = l.i + 32)
        SELECT vec_id, i::INT AS i, round(x * cos(w) - y * sin(w), 6) + 0 AS value FROM a UNION ALL SELECT vec_id, (i + 32)::INT, round(y * cos(w) + x * sin(w), 6) + 0 FROM a""",
    "swiglu_dim": "SELECT doc_id, n_chars AS d, doc_id % 64 + 1 AS multiple, (ceil((8 * n_chars // 3) / (doc_id % 64 + 1)::DOUBLE) * (doc_id % 64 + 1))::BIGINT AS hidden FROM documents",
    "swiglu": f"""WITH {_VALUES}, g AS (SELECT vec_id, m.i AS h, sum(w * x) AS g FROM e JOIN {_w(0)} m ON m.j = e.i GROUP BY ALL), u AS (SELECT vec_id, m.i AS h, sum(w * x) AS u FROM e JOIN {_w(1)} m ON m.j = e.i GROUP BY ALL)
        SELECT vec_id, m.i::INT AS i, round(sum(w * (g / (1 + exp(-g)) * u)), 6) + 0 AS value FROM g JOIN u USING (vec_id, h) JOIN {_w(2)} m ON m.j = h GROUP BY vec_id, m.i""",
    "softmax": f"WITH {_VALUES} SELECT vec_id, i::INT AS i, round(exp(x * 10) / sum(exp(x * 10)) OVER (PARTITION BY vec_id), 6) AS value FROM e",
    "softmax_causal": f"""WITH {_VALUES}, h AS (SELECT vec_id // {SEQ_ROWS} AS seq, vec_id, i, i // {WIDTH // HEADS} AS h, x FROM e),
        s AS (SELECT q.vec_id, k.vec_id AS k, q.h, sum(q.x * k.x) / sqrt({WIDTH / HEADS}::DOUBLE) AS s FROM h q JOIN h k ON q.seq = k.seq AND q.i = k.i AND k.vec_id <= q.vec_id GROUP BY ALL),
        w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id, h)) AS w FROM s)
        SELECT w.vec_id, i::INT AS i, round(sum(w * x) / sum(w), 6) + 0 AS value FROM w JOIN h ON h.vec_id = w.k AND h.h = w.h GROUP BY w.vec_id, i""",
    "embedding_lookup": f"WITH {_VALUES}, t AS (SELECT vec_id, sum(x * (i + 1)) AS t FROM e GROUP BY vec_id) SELECT doc_id, doc_id % 500 AS token_id, round(t, 6) AS total FROM documents JOIN t ON vec_id = doc_id % 500",
    "sampled_next": f"""WITH {_VALUES}, r AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY x DESC) AS r FROM e), k AS (SELECT vec_id, i, exp(x / 0.7::DOUBLE) AS w FROM r WHERE r <= 10),
        c AS (SELECT vec_id, i, sum(w) OVER (PARTITION BY vec_id ORDER BY i) / sum(w) OVER (PARTITION BY vec_id) AS upto, ('0x' || substr(md5('5:' || vec_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM k)
        SELECT vec_id, min(i) AS token FROM c WHERE upto > u GROUP BY vec_id""",
    "topk_mask": f"WITH {_VALUES}, r AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY x DESC) AS r FROM e) SELECT vec_id, i::INT AS i, round(x, 6) AS logit FROM r WHERE r <= 5",
    "greedy_next": f"WITH {_VALUES} SELECT vec_id, arg_max(-i, {{x: x, i: -i}}) * -1 AS token FROM e GROUP BY vec_id",
    "cross_entropy": f"WITH {_VALUES}, l AS (SELECT vec_id, ln(sum(exp(x))) - max(x) FILTER (i = label) AS l FROM e GROUP BY vec_id) SELECT round(avg(l), 6) AS loss, round(exp(avg(l)), 6) AS perplexity FROM l",
    "truncated_ids": """WITH t AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM conversations), p AS (SELECT *, coalesce(list_position(ids, 9), 0) AS at_ FROM t)
        SELECT conv_id, turn, at_ > 0 AS finished, array_to_string(CASE WHEN at_ > 0 THEN ids[1:at_ - 1] ELSE ids END, ',') AS ids FROM p""",
    "num_params": """WITH p AS (SELECT doc_id, n_chars AS vocab, doc_id % 64 + 1 AS d, doc_id % 7 AS layers, n_chars % 100 AS hidden FROM documents)
        SELECT doc_id, (vocab * d * 2 + layers * (4 * d * d + 3 * d * hidden + 2 * d) + d)::BIGINT AS n FROM p""",
}
QUERIES = {n: globals()[n] for n in ORACLES}
