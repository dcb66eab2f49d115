"""Preference optimisation's data preparation and measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def encode_pairs(pairs: DataFrame, eot: int, max_len: int) -> DataFrame:
    """pairs (prompt, chosen, rejected as ids) with EOT behind the responses, cut to the room that the prompt leaves.

    Pairs with an empty prompt or no room are dropped.
    """
    room = F.lit(max_len) - F.size("prompt")
    cut = lambda c: F.slice(F.concat(F.col(c), F.array(F.lit(eot))), F.lit(1), room).alias(c)
    rest = [c for c in pairs.columns if c not in ("prompt", "chosen", "rejected")]
    return pairs.where((F.size("prompt") > 0) & (room >= 1)).select(*rest, "prompt", cut("chosen"), cut("rejected"))


def collate(pairs: DataFrame, pad: int, batch: str = "batch_id", row: str = "row") -> DataFrame:
    """(batch, seq_no, which, idx, mask): a batch's chosen sequences, then its rejected ones, right-padded to its longest."""
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("which"), F.col(c).alias("response")) for k, c in enumerate(("chosen", "rejected"))]))
    rows = pairs.select(batch, row, "prompt", sides.alias("s")).select(batch, row, "s.which", "prompt", "s.response")
    each = Window.partitionBy(batch)
    n, width = F.size("prompt") + F.size("response"), F.max(F.size("prompt") + F.size("response")).over(each)
    rows = rows.withColumn("_w", width).withColumn("_b", F.max(row).over(each) + 1)
    pad_to = lambda xs, v: F.concat(xs, F.array_repeat(F.lit(v), (F.col("_w") - n).cast("int")))
    ones = F.concat(F.array_repeat(F.lit(0), F.size("prompt")), F.array_repeat(F.lit(1), F.size("response")))
    return rows.select(batch, (F.col("which") * F.col("_b") + F.col(row)).alias("seq_no"), "which", pad_to(F.concat("prompt", "response"), pad).alias("idx"), pad_to(ones, 0).alias("mask"))


def sequence_logprobs(positions: DataFrame, key: str = "seq_no") -> DataFrame:
    """(key, logp) from (key, t, logp of token t, mask): the sum over response tokens; token 0 has no prediction."""
    return positions.where("t >= 1").groupBy(key).agg(F.sum(F.col("logp") * F.col("mask")).alias("logp"))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def rewards(rows: DataFrame, beta: float) -> DataFrame:
    """rows (pc, pr, rc, rr) with chosen_reward, rejected_reward, margin and loss = -log sigmoid(margin)."""
    out = rows.withColumn("chosen_reward", F.lit(float(beta)) * (F.col("pc") - F.col("rc"))).withColumn("rejected_reward", F.lit(float(beta)) * (F.col("pr") - F.col("rr")))
    return out.withColumn("margin", F.col("chosen_reward") - F.col("rejected_reward")).withColumn("loss", softplus(-F.col("margin")))


def dpo_loss(rows: DataFrame, beta: float) -> DataFrame:
    """One row: loss, reward_accuracy, reward_margin, chosen_reward, rejected_reward."""
    return rewards(rows, beta).agg(
        F.avg("loss").alias("loss"), F.avg((F.col("margin") > 0).cast("double")).alias("reward_accuracy"), F.avg("margin").alias("reward_margin"),
        F.avg("chosen_reward").alias("chosen_reward"), F.avg("rejected_reward").alias("rejected_reward"))


def batch_halves(logprobs: DataFrame, batch: str = "batch_id") -> DataFrame:
    """(batch, row, chosen, rejected): the first half of a batch's sequences beside the second."""
    half = F.count("*").over(Window.partitionBy(batch)) / 2
    sides = logprobs.withColumn("_h", half.cast("long")).withColumn("_row", F.col("seq_no") % F.col("_h"))
    one = lambda first: F.max(F.when((F.col("seq_no") < F.col("_h")) == first, F.col("logp")))
    return sides.groupBy(batch, F.col("_row").alias("row")).agg(one(True).alias("chosen"), one(False).alias("rejected"))


def d2z_multiplier(step: Column, total: Column | int, warmup: Column | int) -> Column:
    """Warm-up to 1 over `warmup` steps, then linearly to 0 at `total`; bad settings raise."""
    total, warmup = (F.lit(x) if isinstance(x, int) else x for x in (total, warmup))
    fine = (total > 0) & (warmup >= 0) & (warmup < total)
    up, down = (step + 1) / F.when(warmup > 0, warmup), F.greatest(F.lit(0.0), (total - step) / F.when(total > warmup, total - warmup))
    return F.when(~fine, F.raise_error(F.lit("total must be above 0 and warmup in [0, total)")).cast("double")).when(step < warmup, up).otherwise(down)


def weighted_means(batches: DataFrame, values: list[str], size: str = "n") -> DataFrame:
    """Means of per-batch values, weighted by the batches' sizes; null without rows."""
    total = F.sum(size)
    return batches.agg(*[(F.sum(F.col(v) * F.col(size)) / F.when(total > 0, total)).alias(v) for v in values])


def perplexity(loss: Column) -> Column:
    return F.exp(loss)
