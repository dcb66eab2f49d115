"""Preference pairs from a stream of prompts with their candidates, each record exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import judge, quality
from ..sources import corpus

CANDIDATES = "prompt_id long, prompt string, candidates array<struct<cand_idx: int, text: string, finished: boolean>>"


def exploded(prompts: DataFrame) -> DataFrame:
    """(prompt_id, prompt, cand_idx, text, finished): the distinct candidates of CANDIDATES."""
    rows = prompts.select("prompt_id", "prompt", F.explode("candidates").alias("c")).select("prompt_id", "prompt", "c.*")
    return quality.distinct_candidates(rows)


def records(candidates: DataFrame, mode: str = "rule", min_gap: float = 0.2, client=None, ledger: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs with their status, records of those kept): by rules, by a judge ("llm"), or by rules and a judge that agrees ("both")."""
    if mode == "rule":
        pairs = quality.rule_pairs(candidates, min_gap=min_gap)
    elif mode == "both":
        ruled = quality.rule_pairs(candidates, min_gap=min_gap)
        kept = ruled.where(F.col("status") == quality.KEPT).select("prompt_id", "prompt", F.col("chosen.text").alias("x"), F.col("rejected.text").alias("y"))
        pairs = quality.with_judge(ruled, quality.judge_pairs(judge.ask(kept, client, ledger)))
    else:
        prompts = candidates.groupBy("prompt_id").agg(F.first("prompt").alias("prompt"))
        two = quality.first_two(candidates).where("n = 2").join(prompts, "prompt_id")
        pairs = quality.judge_only(candidates, quality.judge_pairs(judge.ask(two.select("prompt_id", "prompt", "x", "y"), client, ledger)))
    return pairs, quality.pair_records(pairs, mode)


def sink(prompts: DataFrame, path: str, checkpoint: str, **settings) -> StreamingQuery:
    """Start a query that writes the records of a stream of CANDIDATES below `path`, one folder for each micro-batch.

    A batch that runs again after a stop has its number, and so its folder, again: what it wrote before is replaced. `corpus.load_pairs` reads all.
    """

    def written(batch: DataFrame, number: int) -> None:
        _, kept = records(exploded(batch), **settings)
        corpus.write_pairs(kept, f"{path}/batch={number}")

    return prompts.writeStream.foreachBatch(written).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
