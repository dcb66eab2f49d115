"""Scoring candidates by rules, choosing pairs, judging and reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

UNDECIDED, DISAGREED, GAP, FEW, KEPT = "llm_undecided", "llm_disagreed", "rule_gap_too_small", "too_few_candidates", "kept"


def rule_scores(candidates: DataFrame) -> DataFrame:
    """candidates (prompt, text, ...) with each penalty, score and the map of penalties above 0."""
    found = candidates.withColumns(X.penalties("prompt", "text"))
    named = {k: F.col(k) for k in X.WEIGHTS}
    return found.withColumn("score", X.score(named)).withColumn("penalties", X.penalty_map(named))


def truncated(candidates: DataFrame, eot: int) -> DataFrame:
    """candidates (ids, ...) cut before their first EOT, with finished."""
    at = F.array_position("ids", F.lit(eot))
    return candidates.withColumn("finished", at > 0).withColumn("ids", F.when(at > 0, F.slice("ids", F.lit(1), (at - 1).cast("int"))).otherwise(F.col("ids")))


def distinct_candidates(candidates: DataFrame, key: str = "prompt_id") -> DataFrame:
    """The first candidate (by cand_idx) of each text of a prompt: an aggregation with partial sums, not a window."""
    rest = [c for c in candidates.columns if c not in (key, "text")]
    first = F.min_by(F.struct(*rest), F.col("cand_idx"))
    return candidates.groupBy(key, "text").agg(first.alias("f")).select(key, "text", *[F.col("f")[c].alias(c) for c in rest]).select(*candidates.columns)


def best_and_worst(scored: DataFrame, key: str = "prompt_id", min_gap: float = 0.2) -> DataFrame:
    """(key, n, chosen, rejected, gap, status): the best and the worst candidate of each prompt.

    Of equal scores the worst is the first and the best the last, as a stable sort has them.
    """
    own = F.struct("cand_idx", "text", "score", *(["penalties"] if "penalties" in scored.columns else []))
    order = F.struct("score", "cand_idx")
    sides = scored.groupBy(key).agg(F.count("*").alias("n"), F.max_by(own, order).alias("chosen"), F.min_by(own, F.struct(F.col("score"), F.col("cand_idx"))).alias("rejected"))
    gap = F.col("chosen.score") - F.col("rejected.score")
    return sides.withColumn("gap", gap).withColumn("status", F.when((F.col("n") < 2) | (gap < min_gap), GAP).otherwise(KEPT))


def verdict(first: Column, second: Column) -> Column:
    """The preferred side (x, y or null) from the winners of both orders; in the second order y stood first."""
    return F.when((first == "A") & (second == "B"), "x").when((first == "B") & (second == "A"), "y")


def judge_pairs(verdicts: DataFrame, key: str = "prompt_id") -> DataFrame:
    """(key, preferred, reasons) from (key, order_no 1 or 2, winner, reason)."""
    one = lambda k: F.max(F.when(F.col("order_no") == k, F.col("winner")))
    reasons = F.transform(F.array_sort(F.collect_list(F.struct("order_no", "reason"))), lambda s: s["reason"])
    return verdicts.groupBy(key).agg(verdict(one(1), one(2)).alias("preferred"), reasons.alias("reasons"))


VERDICT = "reason string, winner string"


def parse_verdict(response: Column | str) -> Column:
    """A judge's JSON answer as (reason, winner); anything but A, B and tie, and a refusal, has no winner."""
    r = F.from_json(response, VERDICT)
    return F.struct(r["reason"].alias("reason"), F.when(r["winner"].isin("A", "B", "tie"), r["winner"]).alias("winner"))


def ask_judge(pairs: DataFrame, client, key: str = "prompt_id") -> DataFrame:
    """(key, order_no, winner, reason): a pluggable client is asked for both orders, batch by batch, on the executors.

    client(prompt, a, b) returns (winner, reason), or None for a refusal.
    """
    import pandas as pd

    def asked(frames):
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                for order, a, b in ((1, r.x, r.y), (2, r.y, r.x)):
                    winner, reason = client(r.prompt, a, b) or (None, None)
                    rows.append((r[0], order, winner, reason))
            yield pd.DataFrame(rows, columns=[key, "order_no", "winner", "reason"])

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, "prompt", "x", "y").mapInPandas(asked, f"{key} {kind}, order_no int, winner string, reason string")


def rule_pairs(candidates: DataFrame, key: str = "prompt_id", min_gap: float = 0.2) -> DataFrame:
    """best_and_worst over the finished candidates; a prompt without any has the gap's status too."""
    prompts = candidates.groupBy(key).agg(F.count_if(~F.col("finished")).alias("unfinished_dropped"), F.first("prompt").alias("prompt"))
    return prompts.join(best_and_worst(rule_scores(candidates.where("finished")), key, min_gap), key, "left").withColumn("status", F.coalesce("status", F.lit(GAP)))


def with_judge(pairs: DataFrame, judged: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Both: rule pairs that the judge prefers too. Only pairs that the rules kept need a verdict."""
    out = pairs.join(judged, key, "left")
    after = F.when(F.col("preferred") == "x", KEPT).when(F.col("preferred") == "y", DISAGREED).otherwise(UNDECIDED)
    return out.withColumn("status", F.when(F.col("status") == KEPT, after).otherwise(F.col("status")))


def rounded(x: Column, digits: int = 3) -> Column:
    """The number rounded to decimals by its exact binary value, a true half to the even neighbour.

    What a product by the power of ten lost to rounding decides where the product looks like a half.
    """
    scale = float(10**digits)
    p, low = x * scale, F.floor(x * scale)
    high = x * 134217729.0 - (x * 134217729.0 - x)  # the upper half of the digits
    lost = (high * scale - p) + (x - high) * scale
    over = p - low
    up = (over > 0.5) | (over == 0.5) & ((lost > 0) | (lost == 0) & (low % 2 != 0))
    return F.when(up, low + 1).otherwise(low) / scale


def pair_records(pairs: DataFrame, mode: str, key: str = "prompt_id") -> DataFrame:
    """The preference records of the kept pairs: (key, prompt, chosen, rejected, judge, rule_scores, rule_penalties, llm_reasons).

    mode: "rule" for rule_pairs, "both" for with_judge, "llm" for judge_only; what a mode has not is null.
    """
    if mode not in ("rule", "both", "llm"):
        raise ValueError(f"unknown mode {mode!r}")
    kept = pairs.where(F.col("status") == KEPT)
    both = lambda field: F.array(F.col(f"chosen.{field}"), F.col(f"rejected.{field}"))
    scores, penalties = F.lit(None).cast("array<double>"), F.lit(None).cast("array<map<string,double>>")
    reasons = F.lit(None).cast("array<string>") if mode == "rule" else F.col("reasons")
    chosen, rejected = F.col("chosen"), F.col("rejected")
    if mode != "llm":
        scores, penalties = F.transform(both("score"), lambda x: rounded(x)), both("penalties")
        chosen, rejected = F.col("chosen.text"), F.col("rejected.text")
    return kept.select(
        key, "prompt", chosen.alias("chosen"), rejected.alias("rejected"), F.lit(mode).alias("judge"), scores.alias("rule_scores"), penalties.alias("rule_penalties"), reasons.alias("llm_reasons"))


def first_two(candidates: DataFrame, key: str = "prompt_id") -> DataFrame:
    """(key, n, x, y): the first two finished candidates of each prompt."""
    ranked = candidates.where("finished").withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("cand_idx"))).where("_r <= 2")
    one = lambda k: F.max(F.when(F.col("_r") == k, F.col("text")))
    return ranked.groupBy(key).agg(F.count("*").alias("n"), one(1).alias("x"), one(2).alias("y"))


def judge_only(candidates: DataFrame, judged: DataFrame, key: str = "prompt_id") -> DataFrame:
    """(key, prompt, chosen, rejected, reasons, status) by the judge alone."""
    prompts = candidates.groupBy(key).agg(F.first("prompt").alias("prompt"))
    out = prompts.join(first_two(candidates, key), key, "left").join(judged, key, "left")
    status = F.when(F.coalesce("n", F.lit(0)) < 2, FEW).when(F.col("preferred").isNull(), UNDECIDED).otherwise(KEPT)
    side = lambda a, b: F.when(F.col("preferred") == "x", F.col(a)).when(F.col("preferred") == "y", F.col(b))
    return out.select(key, "prompt", side("x", "y").alias("chosen"), side("y", "x").alias("rejected"), "reasons", status.alias("status"))


def outcomes(pairs: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(status, n): prompts by outcome, and the unfinished candidates that were dropped."""
    out = pairs.groupBy("status").agg(F.count("*").alias("n"))
    if candidates is None:
        return out
    return out.unionByName(candidates.agg(F.count_if(~F.col("finished")).alias("n")).select(F.lit("unfinished_dropped").alias("status"), "n"))


#: The report's means: of what, and over which candidates (all, or those that finished).
_MEANS = {
    "finished": (lambda: F.col("finished").cast("double"), False), "chars": (lambda: F.length("text").cast("double"), False),
    "repeated_sentences": (lambda: X.repeated_sentence_ratio("text"), False), "repeated_ngrams": (lambda: X.repeated_ngram_ratio("text"), False),
    "rule_score": (lambda: F.col("score"), True), "bad_ending": (lambda: F.col("bad_ending"), True), "lost_protagonist": (lambda: F.col("lost_protagonist"), True),
}


def report(candidates: DataFrame) -> DataFrame:
    """One row of means: ratios of the unstripped texts over all, scores and penalties over the finished."""
    return report_by(candidates, [], [[]]).drop("level")


def report_by(candidates: DataFrame, keys: list[str], sets: list[list[str]] | None = None) -> DataFrame:
    """The report for groups: (keys, level, stories, means) for each set of keys (None: all keys, each alone, and none).

    `level` has a bit for each key, the first one's highest, that is 1 where the row is a total over that key, which is null then. Candidates are read
    once: each group of all keys becomes sums and counts, and only those are added up for the sets.
    """
    sets = [list(keys), *([[k] for k in keys] if len(keys) > 1 else []), []] if sets is None else sets
    scored = rule_scores(candidates)
    values = {name: F.when(F.col("finished"), value()) if done else value() for name, (value, done) in _MEANS.items()}
    scored = scored.select(*keys, *[v.alias(f"_{name}") for name, v in values.items()])
    parts = [F.count("*").alias("stories"), *[f(F.col(f"_{name}")).alias(f"_{kind}_{name}") for name in values for kind, f in (("sum", F.sum), ("n", F.count))]]
    fine = scored.groupBy(*keys).agg(*parts)
    added = [F.sum(F.col(c)).alias(c) for c in ("stories", *(f"_{kind}_{name}" for name in values for kind in ("sum", "n")))]
    if keys:
        whole = fine.groupingSets([[F.col(k) for k in s] for s in sets], *map(F.col, keys)).agg(F.grouping_id().alias("level"), *added)
    else:
        whole = fine.withColumn("level", F.lit(0).cast("long"))
    means = [F.try_divide(F.col(f"_sum_{name}"), F.col(f"_n_{name}")).alias(name) for name in values]
    return whole.select(*keys, "level", "stories", *means)
