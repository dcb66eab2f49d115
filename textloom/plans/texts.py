"""Queries over documents and conversations: pretokens, filters, sentences, rules and pairs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import flows
from ..functions import text as X
from ..operators import judge, order, quality, tokenizer
from ..sources import corpus, shared, tokenfile
from ..streaming import pairs as stream_pairs
from . import sql

ENDS = ".!?。！？」"
RATIO = 0.8
MAX_DOCS = 100


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pretoken_counts(spark, d):
    return tokenizer.pretoken_counts(read(spark, d, "documents"))


def pretokens_per_doc(spark, d):
    words = X.pretokens("text")
    return read(spark, d, "documents").select("doc_id", F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("n_distinct"), (F.array_join(words, "") == F.col("text")).alias("whole"))


def latin_ratio_filter(spark, d):
    return read(spark, d, "documents").select("doc_id", F.round(X.latin_ratio("text"), 6).alias("latin_ratio"), X.keep_story("text", RATIO).alias("kept"))


def corpus_stats(spark, d):
    kept = X.keep_story("text", RATIO)
    return read(spark, d, "documents").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"))


def max_docs_prefix(spark, d):
    docs = read(spark, d, "documents").select("doc_id", X.keep_story("text", RATIO).alias("kept"))
    return order.first_kept(docs, ["doc_id"], "kept", MAX_DOCS)


def stripped_texts(spark, d):
    t = X.strip(F.concat(F.lit("\t 　\x1c"), F.col("text"), F.lit("\n\x85  ")))
    return read(spark, d, "documents").select("doc_id", t.alias("stripped"))


def story_openings(spark, d):
    return read(spark, d, "documents").select("doc_id", X.opening("text", ".").alias("opening")).where("opening IS NOT NULL")


def sentence_stats(spark, d):
    s = X.sentences("text", ENDS)
    return read(spark, d, "documents").select("doc_id", F.size(s).alias("n"), F.size(F.array_distinct(s)).alias("n_distinct"))


def repeated_sentences(spark, d):
    return read(spark, d, "documents").select("doc_id", F.round(X.repeated_sentence_ratio("text", ENDS), 6).alias("ratio"))


def repeated_ngrams(spark, d):
    return read(spark, d, "documents").select("doc_id", F.round(X.repeated_ngram_ratio("text"), 6).alias("ratio"))


#: Letters of the texts become signs of other scripts, so that all classes and names occur.
_KANA = ("abcdefghijklmnopqrstuvwxyz", "アイウエオカキクケコサシスセソタチツテトナニヌネノハ")
_MIXED = ("aeiountrsl", "あア漢9ーん々ｱ１'")


def _talk(spark, d, signs):
    return read(spark, d, "conversations").select("conv_id", "turn", F.translate("text", *signs).alias("text"))


def character_names(spark, d):
    return _talk(spark, d, _KANA).select("conv_id", "turn", F.posexplode(X.character_names("text")).alias("idx", "name"))


def safe_splits(spark, d):
    """How many places of each text are safe to cut, and the sum of those places."""
    talk = _talk(spark, d, _MIXED).where(F.length("text") > 1)
    def summed(sizes):
        """Each piece's length counts for every place behind it."""
        behind = F.transform(sizes, lambda n, i: n.cast("long") * (F.size(sizes) - 1 - i))
        return F.struct((F.size(sizes) - 1).alias("safe"), F.aggregate(behind, F.lit(0).cast("long"), lambda a, n: a + n).alias("total"))

    safe = talk.select("conv_id", "turn", (F.length("text") - 1).alias("places"), X.bound(tokenizer.safe_lengths("text"), summed).alias("s"))
    return safe.groupBy("conv_id", "turn").agg(F.sum("places").alias("places"), F.sum("s.safe").alias("safe"), F.sum("s.total").alias("total"))


def char_classes(spark, d):
    chars = _talk(spark, d, _MIXED).select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    return chars.select("c", "n", F.array_join(X.char_classes("c").cast("array<string>"), ",").alias("classes"))


def _turns(spark, d):
    """Assistant turns as candidates of their conversation, the turn before as the prompt."""
    before = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, d, "conversations").withColumn("prompt", F.coalesce(F.lag("text").over(before), F.lit("")))
    finished = F.substring("text", -1, 1).isin(".", "!", "?")
    return rows.where("role = 'assistant'").select(F.col("conv_id").alias("prompt_id"), F.col("turn").cast("int").alias("cand_idx"), "prompt", "text", finished.alias("finished"))


def rule_scores(spark, d):
    s = quality.rule_scores(_turns(spark, d))
    return s.select("prompt_id", "cand_idx", *[F.round(k, 6).alias(k) for k in X.WEIGHTS], F.round("score", 6).alias("score"))


def rule_penalties(spark, d):
    s = quality.rule_scores(_turns(spark, d))
    return s.select("prompt_id", "cand_idx", F.explode("penalties").alias("penalty", "value")).withColumn("value", F.round("value", 6))


def distinct_candidates(spark, d):
    docs = read(spark, d, "documents").select(F.col("source").alias("prompt_id"), F.col("doc_id").alias("cand_idx"), "text")
    return quality.distinct_candidates(docs).select("prompt_id", "cand_idx")


def _pairs(spark, d):
    return quality.best_and_worst(quality.rule_scores(_turns(spark, d)).withColumn("score", F.round("score", 9)), min_gap=0.01)


def best_worst_pairs(spark, d):
    p = _pairs(spark, d)
    return p.select("prompt_id", "n", F.col("chosen.cand_idx").alias("chosen"), F.col("rejected.cand_idx").alias("rejected"), F.round("gap", 6).alias("gap"), "status")


def pair_outcomes(spark, d):
    c = _turns(spark, d)
    return quality.outcomes(quality.rule_pairs(c, min_gap=0.01), c)


def quality_report(spark, d):
    r = quality.report(_turns(spark, d))
    return r.select("stories", *[F.round(c, 6).alias(c) for c in r.columns if c != "stories"])


def quality_report_groups(spark, d):
    """The report over the documents' languages and sources, with all subtotals."""
    docs = read(spark, d, "documents").select("lang", "source", F.lit("").alias("prompt"), "text", F.right("text", F.lit(1)).isin(".", "!", "?").alias("finished"))
    r = quality.report_by(docs, ["lang", "source"])
    return r.select("lang", "source", "level", "stories", *[F.round(c, 6).alias(c) for c in r.columns[4:]])


_VERDICTS = [(1, 1, "A"), (1, 2, "B"), (2, 1, "B"), (2, 2, "A"), (3, 1, "A"), (3, 2, "A"), (4, 1, "tie"), (4, 2, "B"), (5, 1, None), (5, 2, "B"), (6, 1, "B"), (6, 2, "B")]


def _verdicts(spark):
    return spark.createDataFrame([(i, o, w, f"r{i}{o}") for i, o, w in _VERDICTS], "prompt_id long, order_no int, winner string, reason string")


def judge_consensus(spark, d):
    """Winners of both orders by the conversation's number."""
    winner = lambda k: F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("tie"), F.lit(None)), (k % 4 + 1).cast("int"))
    convs = read(spark, d, "conversations").select(F.col("conv_id").alias("prompt_id")).distinct()
    orders = F.explode(F.array(*[F.struct(F.lit(o).alias("order_no"), winner(k).alias("winner")) for o, k in ((1, F.col("prompt_id")), (2, F.floor(F.col("prompt_id") / 4)))]))
    rows = convs.select("prompt_id", orders.alias("o")).select("prompt_id", "o.*", F.concat(F.lit("r"), F.col("prompt_id").cast("string"), F.lit("."), F.col("o.order_no").cast("string")).alias("reason"))
    j = quality.judge_pairs(rows)
    return j.select("prompt_id", "preferred", F.array_join("reasons", "|").alias("reasons"))


def judge_both_mode(spark, d):
    pairs = quality.rule_pairs(_turns(spark, d), min_gap=0.0)
    asked = pairs.select("prompt_id", (F.col("prompt_id") % 6 + 1).alias("v")).join(quality.judge_pairs(_verdicts(spark)).withColumnRenamed("prompt_id", "v"), "v").drop("v")
    return quality.outcomes(quality.with_judge(pairs, asked))


def judge_only_mode(spark, d):
    c = _turns(spark, d)
    asked = c.select("prompt_id").distinct().withColumn("v", F.col("prompt_id") % 6 + 1).join(quality.judge_pairs(_verdicts(spark)).withColumnRenamed("prompt_id", "v"), "v").drop("v")
    return quality.judge_only(c, asked).select("prompt_id", "chosen", "rejected", "status")


def judge_responses(spark, d):
    """Answers that turns stand for: three sound ones, of which one names no side, none at all, and one that is no JSON."""
    kind = F.col("turn") % 5
    sound = lambda w: F.to_json(F.struct(F.col("text").alias("reason"), F.lit(w).alias("winner")))
    response = F.when(kind == 0, sound("A")).when(kind == 1, sound("tie")).when(kind == 2, sound("C")).when(kind == 3, F.col("text"))
    v = quality.parse_verdict(F.col("response"))
    return read(spark, d, "conversations").select("conv_id", "turn", response.alias("response")).select("conv_id", "turn", v["reason"].alias("reason"), v["winner"].alias("winner"))


def first_openings(spark, d):
    """The first 50 usable openings from raw line 20 on."""
    return corpus.story_openings(read(spark, d, "documents").withColumnRenamed("doc_id", "line_no"), 50, skip=20, end=".")


def _longer(prompt, a, b):
    """A judge that prefers the longer text, the first of equals, and refuses where the prompt is empty."""
    return ("A" if len(a) >= len(b) else "B", f"{len(a)}:{len(b)}") if prompt else None


def judge_asked(spark, d):
    c = _turns(spark, d)
    pairs = quality.first_two(c).where("n = 2").join(c.groupBy("prompt_id").agg(F.min_by("prompt", "cand_idx").alias("prompt")), "prompt_id")
    return quality.ask_judge(pairs.select("prompt_id", "prompt", "x", "y"), _longer)


def judge_ledger(spark, d):
    """The same through a ledger: a third is asked first, then all; n_asked counts the ledger's answers, one for each question."""
    c, ledger = _turns(spark, d), _folder(spark)
    pairs = quality.first_two(c).where("n = 2").join(c.groupBy("prompt_id").agg(F.min_by("prompt", "cand_idx").alias("prompt")), "prompt_id").select("prompt_id", "prompt", "x", "y")
    judge.ask(pairs.where("prompt_id % 3 = 0"), _longer, ledger)
    out = judge.ask(pairs, _longer, ledger)
    return out.withColumn("n_asked", F.lit(spark.read.schema(judge.ANSWER).json(ledger).count()))


def _prompts(spark, d):
    """Each conversation's first prompt with its candidates."""
    c = F.struct(F.col("cand_idx").cast("int").alias("cand_idx"), "text", "finished")
    return _firsts(spark, d).groupBy("prompt_id").agg(F.first("prompt").alias("prompt"), F.array_sort(F.collect_list(c)).alias("candidates"))


def pairs_stream(spark, d):
    """Records of a stream of candidates that is stopped in the middle and started again from its checkpoint."""
    path, prompts = _folder(spark), _prompts(spark, d)
    for half in (0, 1):
        prompts.where(F.col("prompt_id") % 2 == half).repartition(2).write.mode("append").json(f"{path}/in")
        source = spark.readStream.schema(stream_pairs.CANDIDATES).option("maxFilesPerTrigger", 1).json(f"{path}/in")
        stream_pairs.sink(source, f"{path}/out", f"{path}/checkpoint", min_gap=0.01).awaitTermination()
    back = corpus.load_pairs(spark, f"{path}/out")
    return back.select("prompt", "chosen", "rejected", "judge", *[F.get("rule_scores", F.lit(k)).alias(f"score_{k}") for k in (0, 1)])


def flow_pairs(spark, d):
    """The flow of preference pairs: files of candidates in, a pairs file out."""
    path = _folder(spark)
    _prompts(spark, d).write.json(f"{path}/in")
    flows.make_pairs(spark, f"{path}/in", f"{path}/out", min_gap=0.01)
    back = corpus.load_pairs(spark, f"{path}/out")
    return back.select("prompt", "chosen", "rejected", "judge", *[F.get("rule_scores", F.lit(k)).alias(f"score_{k}") for k in (0, 1)])


def flow_tokens(spark, d):
    """Two flows: corpus files to a tokenizer, and both to a token file, which is read and decoded again, document by document."""
    paths, path = _written(spark, d), _folder(spark)
    settings = {"field": "story", "max_latin_ratio": RATIO}
    flows.train_tokenizer(spark, paths, f"{path}/tokenizer", 300, **settings)
    flows.prepare_tokens(spark, f"{path}/tokenizer", paths, f"{path}/tokens", **settings)
    merges, vocab = corpus.load_tokenizer(spark, f"{path}/tokenizer")
    whole = tokenfile.documents(spark, f"{path}/tokens", vocab[tokenizer.EOT])
    return whole.select("doc_no", tokenizer.decode(F.col("ids"), merges).alias("text"))


def _recorded(pairs, mode):
    r = quality.pair_records(pairs, mode)
    scored = [F.get("rule_scores", F.lit(k)).alias(f"score_{k}") for k in (0, 1)] + [F.size(F.get("rule_penalties", F.lit(k))).alias(f"penalties_{k}") for k in (0, 1)]
    return r.select("prompt_id", "prompt", "chosen", "rejected", "judge", *(scored if mode != "llm" else []), F.array_join("llm_reasons", "|").alias("reasons"))


def _asked(spark, prompts):
    judged = quality.judge_pairs(_verdicts(spark)).withColumnRenamed("prompt_id", "v")
    return prompts.select("prompt_id", (F.col("prompt_id") % 6 + 1).alias("v")).distinct().join(judged, "v").drop("v")


def _firsts(spark, d):
    """Candidates whose conversation's first prompt stands for all."""
    c = _turns(spark, d)
    return c.drop("prompt").join(c.groupBy("prompt_id").agg(F.min_by("prompt", "cand_idx").alias("prompt")), "prompt_id").select(*c.columns)


def pair_records_rule(spark, d):
    return _recorded(quality.rule_pairs(_firsts(spark, d), min_gap=0.01), "rule")


def pair_records_both(spark, d):
    pairs = quality.rule_pairs(_firsts(spark, d), min_gap=0.01)
    return _recorded(quality.with_judge(pairs, _asked(spark, pairs)), "both")


def pair_records_llm(spark, d):
    c = _firsts(spark, d)
    return _recorded(quality.judge_only(c, _asked(spark, c)), "llm")


def _folder(spark):
    return f"{shared.own_dir(spark)}/{uuid.uuid4().hex}"


def _written(spark, d):
    """The documents as JSON lines in range-sorted files of one folder, blank lines between them, and a plain text file beside it."""
    docs = read(spark, d, "documents")
    path = _folder(spark)
    rows = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows.select(F.explode(F.array(F.to_json(F.struct(F.col("text").alias("story"))), F.lit("  "))).alias("value")).write.text(f"{path}/lines")
    spark.createDataFrame([("one\r\nplain text",)], "value string").coalesce(1).write.text(f"{path}/plain")
    jvm = spark._jvm.org.apache.hadoop.fs
    folder = jvm.Path(f"{path}/lines")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(folder):
        if (name := f.getPath().getName()).startswith("part-"):
            fs.rename(f.getPath(), jvm.Path(folder, name.split(".")[0] + ".jsonl"))
    return [f"{path}/lines", f"{path}/plain"]


def corpus_files(spark, d):
    out = corpus.iter_documents(spark, _written(spark, d), "story", max_latin_ratio=RATIO)
    return out.groupBy("kept").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sum(F.col("line_no") % 2).alias("odd_lines"))


def corpus_files_prefix(spark, d):
    out = corpus.iter_documents(spark, _written(spark, d), "story", MAX_DOCS, RATIO)
    return corpus.corpus_stats(out)


def pairs_file(spark, d):
    """Records appended twice, in halves, and read back."""
    r = quality.pair_records(quality.rule_pairs(_firsts(spark, d), min_gap=0.01), "rule")
    path = _folder(spark)
    for half in (0, 1):
        corpus.append_pairs(r.where(F.col("prompt_id") % 2 == half), path)
    back = corpus.load_pairs(spark, path)
    return back.select("prompt", "chosen", "rejected", "judge", *[F.get("rule_scores", F.lit(k)).alias(f"score_{k}") for k in (0, 1)])


def pairs_json(spark, d):
    p = _pairs(spark, d).where("status = 'kept'")
    record = F.struct(F.col("chosen.cand_idx").alias("chosen"), F.col("rejected.cand_idx").alias("rejected"), F.lit("rule").alias("judge"))
    return p.select("prompt_id", F.to_json(record).alias("record"))


_TURNS = """
turns AS (
  SELECT conv_id AS prompt_id, turn::INT AS cand_idx, coalesce(before, '') AS prompt, text, right(text, 1) IN ('.', '!', '?') AS finished
  FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE role = 'assistant'
)"""


_SENTENCES = sql.sentences("t", X.SENTENCE_ENDS)
_SCORED = f"""
WITH {_TURNS}, stripped AS (SELECT *, {sql.strip('text')} AS t FROM turns),
names AS (SELECT prompt_id, cand_idx, list_filter(regexp_extract_all(prompt, '{X.NAME}'), lambda w: NOT (length(w) % 2 = 0 AND left(w, length(w) // 2) = right(w, length(w) // 2))) AS names FROM turns),
chars AS (SELECT prompt_id, cand_idx, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM stripped),
grams AS (SELECT prompt_id, cand_idx, c || lead(c, 1) OVER o || lead(c, 2) OVER o || lead(c, 3) OVER o || lead(c, 4) OVER o || lead(c, 5) OVER o AS g FROM chars WINDOW o AS (PARTITION BY prompt_id, cand_idx ORDER BY i)),
counted AS (SELECT prompt_id, cand_idx, g, count(*) AS c FROM grams WHERE g IS NOT NULL GROUP BY ALL),
again AS (SELECT prompt_id, cand_idx, sum(CASE WHEN c > 1 THEN c ELSE 0 END)::DOUBLE / sum(c) AS r FROM counted GROUP BY ALL),
said AS (SELECT *, {_SENTENCES} AS s FROM stripped),
parts AS (
  SELECT said.prompt_id, said.cand_idx, said.finished, said.text,
    least(1.0::DOUBLE, 2 * CASE WHEN len(s) < 2 THEN 0.0::DOUBLE ELSE 1 - len(list_distinct(s))::DOUBLE / len(s) END) AS repeated_sentences,
    least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(r, 0) - 0.15::DOUBLE) / 0.35::DOUBLE) AS repeated_ngrams,
    CASE WHEN right(t, 1) IN ('。', '！', '？', '」', '!', '?') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS bad_ending,
    CASE WHEN contains(t, chr(65533)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS broken_text,
    CASE WHEN len(names) > 0 AND len(list_filter(names, lambda w: contains(t, w))) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lost_protagonist,
    greatest(0.0::DOUBLE, 1 - length(t) / 80.0::DOUBLE) AS too_short
  FROM said JOIN names USING (prompt_id, cand_idx) LEFT JOIN again USING (prompt_id, cand_idx)
), scored AS (
  SELECT *, greatest(0.0::DOUBLE, 1 - (0.35::DOUBLE * repeated_sentences + 0.25::DOUBLE * repeated_ngrams + 0.2::DOUBLE * bad_ending
    + 0.1::DOUBLE * broken_text + 0.1::DOUBLE * lost_protagonist + 0.1::DOUBLE * too_short)) AS score FROM parts
)"""
_BEST = _SCORED + """, r9 AS (SELECT *, round(score, 9) AS s9 FROM scored),
sides AS (
  SELECT prompt_id, count(*) AS n, arg_max(cand_idx, {s: s9, i: cand_idx}) AS chosen, arg_min(cand_idx, {s: s9, i: cand_idx}) AS rejected, max(s9) - min(s9) AS gap FROM r9 GROUP BY prompt_id
), pairs AS (SELECT *, CASE WHEN n < 2 OR gap < 0.01::DOUBLE THEN 'rule_gap_too_small' ELSE 'kept' END AS status FROM sides)"""
_RULED = _SCORED + """, each AS (
  SELECT prompt_id, count(*) FILTER (finished) AS n, max(score) FILTER (finished) - min(score) FILTER (finished) AS gap FROM scored GROUP BY prompt_id
)"""
_RECORDS = _SCORED + f""", p AS (SELECT prompt_id, arg_min(prompt, cand_idx) AS prompt FROM turns GROUP BY 1),
done AS (SELECT *, {' + '.join(f'({k} > 0)::INT' for k in X.WEIGHTS)} AS n_penalties FROM scored WHERE finished),
ruled AS (
  SELECT prompt_id, prompt, arg_max(text, {{s: score, i: cand_idx}}) AS chosen, arg_min(text, {{s: score, i: cand_idx}}) AS rejected, round(max(score), 3) AS score_0, round(min(score), 3) AS score_1,
    arg_max(n_penalties, {{s: score, i: cand_idx}}) AS penalties_0, arg_min(n_penalties, {{s: score, i: cand_idx}}) AS penalties_1
  FROM done JOIN p USING (prompt_id) GROUP BY prompt_id, prompt HAVING count(*) >= 2 AND max(score) - min(score) >= 0.01::DOUBLE
)"""
_JUDGED = """(VALUES (1, 'x', 'r11|r12'), (2, 'y', 'r21|r22'), (3, NULL, 'r31|r32'), (4, NULL, 'r41|r42'), (5, NULL, 'r51|r52'), (6, NULL, 'r61|r62')) AS j(v, preferred, reasons)"""
_RATIO_OF = f"length(regexp_replace({sql.strip('text')}, '[^A-Za-z]', '', 'g'))::DOUBLE / nullif(length({sql.strip('text')}), 0)"
_KEPT = f"coalesce({_RATIO_OF} <= {RATIO}::DOUBLE, false)"
_DOC_GRAMS = """
WITH chars AS (SELECT d, doc_id, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (SELECT row_number() OVER () AS d, doc_id, string_split(text, '') AS l FROM documents)),
grams AS (SELECT d, doc_id, c || lead(c, 1) OVER o || lead(c, 2) OVER o || lead(c, 3) OVER o || lead(c, 4) OVER o || lead(c, 5) OVER o AS g FROM chars WINDOW o AS (PARTITION BY d ORDER BY i)),
counted AS (SELECT d, doc_id, g, count(g) AS c FROM grams GROUP BY ALL)
SELECT doc_id, coalesce(round(sum(CASE WHEN c > 1 THEN c ELSE 0 END)::DOUBLE / nullif(sum(c), 0), 6), 0) AS ratio FROM counted GROUP BY d, doc_id
"""


def _classes(c: str) -> str:
    tests = ", ".join(f"CASE WHEN regexp_matches({c}, '^[{s}]$') THEN {i} END" for i, s in enumerate(X.SCRIPTS))
    return f"CASE WHEN len(list_filter([{tests}], lambda v: v IS NOT NULL)) = 0 THEN [5] ELSE list_filter([{tests}], lambda v: v IS NOT NULL) END"


_MIX = f"(SELECT conv_id, turn, translate(text, '{_MIXED[0]}', '{_MIXED[1].replace(chr(39), chr(39) * 2)}') AS text FROM conversations)"
ORACLES = {
    "pretoken_counts": f"SELECT word, count(*) AS n FROM (SELECT unnest({sql.pretokens('text')}) AS word FROM documents) GROUP BY word",
    "pretokens_per_doc": f"SELECT doc_id, len(w)::INT AS n, len(list_distinct(w))::INT AS n_distinct, array_to_string(w, '') = text AS whole FROM (SELECT doc_id, text, {sql.pretokens('text')} AS w FROM documents)",
    "latin_ratio_filter": f"SELECT doc_id, round({_RATIO_OF}, 6) AS latin_ratio, {_KEPT} AS kept FROM documents",
    "corpus_stats": f"SELECT count(*) FILTER ({_KEPT}) AS kept, count(*) FILTER (NOT {_KEPT}) AS dropped FROM documents",
    "max_docs_prefix": f"""SELECT doc_id, kept FROM (SELECT *, coalesce(sum(kept::INT) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (SELECT doc_id, {_KEPT} AS kept FROM documents)) WHERE before < {MAX_DOCS}""",
    "stripped_texts": f"SELECT doc_id, {sql.strip('text')} AS stripped FROM documents",
    "story_openings": f"""SELECT doc_id, substr(t, 1, instr(t, '.')) AS opening FROM (SELECT doc_id, {sql.strip('text')} AS t FROM documents) WHERE instr(t, '.') - 1 BETWEEN 5 AND 80""",
    "sentence_stats": f"SELECT doc_id, len(s)::INT AS n, len(list_distinct(s))::INT AS n_distinct FROM (SELECT doc_id, {sql.sentences('text', ENDS)} AS s FROM documents)",
    "repeated_sentences": f"SELECT doc_id, round(CASE WHEN len(s) < 2 THEN 0.0::DOUBLE ELSE 1 - len(list_distinct(s))::DOUBLE / len(s) END, 6) AS ratio FROM (SELECT doc_id, {sql.sentences('text', ENDS)} AS s FROM documents)",
    "repeated_ngrams": _DOC_GRAMS,
    "character_names": f"""SELECT conv_id, turn, (generate_subscripts(n, 1) - 1)::INT AS idx, unnest(n) AS name FROM (SELECT conv_id, turn, list_filter(regexp_extract_all(translate(text, '{_KANA[0]}', '{_KANA[1]}'), '{X.NAME}'),
        lambda w: NOT (length(w) % 2 = 0 AND left(w, length(w) // 2) = right(w, length(w) // 2))) AS n FROM conversations)""",
    "safe_splits": f"""SELECT conv_id, turn, count(*) AS places, count(*) FILTER (safe) AS safe, coalesce(sum(at_) FILTER (safe), 0)::BIGINT AS total FROM (
        SELECT conv_id, turn, at_, a <> '''' AND NOT regexp_matches(a, '[{sql.WS}]') AND NOT regexp_matches(b, '[{sql.WS}]') AND NOT list_has_any({_classes('a')}, {_classes('b')}) AS safe
        FROM (SELECT conv_id, turn, at_, substr(text, at_, 1) AS a, substr(text, at_ + 1, 1) AS b FROM (SELECT conv_id, turn, text, unnest(range(1, length(text))) AS at_ FROM {_MIX}))) GROUP BY conv_id, turn""",
    "char_classes": f"SELECT c, count(*) AS n, any_value(array_to_string({_classes('c')}, ',')) AS classes FROM (SELECT unnest(string_split(text, '')) AS c FROM {_MIX}) GROUP BY c",
    "rule_scores": _SCORED + f" SELECT prompt_id, cand_idx, {', '.join(f'round({k}, 6) AS {k}' for k in [*X.WEIGHTS, 'score'])} FROM scored",
    "rule_penalties": _SCORED + " SELECT prompt_id, cand_idx, penalty, round(value, 6) AS value FROM scored UNPIVOT (value FOR penalty IN (" + ", ".join(X.WEIGHTS) + ")) WHERE value > 0",
    "distinct_candidates": "SELECT source AS prompt_id, min(doc_id) AS cand_idx FROM documents GROUP BY source, text",
    "best_worst_pairs": _BEST + " SELECT prompt_id, n, chosen, rejected, round(gap, 6) AS gap, status FROM pairs",
    "pair_outcomes": _RULED + """ SELECT CASE WHEN n < 2 OR gap < 0.01::DOUBLE THEN 'rule_gap_too_small' ELSE 'kept' END AS status, count(*) AS n FROM each GROUP BY 1
        UNION ALL SELECT 'unfinished_dropped', count(*) FROM scored WHERE NOT finished""",
    "quality_report": _SCORED + f""", raw AS (SELECT prompt_id, cand_idx, {sql.sentences('text', X.SENTENCE_ENDS)} AS s FROM turns),
        raw_chars AS (SELECT prompt_id, cand_idx, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM turns),
        raw_grams AS (SELECT prompt_id, cand_idx, c || lead(c, 1) OVER o || lead(c, 2) OVER o || lead(c, 3) OVER o || lead(c, 4) OVER o || lead(c, 5) OVER o AS g FROM raw_chars WINDOW o AS (PARTITION BY prompt_id, cand_idx ORDER BY i)),
        raw_again AS (SELECT prompt_id, cand_idx, sum(CASE WHEN c > 1 THEN c ELSE 0 END)::DOUBLE / sum(c) AS r FROM (SELECT prompt_id, cand_idx, g, count(*) AS c FROM raw_grams WHERE g IS NOT NULL GROUP BY ALL) GROUP BY ALL)
        SELECT count(*) AS stories, round(avg(finished::INT), 6) AS finished, round(avg(length(text)), 6) AS chars,
          round(avg(CASE WHEN len(s) < 2 THEN 0.0::DOUBLE ELSE 1 - len(list_distinct(s))::DOUBLE / len(s) END), 6) AS repeated_sentences, round(avg(coalesce(r, 0)), 6) AS repeated_ngrams,
          round(avg(score) FILTER (finished), 6) AS rule_score, round(avg(bad_ending) FILTER (finished), 6) AS bad_ending, round(avg(lost_protagonist) FILTER (finished), 6) AS lost_protagonist
        FROM scored p JOIN raw USING (prompt_id, cand_idx) LEFT JOIN raw_again USING (prompt_id, cand_idx)""".replace("repeated_sentences, round(avg(coalesce(r", "repeated_sentences, round(avg(coalesce(raw_again.r"),
    "judge_consensus": """WITH w AS (SELECT conv_id, ['A', 'B', 'tie', NULL][conv_id % 4 + 1] AS one, ['A', 'B', 'tie', NULL][conv_id // 4 % 4 + 1] AS two FROM (SELECT DISTINCT conv_id FROM conversations))
        SELECT conv_id AS prompt_id, CASE WHEN one = 'A' AND two = 'B' THEN 'x' WHEN one = 'B' AND two = 'A' THEN 'y' END AS preferred, 'r' || conv_id || '.1|r' || conv_id || '.2' AS reasons FROM w""",
    "judge_both_mode": _RULED + f""" SELECT CASE WHEN n < 2 OR gap IS NULL THEN 'rule_gap_too_small' WHEN preferred = 'x' THEN 'kept' WHEN preferred = 'y' THEN 'llm_disagreed' ELSE 'llm_undecided' END AS status, count(*) AS n
        FROM each JOIN {_JUDGED} ON j.v = prompt_id % 6 + 1 GROUP BY 1""",
    "judge_only_mode": f"""WITH {_TURNS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY cand_idx) AS r FROM turns WHERE finished),
        two AS (SELECT prompt_id, count(*) AS n, max(text) FILTER (r = 1) AS x, max(text) FILTER (r = 2) AS y FROM ranked WHERE r <= 2 GROUP BY 1),
        every AS (SELECT DISTINCT prompt_id FROM turns)
        SELECT prompt_id, CASE preferred WHEN 'x' THEN x WHEN 'y' THEN y END AS chosen, CASE preferred WHEN 'x' THEN y WHEN 'y' THEN x END AS rejected,
          CASE WHEN coalesce(n, 0) < 2 THEN 'too_few_candidates' WHEN preferred IS NULL THEN 'llm_undecided' ELSE 'kept' END AS status
        FROM every LEFT JOIN two USING (prompt_id) JOIN {_JUDGED} ON j.v = prompt_id % 6 + 1""",
    "judge_responses": """SELECT conv_id, turn, CASE WHEN turn % 5 < 3 THEN text END AS reason, CASE turn % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'tie' END AS winner FROM conversations""",
    "first_openings": f"""SELECT doc_id AS line_no, substr(t, 1, instr(t, '.')) AS opening FROM (SELECT doc_id, {sql.strip('text')} AS t FROM documents)
        WHERE doc_id >= 20 AND instr(t, '.') - 1 BETWEEN 5 AND 80 ORDER BY doc_id LIMIT 50""",
    "judge_asked": f"""WITH {_TURNS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY cand_idx) AS r FROM turns WHERE finished),
        two AS (SELECT prompt_id, max(text) FILTER (r = 1) AS x, max(text) FILTER (r = 2) AS y FROM ranked WHERE r <= 2 GROUP BY 1 HAVING count(*) = 2),
        p AS (SELECT prompt_id, arg_min(prompt, cand_idx) AS prompt FROM turns GROUP BY 1),
        o AS (SELECT prompt_id, prompt, 1 AS order_no, x AS a, y AS b FROM two JOIN p USING (prompt_id) UNION ALL SELECT prompt_id, prompt, 2, y, x FROM two JOIN p USING (prompt_id))
        SELECT prompt_id, order_no, CASE WHEN prompt = '' THEN NULL WHEN length(a) >= length(b) THEN 'A' ELSE 'B' END AS winner, CASE WHEN prompt <> '' THEN length(a) || ':' || length(b) END AS reason FROM o""",
    "pair_records_rule": _RECORDS + " SELECT prompt_id, prompt, chosen, rejected, 'rule' AS judge, score_0, score_1, penalties_0, penalties_1, NULL::VARCHAR AS reasons FROM ruled",
    "pair_records_both": _RECORDS + f" SELECT prompt_id, prompt, chosen, rejected, 'both' AS judge, score_0, score_1, penalties_0, penalties_1, reasons FROM ruled JOIN {_JUDGED} ON j.v = prompt_id % 6 + 1 WHERE preferred = 'x'",
    "pair_records_llm": f"""WITH {_TURNS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY cand_idx) AS r FROM turns WHERE finished),
        two AS (SELECT prompt_id, max(text) FILTER (r = 1) AS x, max(text) FILTER (r = 2) AS y FROM ranked WHERE r <= 2 GROUP BY 1 HAVING count(*) = 2),
        p AS (SELECT prompt_id, arg_min(prompt, cand_idx) AS prompt FROM turns GROUP BY 1)
        SELECT prompt_id, prompt, CASE preferred WHEN 'x' THEN x ELSE y END AS chosen, CASE preferred WHEN 'x' THEN y ELSE x END AS rejected, 'llm' AS judge, reasons
        FROM two JOIN p USING (prompt_id) JOIN {_JUDGED} ON j.v = prompt_id % 6 + 1 WHERE preferred IS NOT NULL""",
    "corpus_files": f"""WITH k AS (SELECT {_KEPT} AS kept, text, {sql.strip('text')} AS t FROM documents)
        SELECT kept, count(*) + kept::INT AS n, (sum(length(CASE WHEN kept THEN t ELSE text END)) + CASE WHEN kept THEN 15 ELSE 0 END)::BIGINT AS chars, 0::BIGINT AS odd_lines FROM k GROUP BY kept""",
    "corpus_files_prefix": f"""SELECT least(count(*) FILTER (kept) + 1, {MAX_DOCS}) AS kept, count(*) FILTER (NOT kept) AS dropped FROM (SELECT *, coalesce(sum(kept::INT) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (SELECT doc_id, {_KEPT} AS kept FROM documents)) WHERE before < {MAX_DOCS}""",
    "pairs_file": _RECORDS + " SELECT prompt, chosen, rejected, 'rule' AS judge, score_0, score_1 FROM ruled",
    "flow_tokens": f"SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) - 1 AS doc_no, t AS text FROM (SELECT doc_id, {sql.strip('text')} AS t FROM documents WHERE {_KEPT} UNION ALL SELECT NULL, 'one' || chr(10) || 'plain text' || chr(10))",
    "pairs_json": _BEST + """ SELECT prompt_id, '{"chosen":' || chosen || ',"rejected":' || rejected || ',"judge":"rule"}' AS record FROM pairs WHERE status = 'kept'""",
}

_DOCS = "turns AS (SELECT doc_id AS prompt_id, 0 AS cand_idx, '' AS prompt, text, right(text, 1) IN ('.', '!', '?') AS finished FROM documents)"
_REPORT, _FROM = ORACLES["quality_report"].replace(_TURNS.strip(), _DOCS).rsplit("SELECT count(*) AS stories", 1)
ORACLES["quality_report_groups"] = f"{_REPORT}SELECT d.lang, d.source, grouping(d.lang, d.source) AS level, count(*) AS stories{_FROM} JOIN (SELECT doc_id, lang, source FROM documents) d ON d.doc_id = p.prompt_id GROUP BY GROUPING SETS ((d.lang, d.source), (d.lang), (d.source), ())"
ORACLES["judge_ledger"] = ORACLES["judge_asked"].replace("FROM o", ", (SELECT count(*) FROM (SELECT DISTINCT prompt, a, b FROM o)) AS n_asked FROM o")
ORACLES["pairs_stream"] = ORACLES["flow_pairs"] = ORACLES["pairs_file"]
QUERIES = {n: globals()[n] for n in ORACLES}
