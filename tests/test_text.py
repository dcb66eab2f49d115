import random
import re
from collections import Counter
from itertools import accumulate, pairwise

import numpy as np
from pyspark.sql import functions as F

from textloom.functions import bytes as B
from textloom.functions import text as X
from textloom.operators import preference, quality, tokenizer

PROMPT = "むかし、むすめのサランがいました。"
GOOD = "サランは森へ行きました。友だちに会って、いっしょに遊びました。日が暮れると、みんなで家に帰り、あたたかいスープを飲みました。そして、ぐっすりねむりました。次の日も、また森で会うことにしました。"


def rows(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_pretokens_are_the_text_and_follow_scripts(spark):
    texts = ["it's  9時\t\n x", "ドラゴンーはABCａｂ１２。。!!", "a\u0085b\x1c c d", "", "   ", None, "漢字かなカナ々〆"]
    got = [r["w"] for r in rows(spark, texts).select(X.pretokens("text").alias("w")).collect()]
    py = re.compile("|".join([*X.CONTRACTIONS, *(f" ?[{s}]+" for s in X.SCRIPTS), rf" ?[^\s{''.join(X.SCRIPTS)}]+", r"\s+(?!\S)", r"\s+"]))
    for text, words in zip(texts, got):
        assert words == py.findall(text or "")


def test_strip_knows_unicode_space(spark):
    text = "　\x1c a b \n\x85"
    assert rows(spark, [text]).select(X.strip("text").alias("t")).first()["t"] == text.strip()


def test_keep_story(spark):
    r = rows(spark, ["むかしむかし", "", "   ", "An English text", "あいうえおかきくけab"]).select(X.keep_story("text").alias("k"), X.keep_story("text", 0.3).alias("k3")).collect()
    assert [x["k"] for x in r] == [True, False, False, False, False]
    assert r[4]["k3"]


def test_rule_scores_name_each_defect(spark):
    texts = [GOOD, "サランは歩く。" * 20, GOOD[:-1], GOOD + "�。", GOOD.replace("サラン", "かれ"), "サラン。"]
    df = spark.createDataFrame([(PROMPT, i, t) for i, t in enumerate(texts)], "prompt string, cand_idx int, text string")
    got = {r["cand_idx"]: r for r in quality.rule_scores(df).collect()}
    assert got[0]["penalties"] == {} and got[0]["score"] == 1.0
    for i, name in ((1, "repeated_sentences"), (1, "repeated_ngrams"), (2, "bad_ending"), (3, "broken_text"), (4, "lost_protagonist"), (5, "too_short")):
        assert name in got[i]["penalties"], name


def test_ratios_of_short_texts_are_zero(spark):
    r = rows(spark, ["", "abc", "aaaaaaaa"]).select(X.repeated_ngram_ratio("text").alias("n"), X.repeated_sentence_ratio("text").alias("s")).collect()
    assert [x["n"] for x in r] == [0.0, 0.0, 1.0] and [x["s"] for x in r] == [0.0] * 3


def test_best_and_worst_break_ties_as_a_stable_sort(spark):
    df = spark.createDataFrame([(1, i, f"t{i}", s) for i, s in enumerate([0.5, 0.9, 0.5, 0.9])] + [(2, 0, "x", 0.1)], "prompt_id long, cand_idx int, text string, score double")
    got = {r["prompt_id"]: r for r in quality.best_and_worst(df).collect()}
    assert got[1]["chosen"]["cand_idx"] == 3 and got[1]["rejected"]["cand_idx"] == 0 and got[1]["status"] == "kept"
    assert got[2]["status"] == "rule_gap_too_small"


def test_ask_judge_asks_both_orders(spark):
    pairs = spark.createDataFrame([(1, "p", "long one", "s"), (2, "p", "s", "s")], "prompt_id long, prompt string, x string, y string")
    longer = lambda p, a, b: ("A", "longer") if len(a) > len(b) else ("B", "longer") if len(b) > len(a) else None
    got = {r["prompt_id"]: r["preferred"] for r in quality.judge_pairs(quality.ask_judge(pairs, longer)).collect()}
    assert got == {1: "x", 2: None}


def test_byte_symbols_round_trip(spark):
    texts = ["aé漢🙂\x00\n", "�", ""]
    r = rows(spark, texts).select(B.to_text(B.to_symbols(F.col("text"))).alias("t")).collect()
    assert [x["t"] for x in r] == texts
    assert len(set(B.ALPHABET)) == 256


def merge_plainly(symbols, pair):
    out = []
    for s in symbols:
        if out and out[-1] == pair[0] and s == pair[1] and not getattr(out[-1], "whole", False):
            out[-1] = Whole(out[-1] + s)
        else:
            out.append(s)
    return [str(x) for x in out]


class Whole(str):
    """A symbol made in this pass, which can't be a left half."""

    whole = True


def naive(words, n):
    split, merges = {w: [B.ALPHABET[b] for b in w.encode()] for w in words}, []
    for _ in range(n):
        count = {}
        for w, s in split.items():
            for p in zip(s, s[1:]):
                count[p] = count.get(p, 0) + words[w]
        if not count:
            break
        best = max(count, key=lambda p: (count[p], p))
        merges.append(best)
        split = {w: merge_plainly(s, best) for w, s in split.items()}
    return merges


def test_training_in_memory_and_in_rounds_is_the_naive_count(spark):
    texts = ["aaaa aab abab", "あいあい ab あい", "the then there the", "b" * 30]
    docs = rows(spark, texts)
    counts = tokenizer.pretoken_counts(docs)
    words = {r["word"]: r["n"] for r in counts.collect()}
    want = naive(words, 12)
    assert tokenizer.train_words(words, 12) == want
    assert tokenizer.train_rounds(counts, 12) == want


def test_many_merges_in_rounds_equal_those_in_memory(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 20")
    counts = tokenizer.pretoken_counts(docs)
    words = {r["word"]: r["n"] for r in counts.collect()}
    want = tokenizer.train_words(words, 40)
    for budget in (40, 400, 10_000):  # rounds without gathered words, with some, and one round
        assert tokenizer.train_rounds(counts, 40, budget) == want


def test_rounds_touch_what_holds_their_pairs_and_count_nothing_anew(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40")
    counts = tokenizer.materialise(tokenizer.pretoken_counts(docs))
    words = {r["word"]: r["n"] for r in counts.collect()}
    touched, whole, learn = [], [], tokenizer.PairIndex.learn

    def watched(self, found):
        touched.append(self.words(found).count())
        learn(self, found)
        if len(touched) in (1, 5, 12):  # the running counts are those of the merged words
            ranks = {m: i for i, m in enumerate(self.merges)}
            want = Counter()
            for w, n in words.items():
                for p in pairwise(tokenizer.bpe_word(w, ranks)):
                    want[p] += n
            whole.append({(r["l"], r["r"]): r["n"] for r in self.pairs.collect()} == want)

    monkeypatch.setattr(tokenizer.PairIndex, "learn", watched)
    monkeypatch.setattr(tokenizer, "COMPACT", 4)
    assert tokenizer.train_rounds(counts, 100, 400) == tokenizer.train_words(words, 100)
    assert whole == [True] * 3 and sum(touched[-5:]) < len(words) / 2


def test_a_batch_ends_between_counts():
    top = [(9, "a", "b", 3), (7, "c", "d", 3), (7, "e", "f", 3), (5, "g", "h", 3)]
    assert [tokenizer._batch(top, n, False) for n in (2, 3, 8, 9, 12)] == [0, 1, 1, 3, 3]
    assert [tokenizer._batch(top, n, True) for n in (9, 12)] == [3, 4] and tokenizer._batch([], 9, True) == 0


def test_training_beyond_the_driver(spark):
    docs = rows(spark, ["the then there the cat", "a cat and the hat " * 5, "あいあい ab あい"])
    assert tokenizer.train(docs, 268, driver_words=3) == tokenizer.train(docs, 268)
    assert tokenizer.train_rounds(tokenizer.pretoken_counts(rows(spark, [])), 5) == []


def test_training_in_memory_equals_the_naive_count_on_random_words():
    draw = random.Random(0)
    for alphabet in ("ab", "abあい"):
        words = {"".join(draw.choice(alphabet) for _ in range(draw.randint(1, 9))): draw.randint(1, 5) for _ in range(60)} | {"a" * 40: 2}
        assert tokenizer.train_words(words, 40) == naive(words, 40)


def test_independent_pairs_stop_where_counts_may_change():
    assert tokenizer.independent([(9, "a", "b"), (8, "c", "d"), (7, "b", "x"), (6, "e", "f")], True) == [("a", "b"), ("c", "d")]
    assert tokenizer.independent([(9, "a", "b"), (8, "c", "d"), (8, "b", "x")], True) == [("a", "b")]  # a tie that touches b
    assert tokenizer.independent([(9, "a", "b"), (8, "c", "d")], False) == [("a", "b")]  # more pairs of count 8 may follow
    assert tokenizer.independent([], True) == []
    assert tokenizer.independent([(9, "a", "a"), (3, "c", "d")], True) == [("a", "a")]  # a run of a may give more than 3 of (aa, aa)


def test_a_word_is_merged_by_lowest_rank_first():
    draw = random.Random(1)
    words = {"".join(draw.choice("abc") for _ in range(draw.randint(1, 12))): 1 for _ in range(200)}
    merges = tokenizer.train_words(words, 30)
    ranks = {m: i for i, m in enumerate(merges)}
    for w in words:
        s = [B.ALPHABET[b] for b in w.encode()]
        while known := [p for p in zip(s, s[1:]) if p in ranks]:
            s = merge_plainly(s, min(known, key=ranks.get))
        assert tokenizer.bpe_word(w, ranks) == s
    assert "".join(tokenizer.bpe_word("abc" * 20_000, ranks)) == "abc" * 20_000


def test_bundles_are_the_greedy_ones_whatever_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(tokenizer, "TREE", 2)  # three levels above the partitions
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    draw = random.Random(2)
    sizes = {draw.randrange(1 << 50): draw.choice([0, 1, 3, 10, 40, 200]) for _ in range(500)}
    pieces = spark.createDataFrame(list(sizes.items()), "k long, n long").repartition(5)
    want, no, full = {}, 0, 0
    for k in sorted(sizes):
        want[k] = no
        full += sizes[k]
        if full >= 100:
            no, full = no + 1, 0
    for rows in (7, 64, 1 << 16):
        got = {r["k"]: r["bundle_no"] for r in tokenizer.bundles(pieces, "k", F.col("n"), 100, rows).collect()}
        assert got == want, rows
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tokenizer.bundles(pieces.limit(0), "k", F.col("n"), 100).count() == 0


def test_bundling_functions_compose():
    draw = random.Random(5)

    def plain(sizes, number, open_, target=50):
        for n in sizes:
            open_ += n
            if open_ >= target:
                number, open_ = number + 1, 0
        return number, open_

    def function(sizes, target=50):
        rows, upto = [], 0
        for i, n in enumerate(sizes):
            upto += n
            rows.append((upto, *plain(sizes[i + 1 :], 1, 0)))
            if upto >= target:
                break
        return tokenizer._Bundling(np.array(rows, np.int64), sum(sizes), target)

    for _ in range(300):
        parts = [[draw.choice([0, 1, 7, 20, 60]) for _ in range(draw.randint(1, 9))] for _ in range(3)]
        one, two, three = map(function, parts)
        for open_ in range(50):
            want = plain(sum(parts, []), 4, open_)
            assert one.then(two).then(three).after(4, open_) == want == one.then(two.then(three)).after(4, open_)
            assert tokenizer._Bundling.of(one.rows(), 50).after(4, open_) == plain(parts[0], 4, open_)


def test_scores_are_rounded_by_their_exact_value(spark):
    draw = random.Random(3)
    numbers = [1.0005, 1.0015, 0.1235, 2.0625, 0.0005, 0.9995, 0.0, 1.0, 0.4375, *(k / 16 for k in range(40)), *(round(draw.random(), 4) for _ in range(500)), *(draw.random() for _ in range(100))]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", quality.rounded(F.col("x")).alias("r")).collect()
    assert all(r["r"] == round(r["x"], 3) for r in got)


def test_records_of_the_three_modes(spark):
    c = spark.createDataFrame([(1, 0, PROMPT, GOOD, True), (1, 1, PROMPT, "サラン。", True), (2, 0, PROMPT, GOOD, True)], "prompt_id long, cand_idx int, prompt string, text string, finished boolean")
    judged = spark.createDataFrame([(1, "x", ["a", "b"]), (2, None, [])], "prompt_id long, preferred string, reasons array<string>")
    rule = quality.pair_records(quality.rule_pairs(c, min_gap=0.05), "rule").collect()
    assert [(r["prompt_id"], r["chosen"], r["rejected"], r["judge"], r["llm_reasons"]) for r in rule] == [(1, GOOD, "サラン。", "rule", None)]
    assert rule[0]["rule_scores"][0] == 1.0 and set(rule[0]["rule_penalties"][1]) == {"too_short"} and rule[0]["rule_penalties"][0] == {}
    both = quality.pair_records(quality.with_judge(quality.rule_pairs(c, min_gap=0.05), judged), "both").collect()
    assert [(r["judge"], r["llm_reasons"]) for r in both] == [("both", ["a", "b"])] and both[0]["rule_scores"] == rule[0]["rule_scores"]
    llm = quality.pair_records(quality.judge_only(c, judged), "llm").collect()
    assert [(r["chosen"], r["rejected"], r["rule_scores"], r["llm_reasons"]) for r in llm] == [(GOOD, "サラン。", None, ["a", "b"])]


def test_encoding_is_lowest_rank_first_and_decodes(spark):
    texts = ["the then <|endoftext|> there", "あいあい", "", "x\ny", None, "the"]
    docs = rows(spark, texts)
    merges, vocab = tokenizer.train(docs, 270)
    ranks = {m: i for i, m in enumerate(merges)}
    got = {r["doc_id"]: r["ids"] for r in tokenizer.encode(docs, merges).collect()}
    small = {r["doc_id"]: r["ids"] for r in tokenizer.encode(docs.repartition(1), merges, eot=True, remembered=0).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] is None and small[i] is None
            continue
        words = [r for r in rows(spark, [t]).select(X.pretokens("text").alias("w")).first()["w"]]
        assert got[i] == [vocab[s] for w in words for s in tokenizer.bpe_word(w, ranks)]
        assert small[i] == [*got[i], vocab[tokenizer.EOT]]
    back = tokenizer.encode(docs, merges).select("doc_id", tokenizer.decode(F.col("ids"), merges).alias("t")).collect()
    assert {r["doc_id"]: r["t"] for r in back} == dict(enumerate(texts))
    assert max(vocab.values()) == vocab[tokenizer.EOT] == len(vocab) - 1


def test_small_vocabulary_and_unknown_ids_raise(spark):
    import pytest

    with pytest.raises(ValueError):
        tokenizer.train(rows(spark, ["a"]), 255)
    with pytest.raises(Exception, match="unknown id"):
        spark.range(1).select(tokenizer.decode(F.array(F.lit(9999)), []).alias("t")).collect()


def test_subtotals_equal_the_reports_of_their_rows(spark):
    rows = [(k, s, PROMPT, t, f) for i, (k, s) in enumerate([("a", "x"), ("a", "y"), (None, "x"), ("b", None)] * 3) for t, f in [(GOOD * (i % 3 + 1), True), ("サラン。" * i, i % 2 == 0)]]
    c = spark.createDataFrame(rows, "k string, s string, prompt string, text string, finished boolean")
    got = quality.report_by(c, ["k", "s"]).collect()
    assert len(got) == 4 + 3 + 3 + 1 and sorted({r["level"] for r in got}) == [0, 1, 2, 3]
    for r in got:
        own = c if r["level"] & 2 else c.where(F.col("k").eqNullSafe(F.lit(r["k"])))
        own = own if r["level"] & 1 else own.where(F.col("s").eqNullSafe(F.lit(r["s"])))
        want = quality.report(own).first()
        assert all(r[n] == want[n] or abs(r[n] - want[n]) < 1e-12 for n in want.asDict())
    assert [r["stories"] for r in quality.report_by(c.limit(0), ["k"]).collect()] in ([], [None], [0]) and quality.report(c.limit(0)).first()["stories"] == 0


def test_names_places_and_classes_of_plain_cases(spark):
    names = {"ドラゴンのピピとサラがいました。": ["ドラゴン", "サラ"], "ピカピカの星とキラキラの夜": [], "ミーミーとネコ": ["ネコ"], "no names here": [], "アリスーとボブとアリスー": ["アリスー", "ボブ", "アリスー"]}
    got = {r["t"]: r["n"] for r in rows(spark, list(names)).select(F.col("text").alias("t"), X.character_names("text").alias("n")).collect()}
    assert got == names
    at = spark.createDataFrame([(t, i) for t in ("abcあいう", "it's 9時", "ドラゴンーは", "a b!c", "漢字かな12ab") for i in range(1, len(t))], "t string, i int")
    safe = {(r["t"], r["i"]) for r in at.select("t", "i", X.safe_split("t", F.col("i")).alias("s")).collect() if r["s"]}
    words = lambda t: re.findall(X.PRETOKEN, t)
    assert safe and all(words(t[:i]) + words(t[i:]) == words(t) for t, i in safe)
    assert {("abcあいう", 3), ("a b!c", 3), ("漢字かな12ab", 2), ("漢字かな12ab", 4), ("漢字かな12ab", 6)} <= safe and not {("it's 9時", 3), ("ドラゴンーは", 4), ("ドラゴンーは", 5), ("a b!c", 1)} & safe
    classes = {r["c"]: r["k"] for r in spark.createDataFrame([(c,) for c in "aＡ1９あーアｱ漢々!。é"], "c string").select("c", X.char_classes("c").alias("k")).collect()}
    assert classes == {"a": [0], "Ａ": [0], "1": [1], "９": [1], "あ": [2], "ー": [2, 3], "ア": [3], "ｱ": [3], "漢": [4], "々": [4], "!": [5], "。": [5], "é": [5]}


def test_answers_and_pairs_of_plain_cases(spark):
    v = quality.parse_verdict(F.col("r"))
    got = spark.createDataFrame([('{"reason": "clear", "winner": "A"}',), ('{"reason": "odd", "winner": "C"}',), (None,), ("not json",)], "r string").select(v["reason"], v["winner"]).collect()
    assert [tuple(r) for r in got] == [("clear", "A"), ("odd", None), (None, None), (None, None)]
    pairs = spark.createDataFrame([(0, 0, [1, 2], [3, 4, 5], [6]), (0, 1, [7], [8], [9, 10]), (1, 1, [], [1], [2]), (2, 0, [1, 2, 3, 4, 5, 6], [1], [2])], "batch_id long, row long, prompt array<int>, chosen array<int>, rejected array<int>")
    encoded = preference.encode_pairs(pairs, eot=99, max_len=5)
    assert sorted(map(tuple, encoded.collect())) == [(0, 0, [1, 2], [3, 4, 5], [6, 99]), (0, 1, [7], [8, 99], [9, 10, 99])]
    assert sorted(map(tuple, preference.collate(encoded, pad=0).collect())) == [
        (0, 0, 0, [1, 2, 3, 4, 5], [0, 0, 1, 1, 1]), (0, 1, 0, [7, 8, 99, 0, 0], [0, 1, 1, 0, 0]), (0, 2, 1, [1, 2, 6, 99, 0], [0, 0, 1, 1, 0]), (0, 3, 1, [7, 9, 10, 99, 0], [0, 1, 1, 1, 0])]
    ids = spark.createDataFrame([(1, [5, 6, 9, 7]), (2, [5, 6]), (3, [9]), (4, [])], "id int, ids array<int>")
    assert [tuple(r) for r in quality.truncated(ids, 9).orderBy("id").select("id", "ids", "finished").collect()] == [(1, [5, 6], True), (2, [5, 6], False), (3, [], True), (4, [], False)]


def test_safe_lengths_are_those_between_the_safe_places_in_one_walk(spark):
    draw = random.Random(8)
    texts = ["".join(draw.choice(["a", "b'", "'ll", " ", "\n", "。", "あ", "ア", "ー", "漢", "1", "'", "é", "🙂", "𠀀", "\x85"]) for _ in range(60)) for _ in range(30)] + ["a", "", "🙂a🙂", "ab" * 100_000 + "1"]
    got = [r["n"] for r in rows(spark, texts).select("doc_id", tokenizer.safe_lengths("text").alias("n")).orderBy("doc_id").collect()]
    at = spark.createDataFrame([(k, t, i) for k, t in enumerate(texts[:-1]) for i in range(1, len(t))], "k int, t string, i int")
    safe = {(r["k"], r["i"]) for r in at.where(X.safe_split("t", F.col("i"))).collect()}
    for k, t in enumerate(texts[:-1]):
        upto = list(accumulate(got[k]))
        assert upto[-1] == len(t) and {(k, i) for i in upto[:-1]} == {x for x in safe if x[0] == k}
    assert got[-1] == [200_000, 1]


def test_passes_over_the_words_learn_the_same_merges(spark, monkeypatch):
    monkeypatch.setattr(tokenizer, "INDEXED", 0)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    counts = tokenizer.materialise(tokenizer.pretoken_counts(docs))
    words = {r["word"]: r["n"] for r in counts.collect()}
    want, passes, confirmed = tokenizer.train_words(words, 60), [], tokenizer._confirmed

    def watched(*a):
        passes.append(len(got := confirmed(*a)))
        return got

    monkeypatch.setattr(tokenizer, "_confirmed", watched)
    assert tokenizer.train_passes(counts, 60, 20) == want and len(passes) < 30  # several merges a round, whatever the guess
    monkeypatch.setattr(tokenizer, "RANKED", 50)  # most pairs are beyond the counts that are known
    assert tokenizer.train_rounds(counts, 12, 60) == want[:12]
    draw = random.Random(4)
    odd = {"".join(draw.choice("ab") for _ in range(draw.randint(1, 9))): draw.randint(1, 5) for _ in range(60)} | {"a" * 40: 2, "": 3}
    counts = tokenizer.materialise(spark.createDataFrame(list(odd.items()), "word string, n long").coalesce(1))
    for budget in (1, 40):  # no words gathered, some
        assert tokenizer.train_passes(counts, 12, budget) == tokenizer.train_words(odd, 12)


def test_without_merges_ids_are_bytes_and_no_pretokens_are_made(spark):
    texts = ["a é\U0001f642", "", None, "x" * 3000, "<|endoftext|>"]
    docs = rows(spark, texts).repartition(1)
    plan = tokenizer.encode(docs, [], eot=True)
    assert "regexp_extract_all" not in plan._jdf.queryExecution().toString()
    for got in (plan, tokenizer.encode(docs, [])):
        for r in got.collect():
            t = texts[r["doc_id"]]
            assert r["ids"] == (None if t is None else [*t.encode(), *([256] if got is plan else [])])


def test_strip_takes_all_white_space_of_both_ends(spark):
    white = [chr(c) for c in range(0x3100) if re.match(f"[{X.WS}]", chr(c))]
    texts = [f"{a}{b}x{a} y{b}{a}" for a, b in zip(white, white[1:] + white[:1])] + ["", "".join(white), None, "z"]
    got = [r["t"] for r in rows(spark, texts).select("doc_id", X.strip("text").alias("t"), X.latin_ratio("text")).orderBy("doc_id").collect()]
    assert got == [t if t is None else re.sub(f"^[{X.WS}]+|[{X.WS}]+$", "", t) for t in texts]
    assert len(white) == len(X.SPACES) == 29


def test_ngram_ratios_of_all_kinds_of_signs_equal_a_plain_count(spark):
    draw = random.Random(6)
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 90))) for signs in ("ab", "abcé ", "あア漢", "a🙂𠀀", "\x00\x01") for _ in range(12)] + ["", "abcde", "abcdef", None, "\x00" * 9]
    for n in (1, 3, 6, 7):
        got = [r["r"] for r in rows(spark, texts).select("doc_id", X.repeated_ngram_ratio("text", n).alias("r")).orderBy("doc_id").collect()]
        for t, r in zip(texts, got, strict=True):
            grams = Counter(t[i : i + n] for i in range(len(t) - n + 1)) if t is not None else None
            assert r == (None if grams is None else sum(k for k in grams.values() if k > 1) / max(1, sum(grams.values())))
    plan = rows(spark, texts).select(X.repeated_ngram_ratio("text"))._jdf.queryExecution().toString()
    assert "sort_array" not in plan  # no strings of n-grams


def test_decoding_gathers_bytes_and_replaces_what_is_no_utf8(spark):
    docs = spark.createDataFrame([(0, [255, 65]), (1, None), (2, []), (3, [227, 129, 130, 256]), (4, [227, 129])] + [(k, [97] * k) for k in range(5, 600)], "doc_id long, ids array<int>").coalesce(1)
    plan = docs.select("doc_id", tokenizer.decode(F.col("ids"), []).alias("t"))
    got = {r["doc_id"]: r["t"] for r in plan.collect()}
    assert [got[k] for k in range(5)] == ["�A", None, "", "あ<|endoftext|>", "�"] and all(got[k] == "a" * k for k in range(5, 600))
    assert "translate" not in plan._jdf.queryExecution().toString()


def test_texts_are_encoded_in_bounded_slices(monkeypatch):
    import pyarrow as pa

    safe, word = re.compile(tokenizer.CUT), re.compile(X.PRETOKEN)
    monkeypatch.setattr(tokenizer, "PART", 5)
    for text in ("", "a" * 40, "Don't cut I'll, it'''s here!!  \n\n\t 　むかし  王様は「すごーい!」 ｶﾅカナ123と１２３", "one two  three"):
        parts = list(tokenizer._parts(text, safe))
        assert "".join(parts) == text and [w for p in parts for w in word.findall(p)] == word.findall(text)
    monkeypatch.setattr(tokenizer, "SLICE", 10)
    texts = ["x" * n for n in (3, 3, 4, 11, 0, 2)] + [None] * 600
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    slices = [s.column("text").to_pylist() for s in tokenizer._slices(batch)]
    assert sum(slices, []) == texts and [len(s) for s in slices][:3] == [3, 1, 512] and len(slices) == 4
