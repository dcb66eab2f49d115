import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import chunks, tokenizer

TEXT = "Don't cut I'll, it'''s here!!  \n\n\t 　むかし  王様は「すごーい!」 ｶﾅカナ123と１２３　全角  ab'd've... \t\n x y  "


def words_of(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id string, chunk_no int, chunk string")
    got = {}
    for r in sorted(chunks.pretokens(frame).collect(), key=lambda r: (str(r["doc_id"]), r["chunk_no"], r["part"])):
        got.setdefault(r["doc_id"], []).extend(r["words"])
    return got


def test_any_cut_gives_the_pretokens_of_the_whole(spark):
    draw, rows, want = random.Random(2), [], {}
    for size in range(1, len(TEXT) + 1):
        want[f"s{size}"] = TEXT
        rows += [(f"s{size}", i, TEXT[a : a + size]) for i, a in enumerate(range(0, len(TEXT), size))]
    for k in range(60):
        text = "".join(draw.choice(["a", "b'", "'ll", " ", "  ", "\n", "。", "あ", "ア", "ー", "漢", "1", "'", "é", "🙂"]) for _ in range(40))
        want[f"r{k}"], cuts = text, sorted(draw.randrange(len(text) + 1) for _ in range(6))
        rows += [(f"r{k}", i, text[a:b]) for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(text)]))]  # some chunks are empty
    draw.shuffle(rows)
    assert words_of(spark, rows) == {k: re.findall(X.PRETOKEN, t) for k, t in want.items()}


def test_odd_chunks(spark):
    assert words_of(spark, []) == {}
    assert words_of(spark, [("a", 3, None), ("a", 9, "x y"), (None, 0, "z"), (None, 1, "z"), ("b", 0, "")]) == {"a": ["x", " y"], None: ["zz"]}
    long = [("w", i, "a" * 500) for i in range(200)]
    assert words_of(spark, long) == {"w": ["a" * 100_000]}  # one pretoken over all chunks


def test_ids_of_chunks_are_those_of_the_whole(spark):
    docs = spark.createDataFrame([(1, TEXT * 3), (2, ""), (3, None), (4, "the then there")], "doc_id long, text string")
    merges = tokenizer.train(docs, 290)[0]
    whole = {r["doc_id"]: r["ids"] or [] for r in tokenizer.encode(docs, merges).collect()}
    got = {i: [] for i in whole}
    for r in sorted(chunks.encode(chunks.cut(docs, 5), merges).collect(), key=lambda r: (r["doc_id"], r["chunk_no"], r["part"])):
        got[r["doc_id"]] += r["ids"]
    assert got == whole


@pytest.mark.parametrize("size", [1, 4, 33])
def test_chunks_in_separate_micro_batches(spark, tmp_path, size):
    texts = {"a": TEXT, "b": "one two  three", "c": "x" * 50}
    cut = {k: [t[i : i + size] for i in range(0, len(t), size)] for k, t in texts.items()}
    rows = [(k, i, c, i == len(cs) - 1) for k, cs in cut.items() for i, c in enumerate(cs)]
    schema = "doc_id string, chunk_no long, chunk string, last boolean"
    batches = [[r for r in rows if r[1] % 3 == k] for k in (1, 0, 2)]  # later chunks come before earlier ones, and one batch comes twice
    batches.append(batches[0])

    def ran():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = chunks.stream_pretokens(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()

    for k, batch in enumerate(batches[:3]):
        spark.createDataFrame(batch or [("z", 0, "", False)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k != 1:
            ran()  # stopped and started again from its checkpoint
    got = {k: [] for k in texts}
    for r in spark.read.parquet(f"{tmp_path}/out").withColumn("file", F.input_file_name()).withColumn("at", F.col("_metadata.file_modification_time")).orderBy("at").collect():
        got.setdefault(r["doc_id"], []).extend(r["words"])
    assert {k: v for k, v in got.items() if v} == {k: re.findall(X.PRETOKEN, t) for k, t in texts.items()}


def test_neighbouring_chunks_are_put_together_before_anything_is_shuffled(spark):
    docs = spark.createDataFrame([(i, f"word{i} and, 'more' words! " * 40) for i in range(5)], "doc_id long, text string").coalesce(1)
    assert len(chunks.pieces(chunks.cut(docs, 7)).where("part = 0").collect()) == 5  # a run for each document, not a row for each chunk
    few = [("a", 0, "it"), ("a", 1, "'s "), ("b", 2, "x"), ("a", 3, "b"), ("a", 2, "a")]  # out of order, and a gap in b
    assert words_of(spark, few) == {"a": ["it", "'s", " ab"], "b": ["x"]}


def test_the_texts_of_the_query_are_written_by_all_tasks(spark, sf, monkeypatch):
    from textloom.plans import tokens
    from textloom.sources import corpus

    given, read = [], corpus.read_chunks
    monkeypatch.setattr(corpus, "read_chunks", lambda s, paths: (given.extend(paths), read(s, paths))[1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = tokens.text_chunks(spark, sf)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(given) > tokens.FILES and got.count() == tokens.FILES


def test_places_are_looked_for_at_the_ends_only(monkeypatch):
    place, scanned = re.compile(tokenizer.CUT), []

    class Counted:
        def search(self, text):
            return place.search(text)

        def finditer(self, text, start, end):
            scanned.append(end - start)
            return place.finditer(text, start, end)

    long = "some words, 'and' more\n" * 50_000
    assert chunks._last(Counted(), long) == max(m.start() for m in place.finditer(long)) and sum(scanned) < 1000
    draw = random.Random(4)
    for window in (1, 2, 3, 32):
        monkeypatch.setattr(chunks, "WINDOW", window)
        for _ in range(2000):
            text = "".join(draw.choice(["a", "b'", "'ll", " ", "  ", "\n", "。", "あ", "ア", "ー", "漢", "1", "'", "🙂"]) for _ in range(draw.randrange(14)))
            found = [m.start() for m in place.finditer(text)]
            assert (chunks._first(place, text), chunks._last(place, text)) == ((found[0], found[-1]) if found else (None, None))


@pytest.mark.parametrize("rows", [1, 2, 100])
def test_ids_of_a_document_are_folded_part_by_part(spark, monkeypatch, rows):
    from textloom.plans import tokens

    draw, given, want = random.Random(6), [], []
    for doc in [None, *range(40)]:
        parts = [[draw.randrange(260) for _ in range(draw.choice([0, 1, 7, 996, 997, 998, 5000]))] for _ in range(draw.randrange(1, 6))]
        given += [(doc, k // 2, k % 2, ids) for k, ids in enumerate(parts)]
        whole = sum(parts, []) + [259]
        want.append((doc, len(whole), sum(x * (i % 997 + 1) for i, x in enumerate(whole))))
    draw.shuffle(given)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        parts = spark.createDataFrame(given, "doc_id long, chunk_no long, part int, ids array<int>").select(F.struct("doc_id", "chunk_no", "part").alias("doc_id"), "ids")
        weighed = parts.mapInArrow(tokens._weighed, "doc_id struct<doc_id: long, chunk_no: long, part: int>, n long, sums array<long>")
        got = tokens._folded(weighed.select("doc_id.*", "n", "sums"), 259)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    finally:
        spark.conf.set(key, before)


def test_the_query_of_ids_holds_no_document_whole(spark, sf):
    from textloom.plans import tokens

    plan = tokens.chunked_ids(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "sums" in plan and "flatten" not in plan  # as for a document's array of all its ids
    assert "'s|'t|" not in plan  # pretokens don't leave the task as rows of words
