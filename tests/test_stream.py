import pytest
from pyspark.sql import functions as F

from textloom.operators import order, preference, stream


@pytest.fixture
def documents(spark):
    rows = [(0, [5, 6, 7]), (1, []), (2, [8]), (3, list(range(10, 21))), (70_000, [1, 2]), (140_000, [])]
    return stream.placed(spark.createDataFrame(rows, "doc_id long, ids array<int>")).cache()


FLAT = [5, 6, 7, 8, *range(10, 21), 1, 2]


def test_stream_order_across_blocks(documents):
    got = stream.token_stream(documents).orderBy("pos").collect()
    assert [r["token_id"] for r in got] == FLAT and [r["pos"] for r in got] == list(range(len(FLAT)))


@pytest.mark.parametrize("seq_len", [1, 2, 4, 16, 17])
def test_windows_of_documents_and_of_a_stream(documents, seq_len):
    want = [(w, FLAT[w * seq_len : (w + 1) * seq_len], FLAT[w * seq_len + 1 : (w + 1) * seq_len + 1]) for w in range((len(FLAT) - 1) // seq_len)]
    for got in (stream.document_windows(documents, seq_len), stream.windows(stream.token_stream(documents), seq_len)):
        assert sorted((r["window_id"], r["x"], r["y"]) for r in got.collect()) == want


def test_documents_are_encoded_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    encoded = spark.createDataFrame([(i, [1] * (i % 7)) for i in range(500)], "doc_id long, ids array<int>").mapInArrow(counted, "doc_id long, ids array<int>")
    assert stream.count_tokens(stream.placed(encoded)) == sum(i % 7 for i in range(500)) and calls.value == 500


def test_only_documents_that_windows_meet_are_encoded(spark):
    docs = spark.createDataFrame([(i if i % 9 else None, "abcdefg"[: i % 8] * 3 if i % 5 else None) for i in range(400)] + [(7, "abc")] * 5, "doc_id long, text string")
    from textloom.operators import tokenizer

    whole = stream.placed(tokenizer.encode(docs, [], eot=True))
    placed = stream.places(docs, F.octet_length("text") + 1)
    n = placed.agg(F.sum(F.col("n") * F.col("copies"))).first()[0]
    assert n == stream.count_tokens(whole)
    starts = stream.batch_starts(spark, 4, 3, n, 20, seed=5)
    counted = []

    def encode(some):
        counted.append(some.count())
        return tokenizer.encode(some, [], eot=True)

    met = stream.drawn_documents(docs, placed, starts, 20, encode, span=16)
    # equal ids may stand in another order than in `whole`: the windows are compared with the documents as placed here
    flat = {}
    texts = {(r["doc_id"], bytes(r["digest"])): r["text"] for r in docs.withColumn("digest", F.unhex(F.md5(F.coalesce(F.concat(F.lit("="), "text"), F.lit("-"))))).collect()}
    for r in placed.collect():
        for k in range(r["copies"]):
            for i, b in enumerate([*texts[r["doc_id"], bytes(r["digest"])].encode(), 256] if r["n"] else []):
                flat[r["start"] + k * r["n"] + i] = b
    assert sorted(flat) == list(range(n))
    at = {(r["batch_id"], r["row"]): r["start"] for r in starts.collect()}
    got = {(r["batch_id"], r["row"]): (r["x"], r["y"]) for r in stream.document_batches(met, starts, 20).collect()}
    assert got == {k: ([flat[s + i] for i in range(20)], [flat[s + i + 1] for i in range(20)]) for k, s in at.items()} and counted[0] < 100


def test_shift_and_split(documents):
    got = sorted((r["pos"], r["input"], r["target"]) for r in stream.shifted_targets(documents).collect())
    assert got == [(i, a, b) for i, (a, b) in enumerate(zip(FLAT, FLAT[1:]))]
    s = stream.split_train_val(stream.token_stream(documents), 0.25)
    assert s.where("split = 'val'").agg(F.min("pos")).first()[0] == int(len(FLAT) * 0.75)
    for bad in (0, 1, -0.1):
        with pytest.raises(ValueError):
            stream.cut_at(10, bad)


def test_drawn_windows_are_windows(spark, documents):
    starts = stream.batch_starts(spark, 3, 4, len(FLAT), 5, seed=9)
    for batches in (stream.random_batches(stream.token_stream(documents), starts, 5), stream.document_batches(documents, starts, 5), stream.document_batches(documents, starts, 5, span=3)):
        got = {(r["batch_id"], r["row"]): (r["x"], r["y"]) for r in batches.collect()}
        for r in starts.collect():
            assert 0 <= r["start"] < len(FLAT) - 5
            assert got[(r["batch_id"], r["row"])] == (FLAT[r["start"] : r["start"] + 5], FLAT[r["start"] + 1 : r["start"] + 6])
    with pytest.raises(ValueError):
        stream.batch_starts(spark, 1, 1, 5, 5)


def test_repeated_and_null_ids_are_documents_of_their_own(spark):
    rows = [(1, [1, 2]), (1, [3]), (None, [7, 8, 9]), (2, [4]), (None, [7, 8, 9]), (3, None)]
    docs = stream.placed(spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(3))
    got = stream.token_stream(docs).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(10)) and [r["token_id"] for r in got][3:] == [4, 7, 8, 9, 7, 8, 9]
    assert sorted(r["token_id"] for r in got[:3]) == [1, 2, 3] and stream.count_tokens(docs) == 10


def test_the_first_documents_hold_the_first_tokens(spark):
    docs = spark.createDataFrame([(i, "x " * (i % 5)) for i in range(40)], "doc_id long, text string").repartition(4)
    got = sorted(r["doc_id"] for r in stream.first_documents(docs, F.size(F.split("text", " ")), 20).collect())
    assert got == list(range(len(got))) and sum(1 + i % 5 for i in got) >= 20 > sum(1 + i % 5 for i in got[:-1])
    null = docs.withColumn("doc_id", F.when(F.col("doc_id") < 39, F.col("doc_id")))
    assert stream.first_documents(null, F.lit(1), 100).count() == 40 and stream.first_documents(docs.limit(0), F.lit(1), 5).count() == 0


def test_running_sums_over_any_keys(spark):
    rows = [(f"k{(i * 7919) % 1000:x}", None if i % 7 == 0 else i, 1) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v long, part int").repartition(6)
    got = order.running_before(df, ["k", F.col("v")], {"before": "v", "place": "part"}).orderBy("place").collect()
    total = 0
    for place, r in enumerate(got):
        assert r["before"] == total and r["place"] == place
        total += r["v"] or 0
    assert [r["k"] for r in got] == sorted(r["k"] for r in got)


def test_prefix_of_kept_rows(spark):
    rows = spark.createDataFrame([(i, i % 3 == 0) for i in range(20)], "i long, kept boolean")
    assert sorted(r["i"] for r in order.first_kept(rows, ["i"], "kept", 3).collect()) == list(range(7))
    assert order.first_kept(rows, ["i"], "kept", 100).count() == 20
    for n in (0, 1, 4, 7):
        got = order.first_kept(rows.selectExpr("cast(i / 6 as int) AS f", "i", "kept"), ["f", "i"], "kept", n)
        assert sorted(r["i"] for r in got.collect()) == list(range(max(0, 3 * n - 2))), n


def test_empty_documents(spark):
    none = stream.placed(spark.createDataFrame([], "doc_id long, ids array<int>"))
    assert stream.token_stream(none).count() == stream.document_windows(none, 4).count() == stream.shifted_targets(none).count() == 0


def test_schedule_and_loss(spark):
    m = lambda t, w: [r[0] for r in spark.range(t + 1).select(preference.d2z_multiplier(F.col("id"), t, w)).collect()]
    assert m(4, 0) == [1.0, 0.75, 0.5, 0.25, 0.0] and m(100, 10)[:10] == [(i + 1) / 10 for i in range(10)]
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(Exception):
            m(*bad)
    rows = spark.createDataFrame([(-5.0, -6.0, -5.5, -5.0), (-3.0, -2.0, -3.0, -2.5)], "pc double, pr double, rc double, rr double")
    got = preference.dpo_loss(rows, 0.5).first()
    assert [round(r["margin"], 6) for r in preference.rewards(rows, 0.5).collect()] == [0.75, -0.25] and got["reward_accuracy"] == 0.5
    extreme = spark.createDataFrame([(-1e6, 0.0, 0.0, 0.0), (1e6, 0.0, 0.0, 0.0)], rows.schema)
    assert [r["loss"] for r in preference.rewards(extreme, 1.0).collect()] == [1e6, 0.0]
