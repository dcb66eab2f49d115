import json

import pytest

from textloom.operators import stream, tokenizer
from textloom.sources import corpus, tokenfile


@pytest.fixture
def files(tmp_path):
    stories = ["むかしむかし。", "", "   ", "An English story", None, " つぎのはなし。 "]
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps({"text_ja": s, "n": 1}, ensure_ascii=False) for s in stories) + "\n\n\n", encoding="utf-8")
    (tmp_path / "a.txt").write_text("  whole file \r\nkept as it is", encoding="utf-8")
    (tmp_path / "c.md").write_text("not read")
    return tmp_path


def test_expand(spark, files):
    assert [p.rsplit("/", 1)[1] for p in corpus.expand_corpus_paths(spark, [str(files)])] == ["a.txt", "b.jsonl"]
    assert corpus.expand_corpus_paths(spark, [str(files / "c.md")])[0].endswith("c.md")
    with pytest.raises(FileNotFoundError):
        corpus.expand_corpus_paths(spark, [str(files / "none")])


def test_documents_in_order_and_counted(spark, files):
    docs = corpus.iter_documents(spark, [str(files)])
    got = docs.orderBy("file_idx", "line_no").collect()
    assert [r["text"] for r in got if r["kept"]] == ["  whole file \nkept as it is", "むかしむかし。", "つぎのはなし。"]
    assert corpus.corpus_stats(docs).first().asDict() == {"kept": 3, "dropped": 4}


def test_max_docs_stops_before_later_drops(spark, files):
    docs = corpus.iter_documents(spark, [str(files)], max_docs=2)
    assert corpus.corpus_stats(docs).first().asDict() == {"kept": 2, "dropped": 0}
    assert corpus.iter_documents(spark, [str(files)], max_docs=0).count() == 0


def test_line_numbers_across_splits(spark, tmp_path):
    (tmp_path / "x.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        got = corpus.read_lines(spark, str(tmp_path / "x.txt")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["line_no"]: r["value"] for r in got} == {i: f"line {i}" for i in range(5000)}


def test_many_files_are_one_scan(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"part {i}.jsonl").write_text("".join(json.dumps({"text_ja": f"はなし{i}の{k}"}, ensure_ascii=False) + "\n" for k in range(3)), encoding="utf-8")
    (tmp_path / "z.txt").write_text("")
    twice = str(tmp_path / "part 2.jsonl")
    docs = corpus.iter_documents(spark, [str(tmp_path), twice])
    got = docs.orderBy("file_idx", "line_no").collect()
    assert [r["text"] for r in got] == [f"はなし{i}の{k}" for i in range(6) for k in range(3)] + [""] + [f"はなし2の{k}" for k in range(3)]
    assert {r["file_idx"] for r in got} == set(range(8))
    assert docs._jdf.queryExecution().executedPlan().toString().count("FileScan text") <= 3  # whole files; lines and their numbers
    with pytest.raises(FileNotFoundError):
        corpus.iter_documents(spark, [str(tmp_path / "none")])


def test_openings_from_a_line_on(spark):
    lines = spark.createDataFrame([(0, "いちばんめのはなし。"), (1, "にばんめのはなしです。つづき"), (2, "短。"), (3, "さんばんめのはなし。"), (4, "よんばんめのはなし。")], "line_no long, text string")
    assert [r["opening"] for r in corpus.story_openings(lines, 2, skip=1).orderBy("line_no").collect()] == ["にばんめのはなしです。", "さんばんめのはなし。"]


def test_a_shared_folder_is_needed_off_local(spark, monkeypatch):
    from textloom.sources import shared

    class Elsewhere:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Elsewhere)
    written = shared.materialise(spark.range(3))
    path = written._textloom_path
    assert written.count() == 3 and shared.own_dir(spark) in path
    shared.discard(written)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    assert shared.unused("A", spark.range(1).toDF("a")) == "_A"


def test_bad_json_raises(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"text_ja": "a"}\n{broken\n')
    with pytest.raises(Exception):
        corpus.read_jsonl(spark, str(tmp_path / "x.jsonl")).collect()


def test_token_store(spark, tmp_path):
    docs = spark.createDataFrame([(0, "ab"), (1, ""), (2, "c")], "doc_id long, text string")
    s = stream.token_stream(stream.placed(tokenizer.encode(docs, [], eot=True)))
    corpus.write_tokens(s, str(tmp_path / "t"), 257)
    got = corpus.load_tokens(spark, str(tmp_path / "t")).orderBy("pos").collect()
    assert [r["token_id"] for r in got] == [97, 98, 256, 256, 99, 256]
    assert [r["pos"] for r in got] == list(range(6))
    assert corpus.dtype(65536) == "uint16" and corpus.dtype(65537) == "uint32"


def test_tokenizer_and_pairs_round_trip(spark, tmp_path):
    merges = [("a", "b"), ("ab", "c")]
    corpus.save_tokenizer(spark, merges, tokenizer.build_vocab(merges), str(tmp_path / "tok"))
    assert corpus.load_tokenizer(spark, str(tmp_path / "tok")) == (merges, tokenizer.build_vocab(merges))
    pairs = spark.createDataFrame([("p", "日本", "r", "rule")], "prompt string, chosen string, rejected string, judge string")
    corpus.append_pairs(pairs, str(tmp_path / "pairs"))
    corpus.append_pairs(pairs, str(tmp_path / "pairs"))
    assert [r["chosen"] for r in corpus.load_pairs(spark, str(tmp_path / "pairs")).collect()] == ["日本", "日本"]
    (tmp_path / "bad.jsonl").write_text('{"prompt": "p", "chosen": "c"}\n')
    with pytest.raises(Exception, match="rejected"):
        corpus.load_pairs(spark, str(tmp_path / "bad.jsonl")).collect()


@pytest.fixture
def flat(spark, tmp_path):
    ids = [i * 7 % 1000 for i in range(5000)]
    rows = [(a, ids[a : a + 37]) for a in range(0, 5000, 37)] + [(5000, [])]
    path = f"file://{tmp_path}/tokens"
    tokenfile.write(spark.createDataFrame(rows, "start long, ids array<int>").repartition(5), path, 1000, part_tokens=300)
    return path, ids


def scanned(spark, df):
    """Rows that the query's scans gave, by its metrics, and its result."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    out = df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs, n = store.executionsList(), 0
    for k in range(before, runs.size()):
        run = runs.apply(k).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if "Scan" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    n += int(values.apply(m.accumulatorId()).replace(",", ""))
    return n, out


def test_flat_token_file(spark, flat, tmp_path):
    path, ids = flat
    store = tokenfile.Store.open(path).check()
    assert store.dtype == "uint16" and store.num_tokens == 5000 and len(store.parts) > 5
    assert sum(p.stat().st_size for p in (tmp_path / "tokens").glob("part-*")) == 10_000
    rows = [(i, t) for i, t in enumerate(ids)]
    assert sorted(map(tuple, tokenfile.load(spark, path).collect())) == rows
    for df, a, b in (
        (tokenfile.load(spark, path, 700, 1100), 700, 1100), (tokenfile.load(spark, path, 4990), 4990, 5000), (tokenfile.load(spark, path, 10, 10), 10, 10),
        (tokenfile.load(spark, path).where("pos >= 290 AND pos < 310"), 290, 310), (tokenfile.load(spark, path).where("pos = 77"), 77, 78), (tokenfile.load(spark, path).where("pos > 4997"), 4998, 5000),
    ):
        n, got = scanned(spark, df)
        assert sorted(map(tuple, got)) == rows[a:b] and n == b - a  # the scan gave nothing else
    assert sorted(map(tuple, tokenfile.load(spark, path).where("pos IN (5, 8) AND token_id > 40").collect())) == [(8, 56)]


@pytest.mark.parametrize("seq_len", [1, 64, 299, 4999, 5000])
def test_windows_of_a_flat_file(spark, flat, seq_len):
    path, ids = flat
    want = [(w, ids[w * seq_len : (w + 1) * seq_len], ids[w * seq_len + 1 : (w + 1) * seq_len + 1]) for w in range(4999 // seq_len)]
    assert sorted(map(tuple, tokenfile.windows(spark, path, seq_len).collect())) == want
    assert sorted(map(tuple, tokenfile.windows(spark, path, seq_len, 3).collect())) == want[:3]
    assert "Exchange" not in tokenfile.windows(spark, path, seq_len)._jdf.queryExecution().executedPlan().toString()


def test_drawn_windows_open_only_their_parts(spark, flat, tmp_path):
    path, ids = flat
    starts = spark.createDataFrame([(0, 0, 4000), (0, 1, 4090), (1, 0, 4000)], "batch_id long, row int, start long")
    used = {p[2] for p in tokenfile.Store.open(path).parts if p[0] < 4111 and p[0] + p[1] > 4000}
    for part in (tmp_path / "tokens").glob("part-*"):
        if part.name not in used:
            part.unlink()
    got = sorted(map(tuple, tokenfile.drawn(starts, path, 20).collect()))
    assert got == sorted((b, r, ids[s : s + 20], ids[s + 1 : s + 21]) for b, r, s in ((0, 0, 4000), (0, 1, 4090), (1, 0, 4000)))
    with pytest.raises(ValueError, match="metadata"):
        tokenfile.load(spark, path)


def test_a_store_is_whole_or_not_there(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    frame = lambda rows: spark.createDataFrame(rows, "start long, ids array<int>")
    for rows, vocab in (([(0, [1, 2]), (3, [4])], 9), ([(0, [1, 2]), (1, [4])], 9), ([(0, [70_000])], 9), ([(0, [-1])], 9)):
        with pytest.raises(Exception):
            tokenfile.write(frame(rows), path, vocab)
        with pytest.raises(FileNotFoundError):
            tokenfile.Store.open(path)
    tokenfile.write(frame([(0, [70_000, 3])]), path, 100_000)
    assert [r["token_id"] for r in tokenfile.load(spark, path).orderBy("pos").collect()] == [70_000, 3] and tokenfile.Store.open(path).dtype == "uint32"
    tokenfile.write(frame([(0, [5])]), path, 9)  # in its place
    assert [tuple(r) for r in tokenfile.load(spark, path).collect()] == [(0, 5)] and len(list((tmp_path / "t").glob("part-*"))) == 1
    tokenfile.write(frame([]), path, 9)
    assert tokenfile.load(spark, path).count() == 0


def test_files_behind_the_last_kept_document_stay_closed(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"a{i}.jsonl").write_text('{"text_ja": "むかしむかし。"}\n{"text_ja": "latin only"}\n', encoding="utf-8")
    (tmp_path / "a3.jsonl").write_text("{broken\n")
    rows = corpus.iter_documents(spark, [str(tmp_path)], max_docs=3).collect()
    assert sorted((r["file_idx"], r["line_no"]) for r in rows) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
    with pytest.raises(Exception):
        corpus.iter_documents(spark, [str(tmp_path)], max_docs=4).collect()


def test_text_files_in_chunks(spark, tmp_path):
    texts = ["one\n\ntwo\n", "no end", "", "あ\r\nい\n"]
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.txt").write_bytes(t.encode())
    got = {}
    for r in sorted(corpus.read_chunks(spark, [str(tmp_path / f"{i}.txt") for i in range(4)]).collect()):
        got.setdefault(r["file_idx"], []).append(r["chunk"])
    assert {i: "".join(c) for i, c in got.items()} == {0: texts[0], 1: texts[1], 3: "あ\nい\n"}


def test_documents_of_a_token_file_are_read_where_they_begin(spark, tmp_path):
    texts = [[1, 2, 3], [], [4] * 50, [5], [], [6, 7] * 9, [8]]
    for last in (True, False):
        ids = [x for t in texts for x in [*t, 9]]
        ids = ids if last else ids[:-1]
        path = f"file://{tmp_path}/docs{last}"
        tokenfile.write(spark.createDataFrame([(0, ids)], "start long, ids array<int>"), path, 10)
        for span in (1, 4, 7, 1000):
            got = tokenfile.documents(spark, path, 9, span)
            assert sorted((r["doc_no"], r["ids"]) for r in got.collect()) == [(i, t) for i, t in enumerate(texts) if t], span
    assert "Exchange hash" not in got._jdf.queryExecution().toString()
