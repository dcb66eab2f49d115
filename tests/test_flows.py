"""Verdicts by a ledger, pairs from a stream, and the three flows from files to files."""

import json
import os

import pytest

from textloom import flows
from textloom.operators import judge, tokenizer
from textloom.sources import corpus, tokenfile
from textloom.streaming import pairs as stream_pairs


class Client:
    """Notes every call in a folder; fails at calls for texts that are listed there."""

    def __init__(self, folder, fails=(), times=1):
        self.folder, self.fails, self.times = str(folder), set(fails), times
        os.makedirs(self.folder, exist_ok=True)

    def __call__(self, prompt, a, b):
        import uuid

        n = sum(json.load(open(f"{self.folder}/{f}")) == [prompt, a, b] for f in os.listdir(self.folder) if f.endswith(".json"))
        with open(f"{self.folder}/{uuid.uuid4().hex}.tmp", "w") as f:
            json.dump([prompt, a, b], f)
        os.rename(f.name, f.name.replace(".tmp", ".json"))
        if a in self.fails and n < self.times:
            raise RuntimeError("no answer")
        return None if prompt == "refuse" else ("A" if len(a) >= len(b) else "B", f"{len(a)}:{len(b)}")

    def calls(self):
        return sorted(tuple(json.load(open(f"{self.folder}/{f}"))) for f in os.listdir(self.folder))


def frame(spark, rows):
    return spark.createDataFrame(rows, "prompt_id long, prompt string, x string, y string")


def verdicts(df):
    return sorted((r["prompt_id"], r["order_no"], r["winner"], r["reason"]) for r in df.collect())


def test_no_question_is_asked_twice(spark, tmp_path):
    client, ledger = Client(tmp_path / "calls"), f"file://{tmp_path}/ledger"
    rows = [(i, "p", "x" * (i % 5), "y" * (i % 3)) for i in range(30)] + [(40, "refuse", "a", "bb"), (41, "p", "é\n\"", "")]
    want = [(i, o, *((None, None) if p == "refuse" else ("A" if len(a) >= len(b) else "B", f"{len(a)}:{len(b)}"))) for i, p, x, y in rows for o, a, b in ((1, x, y), (2, y, x))]
    assert verdicts(judge.ask(frame(spark, rows[:10]), client, ledger)) == sorted(want[:20])
    assert verdicts(judge.ask(frame(spark, rows), client, ledger)) == sorted(want)
    assert verdicts(judge.ask(frame(spark, rows), client, ledger)) == sorted(want)
    assert len(client.calls()) == len(set(client.calls())) == len({(p, a, b) for _, p, x, y in rows for a, b in ((x, y), (y, x))})
    assert judge.ask(frame(spark, []), client, ledger).count() == 0


def test_a_run_that_is_cut_off_goes_on_where_it_was(spark, tmp_path):
    client, ledger = Client(tmp_path / "calls", fails=["bad"], times=2), f"file://{tmp_path}/ledger"
    rows = [(i, "p", f"text {i}", "t") for i in range(40)] + [(99, "p", "bad", "t")]
    with pytest.raises(Exception, match="no answer"):
        judge.ask(frame(spark, rows).coalesce(1), client, ledger, retries=0)
    asked, kept = len(client.calls()), judge.answers(spark, ledger).count()
    assert 0 < kept == asked - 1  # all but the one that failed are kept
    with pytest.raises(Exception, match="no answer"):
        judge.ask(frame(spark, rows), client, ledger, retries=0)
    assert len(verdicts(judge.ask(frame(spark, rows), client, ledger, retries=0))) == 82
    calls = client.calls()
    assert len(set(calls)) == 82 and len(calls) == 84 and calls.count(("p", "bad", "t")) == 3  # only what had failed was asked again


def test_calls_are_tried_again(spark, tmp_path):
    client = Client(tmp_path / "calls", fails=["bad"], times=2)
    got = judge.ask(frame(spark, [(1, "p", "bad", "t")]), client, f"file://{tmp_path}/ledger", retries=2, pause=0.01)
    assert verdicts(got) == [(1, 1, "A", "3:1"), (1, 2, "B", "1:3")] and len(client.calls()) == 4


GOOD = "むかしサランはもりへいきました。そこでともだちにあいました。ふたりはうたをうたいました。"
PROMPTS = [(i, f"サラン{i}がいました。", [(0, GOOD + "サ" * (i % 4), True), (1, "だめ", True), (2, GOOD, i % 5 > 0), (3, GOOD, True)]) for i in range(12)] + [(50, "p", []), (51, "p", [(0, GOOD, True)])]


def candidates(spark, rows):
    return spark.createDataFrame(rows, stream_pairs.CANDIDATES)


def listed(spark, path):
    return sorted((r["prompt"], r["chosen"], r["rejected"], r["judge"], str(r["rule_scores"]), str(r["llm_reasons"])) for r in corpus.load_pairs(spark, path).collect())


@pytest.mark.parametrize("mode", ["rule", "llm", "both"])
def test_a_stream_that_is_stopped_writes_each_record_once(spark, tmp_path, mode):
    settings = {"mode": mode} | ({} if mode == "rule" else {"client": Client(tmp_path / "calls"), "ledger": f"file://{tmp_path}/ledger"})
    candidates(spark, PROMPTS).repartition(2).write.json(f"{tmp_path}/all")
    stats = flows.make_pairs(spark, f"{tmp_path}/all", f"{tmp_path}/batch", **settings)
    want = listed(spark, f"{tmp_path}/batch")
    assert len(want) == stats["kept"] > 0 and sum(stats.values()) >= 13
    for half in (PROMPTS[:5], PROMPTS[5:]):
        candidates(spark, half).repartition(3).write.mode("append").json(f"{tmp_path}/in")
        source = spark.readStream.schema(stream_pairs.CANDIDATES).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        stream_pairs.sink(source, f"{tmp_path}/out", f"{tmp_path}/check", **settings).awaitTermination()
        last = max(int(p.name) for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit())
        for name in (str(last), f".{last}.crc"):  # as if the run had been stopped before its last batch was committed
            (tmp_path / "check" / "commits" / name).unlink(missing_ok=True)
    source = spark.readStream.schema(stream_pairs.CANDIDATES).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    stream_pairs.sink(source, f"{tmp_path}/out", f"{tmp_path}/check", **settings).awaitTermination()
    assert listed(spark, f"{tmp_path}/out") == want
    if mode != "rule":
        calls = settings["client"].calls()
        assert len(calls) == len(set(calls)) > 0  # nor was any question asked twice


@pytest.mark.parametrize("driver_words", [500_000, 3])
def test_from_corpus_files_to_tokens(spark, tmp_path, driver_words):
    stories = ["むかしむかし、あるところに。", " つぎの はなし 12。 ", "An English story", ""]
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"text_ja": s}, ensure_ascii=False) + "\n" for s in stories), encoding="utf-8")
    (tmp_path / "b.txt").write_text("ひとつの\r\nほん\n", encoding="utf-8", newline="")
    paths = [str(tmp_path / "a.jsonl"), str(tmp_path / "b.txt")]
    assert flows.train_tokenizer(spark, paths, str(tmp_path / "tok"), 280, driver_words) == {"kept": 3, "dropped": 2, "vocab_size": 281}
    out = f"file://{tmp_path}/tokens"
    stats = flows.prepare_tokens(spark, str(tmp_path / "tok"), paths, out)
    merges, vocab = corpus.load_tokenizer(spark, str(tmp_path / "tok"))
    words = lambda t: [r["ids"] for r in tokenizer.encode(spark.createDataFrame([(0, t)], "doc_id long, text string"), merges, eot=True).collect()][0]
    want = [i for t in ("むかしむかし、あるところに。", "つぎの はなし 12。", "ひとつの\nほん\n") for i in words(t)]
    assert [r["token_id"] for r in tokenfile.load(spark, out).orderBy("pos").collect()] == want and stats == {"kept": 3, "dropped": 2, "num_tokens": len(want)}
    assert want.count(vocab[tokenizer.EOT]) == 3
    (tmp_path / "none.jsonl").write_text('{"text_ja": "only latin letters"}\n')
    with pytest.raises(ValueError, match="no documents"):
        flows.train_tokenizer(spark, [str(tmp_path / "none.jsonl")], str(tmp_path / "tok2"), 280)
