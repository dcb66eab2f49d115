from collections import Counter

import corpus_pipeline as P

from textloom.llm import mixing, quality_rules, sentencepiece_codec, toxicity
from textloom.llm.common import fold, read

from ..oracle import sql_rows
from .test_dedup import plain_classes
from .test_models import plain_noisy_or

SF = "/root/testdata/sf0.001"


def test_stages_of_messy_and_empty_documents(spark, messy, empty, tmp_path):
    labels = spark.createDataFrame([(6, 1, 0), (7, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for k, docs in enumerate((messy, empty)):
        for name, stage in P.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "tokens":
                assert out.columns == messy.columns
            out.write.parquet(str(tmp_path / f"{k}{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}{name}"))
        assert docs.count() == 0 if k else docs.count() > 0


def test_each_stage_equals_a_plain_version(spark, tmp_path):
    """Each stage on what its predecessor kept, against SQL, plain Python and the tokenizer's own library."""
    import sentencepiece

    docs, held = read(spark, SF, "documents"), {}
    for name, stage in [("documents", lambda *_: docs), *P.STAGES]:
        (tmp_path / name).mkdir()
        stage(spark, docs, SF).write.parquet(str(tmp_path / name / "documents.parquet"))
        docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        held[name] = docs.toPandas()

    def sql(name, query):
        folder = tmp_path / f"{name}_sql"
        folder.mkdir()
        held[name].to_parquet(folder / "documents.parquet")
        return sql_rows(query, str(folder))

    ruled = sql("documents", quality_rules.ORACLE).set_index("doc_id")
    got = held["quality_rules"].set_index("doc_id")["text"]
    assert set(got.index) == set(ruled.index[ruled["kept"]])
    assert all(len(t.encode().split()) == ruled.loc[i, "n_words"] - ruled.loc[i, "n_removed_words"] for i, t in got.items())

    model = toxicity.fit(spark.read.parquet(str(tmp_path / "quality_rules" / "documents.parquet")), read(spark, SF, "labels"), fold("doc_id", 5) != 0)
    rows = held["quality_rules"]
    assert set(held["toxicity"]["doc_id"]) == {i for i, t in zip(rows["doc_id"], rows["text"]) if plain_noisy_or(model, t)[0] < 0.5}

    rows = held["toxicity"]
    classes = plain_classes(list(zip(rows["doc_id"].tolist(), rows["text"])))
    assert sorted(held["near_dedup"]["doc_id"]) == sorted(set(classes.values()))

    taken = sql("near_dedup", mixing.ORACLE).set_index("doc_id")
    assert Counter(held["mixing"]["doc_id"]) == {i: n for i, n in (taken["taken"] // taken["size"].clip(lower=1)).items() if n}

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    texts = held["mixing"].drop_duplicates("doc_id").set_index("doc_id")["text"]
    assert len(held["tokens"]) == len(held["mixing"])
    assert all(list(ids) == library.encode(texts[i]) for i, ids in zip(held["tokens"]["doc_id"], held["tokens"]["ids"]))


def test_run_over_a_table(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.where("NOT round_trip").count() == 0
    assert [n for n, _ in P.STAGES] == ["quality_rules", "toxicity", "near_dedup", "mixing", "tokens"] and P.ORACLE_SQL is None


def test_workers_give_back_what_other_stages_left(spark, sf):
    """An encoder's table of pairs grows with what it holds, other operators' tasks drop the encoder, and batches are small."""
    vocabulary = sentencepiece_codec.Vocabulary.load()
    encoder = sentencepiece_codec.encoder_of(vocabulary)
    encoder.encode(["a few words, and a few more words"])
    assert encoder._pairs._keys.nbytes < 1 << 20
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    try:
        cleaned = P.STAGES[0][1](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
        assert cleaned.count() and int(spark.conf.get(key)) <= 1024
        spark.conf.set(key, 7)
        P.STAGES[4][1](spark, cleaned, sf)
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.unset(key)

    def left(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(sentencepiece_codec._ENCODERS)])], names=["n"])

    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").coalesce(1)
    sentencepiece_codec.encode(documents).count()
    quality_rules.measure(documents).collect()
    assert {r["n"] for r in documents.mapInArrow(left, "n long").collect()} == {0}
