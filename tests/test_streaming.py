from textloom.streaming import pretokens


def test_running_counts_follow_files(spark, tmp_path):
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "a b a")], schema).write.json(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    q = pretokens.running_counts(source).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    spark.createDataFrame([(2, "a")], schema).write.mode("append").json(str(tmp_path / "in"))
    q.processAllAvailable()
    got = {r["word"]: r["n"] for r in spark.table("counts").collect()}
    q.stop()
    assert got == {"a": 2, " b": 1, " a": 1}


def test_kept_once(spark, tmp_path):
    schema = "t timestamp, text string"
    spark.sql("SELECT timestamp'2024-01-01' AS t, explode(array('あ', 'あ ', 'い', 'English')) AS text").write.json(str(tmp_path / "in"))
    q = pretokens.kept_once(spark.readStream.schema(schema).json(str(tmp_path / "in")), "t").writeStream.format("memory").queryName("kept").start()
    q.processAllAvailable()
    got = sorted(r["text"] for r in spark.table("kept").collect())
    q.stop()
    assert got == ["あ", "い"]
