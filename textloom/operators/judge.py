"""Judge verdicts by way of a ledger: what has been asked once is never asked again.

The ledger is a folder of JSON lines (question, winner, reason), where `question` is the digest of (prompt, a, b). Distinct questions that it lacks
are asked on the executors, some at a time in each task, failed calls again after a pause. Answers are written as they come, a
file for every few of them, so those of a run that is killed, and of tasks that fail later, are kept; files appear whole or not at all.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CALLS, RETRIES, PAUSE, AT_ONCE = 8, 3, 0.5, 4
ANSWER = "question string, winner string, reason string"


def question(*values: Column | str) -> Column:
    """A digest of texts that tells null from empty and where one text ends."""
    texts = [F.col(v) if isinstance(v, str) else v for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def questions(pairs: DataFrame, key: str = "prompt_id") -> DataFrame:
    """(key, order_no, question, prompt, a, b): both orders of each pair (key, prompt, x, y)."""
    orders = F.array(F.struct(F.lit(1).alias("order_no"), F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.lit(2).alias("order_no"), F.col("y").alias("a"), F.col("x").alias("b")))
    both = pairs.select(key, "prompt", F.explode(orders).alias("o")).select(key, "prompt", "o.*")
    return both.select(key, "order_no", question("prompt", "a", "b").alias("question"), "prompt", "a", "b")


def answers(spark: SparkSession, ledger: str) -> DataFrame:
    """(question, winner, reason) of the ledger; one that isn't there is empty. Speculative tasks may have asked twice: the first answer counts."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ANSWER)
    rows = spark.read.schema(ANSWER).json(ledger).where("question IS NOT NULL").withColumn("file", F.col("_metadata.file_modification_time"))
    return rows.groupBy("question").agg(F.min_by(F.struct("winner", "reason"), F.struct("file", "winner", "reason")).alias("a")).select("question", "a.*")


def _asking(client, ledger: str, calls: int, retries: int, pause: float):
    def call(row):
        for attempt in range(retries + 1):
            try:
                winner, reason = client(row["prompt"], row["a"], row["b"]) or (None, None)
                return {"question": row["question"], "winner": winner, "reason": reason}
            except Exception:
                if attempt == retries:
                    raise
                time.sleep(pause * 2**attempt)

    def asking(batches):
        where, root = fs.FileSystem.from_uri(ledger)
        where.create_dir(root, recursive=True)
        n = 0
        with ThreadPoolExecutor(calls) as pool:
            for batch in batches:
                rows = batch.to_pylist()
                for at in range(0, len(rows), calls * AT_ONCE):
                    futures = [pool.submit(call, r) for r in rows[at : at + calls * AT_ONCE]]
                    failed = [f.exception() for f in futures if f.exception() is not None]
                    if done := [f.result() for f in futures if f.exception() is None]:
                        name = f"answers-{uuid.uuid4().hex}.json"
                        with where.open_output_stream(f"{root}/_{name}") as out:  # names with an underscore aren't read
                            out.write("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in done).encode())
                        where.move(f"{root}/_{name}", f"{root}/{name}")
                        n += len(done)
                    if failed:
                        raise failed[0]
        yield pa.RecordBatch.from_pydict({"n": [n]}, pa.schema([("n", pa.int64())]))

    return asking


def ask(pairs: DataFrame, client, ledger: str, key: str = "prompt_id", calls: int = CALLS, retries: int = RETRIES, pause: float = PAUSE) -> DataFrame:
    """(key, order_no, winner, reason) for pairs (key, prompt, x, y), from the ledger and, where it lacks an answer, from the client.

    client(prompt, a, b) returns (winner, reason), or None for a refusal, which is an answer without a winner. A call that fails `retries` times more
    raises; the answers until then stay. ledger: an address that Spark and pyarrow both reach.
    """
    spark = pairs.sparkSession
    both = questions(pairs, key)
    missing = both.select("question", "prompt", "a", "b").dropDuplicates(["question"]).join(answers(spark, ledger), "question", "left_anti")
    missing.mapInArrow(_asking(client, ledger, calls, retries, pause), "n long").agg(F.sum("n")).collect()
    return both.join(answers(spark, ledger), "question").select(key, "order_no", "winner", "reason")
