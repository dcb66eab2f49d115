"""Frames written to the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and the master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def own_dir(spark: SparkSession) -> str:
    """This application's folder inside the shared one; removed when the driver's process ends in the usual way."""
    path = f"{shared_dir(spark)}/textloom-{spark.sparkContext.applicationId}"
    if path not in _cleaned:
        _cleaned.add(path)

        def clean():
            if spark._jsc is not None and spark.sparkContext._jsc is not None:
                _delete(spark, path)

        atexit.register(clean)
    return path


def materialise(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage and survives lost executors. codec: zstd halves whole texts."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._textloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what `materialise` wrote for this frame, once nothing will read it again; other frames are left as they are."""
    if path := getattr(df, "_textloom_path", None):
        _delete(df.sparkSession, path)


def unused(name: str, *frames: DataFrame) -> str:
    """The name, with as many underscores in front as make it unlike all column names of the frames."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
