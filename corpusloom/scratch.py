"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: list[tuple[SparkSession, str]] = []


def ready_checkpoints(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, set for checkpoint(). Only where none is set and Spark runs in one process (tests)
    a temporary folder is made."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, for what several steps read but only one should work out. It is deleted when the driver
    ends."""
    spark = df.sparkSession
    path = f"{ready_checkpoints(spark).rstrip('/')}/corpusloom-{uuid.uuid4().hex}/{name}"
    _scratch.append((spark, path.rsplit("/", 1)[0]))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def cleared() -> None:
    for spark, folder in _scratch:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone: nothing can be deleted any more
            continue
    _scratch.clear()
