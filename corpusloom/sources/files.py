"""Files: question lists, JSON lines, reports, tables; and probes of the catalogue."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.order import placed


def questions(spark: SparkSession, path: str) -> DataFrame:
    """query_id (from 0, in order of the files' names and lines), question: one of each line, blank ones left out. A question list is
    read by file, so that its numbers do not depend on how files are split."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\r?\n").alias("lines"))
    lines = whole.select("file", F.posexplode("lines").alias("line", "value")).withColumn("question", F.trim("value")).where("question <> ''")
    return placed(lines, F.col("file"), F.col("line"), to="place").select((F.col("place") - 1).alias("query_id"), "question")


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """report: part, key, value; one JSON object for each row."""
    report.write.mode("overwrite").json(path)


def batches(rows: DataFrame, key: str, after: int, size: int) -> DataFrame:
    """The next rows in order of a key."""
    return rows.where(F.col(key) > after).orderBy(key).limit(size)


def has_function(spark: SparkSession, name: str) -> bool:
    return spark.catalog.functionExists(name)


def alive(spark: SparkSession) -> dict:
    """Whether a trivial query runs, and how long it takes."""
    began = time.monotonic()
    ok = spark.sql("select 1 as one").first()["one"] == 1
    return {"ok": ok, "latency_ms": round((time.monotonic() - began) * 1000, 1)}
