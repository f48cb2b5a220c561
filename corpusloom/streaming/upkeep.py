"""A chunk table that follows a stream of pages: only what changed is chunked and embedded again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges of pages that are written anew together: enough of them that a range is small beside the memory of a few tasks.
BUCKETS = 64
COLUMNS = ("url", "digest", "version", "chunk_index", "chunk")


def stored_rows(spark, path: str) -> DataFrame | None:
    """The table as it is: a row for each chunk, and one without a chunk for each page that has none. None before the first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def chunk_rows(spark, path: str) -> DataFrame:
    return stored_rows(spark, path).where("chunk is not null").drop("bucket")


def absorb(batch: DataFrame, path: str, split: Callable[[Column], Column], buckets: int = BUCKETS, files: int = 1) -> int:
    """batch: url, content, version. Replaces the chunks of pages whose content is another than the stored one, and returns how many
    pages these are. Of a page that comes more than once the greatest version counts (of equal ones the greater content); one that is older than the
    stored one counts for nothing. split makes an array of chunks of a content. A range is written by so many tasks as it has files.

    The table is partitioned by ranges of the address's hash: ranges without a changed page keep their files, others are written
    beside them and put in their place at the commit of the job, so that a write that fails leaves the old chunks. To absorb a batch
    again changes nothing, whatever became of the first time; so no batch number has to be kept."""
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int")
    newest = batch.where("url is not null").groupBy("url").agg(F.max(F.struct("version", F.coalesce("content", F.lit("")).alias("content"))).alias("p")).select("url", "p.version", "p.content")
    newest = newest.withColumn("digest", F.sha2("content", 256)).withColumn("bucket", bucket)
    newest = newest.persist()
    named = [r["bucket"] for r in newest.select("bucket").distinct().collect()]  # as many rows as ranges
    held = stored_rows(spark, path)
    changed = newest
    if held is not None:
        held = held.where(F.col("bucket").isin(*named))  # other ranges are not read
        known = held.groupBy("url").agg(F.first("digest").alias("_digest"), F.first("version").alias("_version"))
        changed = newest.join(known, "url", "left").where(F.col("_digest").isNull() | ((F.col("_digest") != F.col("digest")) & (F.col("version") >= F.col("_version")))).drop("_digest", "_version")
    try:
        touched = {r["bucket"]: r["n"] for r in changed.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        if not touched:
            return 0
        rows = changed.select("url", "digest", "version", F.posexplode_outer(split(F.col("content"))).alias("chunk_index", "chunk"), "bucket")
        if held is not None:
            kept = held.where(F.col("bucket").isin(*touched)).join(changed.select("url"), "url", "left_anti")
            rows = rows.unionByName(kept.select(*COLUMNS, "bucket"))
        rows.repartition("bucket", F.pmod(F.xxhash64("url", F.lit(1)), F.lit(files))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        return sum(touched.values())
    finally:
        newest.unpersist()


def followed(pages: DataFrame, path: str, checkpoint: str, split: Callable[[Column], Column], buckets: int = BUCKETS):
    """A streaming query over pages (url, content, version) that keeps the chunk table current; what is there is absorbed, then it ends."""
    writer = pages.writeStream.foreachBatch(lambda batch, _: absorb(batch, path, split, buckets) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
