"""Helpers that several operators share: scratch tables, word rules, row keys."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.workers import ship

#: Words are maximal runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Bytes of an Arrow batch (one more row may follow).
BATCH_BYTES = 4 << 20

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and Spark runs in one process (tests) a temporary folder is made and set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(where)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted by cleared(), or when the driver ends."""
    path = f"{shared_dir(spark)}/corpusloom-{uuid.uuid4().hex}/{name}"
    _scratch.append((spark, path))
    return path


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it back: a cut of the lineage
    that outlives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """Where the scratch paths of what follows begin, for cleared()."""
    return len(_scratch)


def cleared(since: int = 0, *keep: DataFrame) -> None:
    """Delete the scratch tables that were made since a mark, but for those that one of keep reads. Results that are not written
    yet are lost with them."""
    kept = " ".join(f for df in keep for f in df.inputFiles())
    left = []
    for spark, path in _scratch[since:]:
        folder = path.rsplit("/", 1)[0]
        if folder.rsplit("/", 1)[1] in kept:
            left.append((spark, path))
            continue
        try:
            jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
            p = jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(sc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone: nothing can be deleted any more
            continue
    _scratch[since:] = left
    if keep:
        collected(keep[0].sparkSession)


def collected(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of what nobody holds any more when the driver collects its garbage, which a driver
    with memory to spare hardly ever does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    released()


atexit.register(cleared)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE, -1), "")


def held_out(doc_id: int | None) -> bool:
    """The fold that no model may learn labels from."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def held_out_column(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def released() -> None:
    """Give memory that is free back to the system: a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def ready_workers(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Python workers get this package, and whole texts in batches of so many bytes that long ones fit in memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > batch_bytes:  # a plan reads this when it runs: a lower bound that is set stays
        spark.conf.set(name, str(batch_bytes))
    ship(spark)
