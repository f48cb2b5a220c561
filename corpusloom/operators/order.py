"""Places in a whole order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.scratch import ready_checkpoints


def placed(rows: DataFrame, *order: Column, to: str = "place") -> DataFrame:
    """rows with their place (from 1) in an order. They are sorted by ranges; each range's rows count from the sum of the
    ranges before it. Ranges are written out once, since another run might cut them elsewhere."""
    ready_checkpoints(rows.sparkSession)
    keyed = rows.select(F.struct("*").alias("row"), *[c.alias(f"k{i}") for i, c in enumerate(order)])
    keys = [f"k{i}" for i in range(len(order))]
    ranged = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = ranged.select("row", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")).checkpoint()
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy("range").agg(F.count("*").alias("c")).select("range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))  # one row for each task
    return ranged.join(F.broadcast(starts), "range").select("row.*", (F.col("start") + F.col("at") + 1).alias(to))
