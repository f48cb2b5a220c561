"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import held_out_column


def sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int) -> tuple[list[bytes], list[int]]:
    """Whole texts and labels of at most per_class documents of each label outside the held-out fold, the first in an order
    of their hashed ids. Of rows that repeat an id the least text counts."""
    marks = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out_column(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max(column).alias("label"))
    order = [F.xxhash64("doc_id", F.lit(3)), F.col("doc_id")]
    picked = [marks.where(F.col("label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    picked = F.broadcast(picked[0].union(picked[1]))  # at most 2 * per_class rows
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(picked, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found = rows.toArrow().sort_by([("doc_id", "ascending")])
    return found.column("text").cast(pa.binary()).to_pylist(), found.column("label").to_pylist()
