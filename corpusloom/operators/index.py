"""Keeping pages and chunks current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.order import placed


def upserted(stored: DataFrame, new: DataFrame, key: str = "url", version: str = "updated_at") -> DataFrame:
    """One row for each key, the latest; of equal ones the new one."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    fields = [c for c in both.columns if c != key]
    order = F.struct(F.col(version), F.col("_new"))
    # an aggregate rather than a window: rows of a key meet combined, however many there are
    return both.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("_row")).select(key, "_row.*").drop("_new").select(*stored.columns)


def chunks_replaced(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the pages that new covers give way to the new ones."""
    return chunks.join(new.select("page_id").distinct(), "page_id", "left_anti").unionByName(new)


def without_source(pages: DataFrame, chunks: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Pages of a source go, and their chunks with them."""
    left = pages.where(~F.col("source").eqNullSafe(F.lit(source)))
    return left, chunks.join(left.select("page_id"), "page_id", "left_semi")


def cascaded(children: DataFrame, parents: DataFrame, key: str, gone: Column) -> DataFrame:
    """Children whose parent is not deleted."""
    return children.join(parents.where(gone).select(key), key, "left_anti")


def second_pass(found: DataFrame, first: DataFrame, most: int = 6000) -> DataFrame:
    """Addresses that the first pass did not fetch, in order, and how each is to be fetched."""
    new = found.select("url").distinct().join(first.select("url"), "url", "left_anti").orderBy("url").limit(most)
    return new.withColumn("fetch", F.when(F.col("url").rlike(r"(?i)prog[a-z]*\.") & ~F.col("url").rlike("(?i)program"), "http").otherwise("browser"))


def light_first(pages: DataFrame, heavy: str = "showpac") -> DataFrame:
    """A place in the queue for each address: heavy ones last, then by address."""
    keys = [F.contains(F.col("url"), F.lit(heavy)), F.col("url"), *[F.col(c) for c in ("page_id",) if c in pages.columns]]
    return placed(pages, *keys)


def incremental(pages: DataFrame, page_id: int | None = None, limit: int | None = None) -> DataFrame:
    rows = pages if page_id is None else pages.where(F.col("page_id") == page_id)
    return rows if limit is None else rows.orderBy("page_id").limit(limit)


def backfill(shells: DataFrame, stored: DataFrame, tabs: Column, force: bool = False) -> DataFrame:
    """shells: url; stored: url, content. Tab addresses of all shells that still lack a content, with their status."""
    wanted = shells.select(F.explode(tabs).alias("url")).distinct()
    have = stored.where(F.trim(F.coalesce("content", F.lit(""))) != "").select(F.col("url").alias("_have"))
    rows = wanted.join(have, wanted["url"] == have["_have"], "left")
    skip = F.lit(False) if force else F.col("_have").isNotNull()
    return rows.select("url", F.when(skip, "skipped").otherwise("to_fetch").alias("status"))


def job_counters(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def refresh(steps: list, before=None) -> list:
    """Run named steps one after the other; a failing one stops the chain. Names of those done."""
    done = []
    if before:
        before()
    for name, step in steps:
        step()
        done.append(name)
    return done


def bootstrap_if_empty(pages: DataFrame, fill) -> bool:
    """Run fill() where no page is stored yet; whether it ran."""
    if pages.isEmpty():
        fill()
        return True
    return False
