"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source the documents are taken in key order
until the source's budget of words is spent; a source whose budget exceeds its size is repeated
for whole epochs first. The sort is a range sort on the key: its leading bits are the range, so
ranges are even without sampling. Sums per (source, range) are added up to prefix sums, which
name the range that holds the cut; only that range is then sorted. What is left for each source
is one cut point, and every document compares itself with it, so texts are never shuffled.

Defined results: a null text has size 0; a null source is a source of its own, last in order;
a null id is ordered before all others; repeated rows (same id, same size) share a cut evenly;
an empty table gives an empty result; further columns are carried along by mixed_copies() and
ignored by mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import n_words, stored, text_of

WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
MOST_EPOCHS = 3
#: Leading bits of the 60-bit key that name a range.
RANGE_BITS = 12
#: A plan with at most this many sources is broadcast (under 30 MB); a longer one is joined by shuffle.
BROADCAST_SOURCES = 100_000


def source_key(source: Column) -> Column:
    """Orders sources by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def random_key(doc_id: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _measured(docs: DataFrame, seed: str) -> DataFrame:
    """The row itself stands in a struct, so that no column of it can clash with others."""
    lowest = F.lit(-(2**63)).cast("long")
    return docs.select(
        F.struct(*docs.columns).alias("_row"),
        source_key(F.col("source")).alias("_source"),
        F.coalesce(F.col("doc_id").cast("long"), lowest).alias("_id"),
        n_words(text_of()).alias("_size"),
        random_key(F.col("doc_id"), seed).alias("_key"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes: _source, source_size. Adds weight and target.

    Water filling in closed form: sources reach their cap in the order of cap / weight. The
    level is what the sources below their cap get for each unit of weight.
    """
    everything = W.orderBy("_source")
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(everything) - 1) % n + 1)
    cap = F.lit(MOST_EPOCHS) * F.col("source_size")
    by_fill = W.orderBy("_full_at", "_source")
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, W.unboundedFollowing)
    filled = (
        sizes.withColumn("weight", weight)
        .withColumn("_cap", cap)
        .withColumn("_full_at", F.col("_cap") / F.col("weight"))
        .withColumn("_total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_full_at"), F.col("_level"))).over(W.partitionBy()))
    )
    target = F.when(F.col("_full_at") <= F.col("_level"), F.col("_cap").cast("double")).otherwise(F.col("weight") * F.col("_level"))
    return filled.select("_source", "source_size", "weight", target.alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """One row for each source: size, target, whole epochs, and the point where the last one is cut."""
    rows = stored(_measured(docs, seed).drop("_row"), "mix-sizes")
    ranged = rows.withColumn("_range", F.shiftright("_key", 60 - RANGE_BITS))
    sums = ranged.groupBy("_source", "_range").agg(F.sum("_size").alias("_sum"))
    aims = (
        targets(sums.groupBy("_source").agg(F.sum("_sum").alias("source_size")), weights)
        .withColumn("_budget", F.floor("target"))
        .withColumn("_epochs", F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(0))
        .withColumn("_rest", F.col("_budget") - F.col("_epochs") * F.col("source_size"))
    )
    up_to = W.partitionBy("_source").orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)
    cut_range = (
        sums.withColumn("_start", F.sum("_sum").over(up_to) - F.col("_sum"))
        .join(aims.select("_source", "_rest"), "_source")
        .where((F.col("_rest") > F.col("_start")) & (F.col("_rest") <= F.col("_start") + F.col("_sum")))
        .select("_source", "_range", "_start", "_rest")
    )
    order = W.partitionBy("_source", "_range").orderBy("_key", "_id", "_size").rowsBetween(W.unboundedPreceding, W.currentRow)
    same = W.partitionBy("_source", "_range", "_key", "_id", "_size")
    cut = (
        ranged.join(cut_range, ["_source", "_range"])
        .groupBy("_source", "_range", "_start", "_rest", "_key", "_id", "_size")
        .agg(F.count("*").alias("_copies"))
        .withColumn("_sizes", F.col("_size") * F.col("_copies"))
        .withColumn("_before", F.col("_start") + F.sum("_sizes").over(order) - F.col("_sizes"))
        .where((F.col("_rest") > F.col("_before")) & (F.col("_rest") <= F.col("_before") + F.col("_sizes")))
        .select("_source", F.col("_key").alias("_cut_key"), F.col("_id").alias("_cut_id"), F.col("_size").alias("_cut_size"), F.expr("(_rest - _before) div _copies").alias("_cut_words"))
    )
    return aims.join(cut, "_source", "left").withColumnRenamed("_source", "_plan_source")


def _taken(docs: DataFrame, weights: tuple[int, ...], seed: str) -> DataFrame:
    sources = stored(plan(docs, weights, seed), "mix-plan")
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    key, one, size = F.struct("_key", "_id", "_size"), F.struct("_cut_key", "_cut_id", "_cut_size"), F.col("_size")
    last = F.when(F.col("_cut_key").isNull(), 0).when(key < one, size).when(key == one, F.col("_cut_words")).otherwise(0)
    rows = _measured(docs, seed)
    return rows.join(sources, rows["_source"] == sources["_plan_source"]).withColumn("_last", last.cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) for each row of docs."""
    return _taken(docs, weights, seed).select(
        "_row.doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_epochs") * F.col("_size") + F.col("_last")).cast("long").alias("taken")
    )


def mixed_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """The mix itself, with the columns of docs: each document once for each epoch that takes it,
    and for the one at a source's cut a last copy that ends with the last word taken."""
    old = lambda c: F.col("_row").getField(c)
    word_ends = F.split(old("text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    cut = (F.col("_copy") == F.col("_epochs")) & (F.col("_last") < F.col("_size"))
    rows = (
        _taken(docs, weights, seed)
        .withColumn("_copies", (F.col("_epochs") + F.when(F.col("_last") > 0, 1).otherwise(0)).cast("int"))
        .where("_copies > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
        .withColumn("_text", F.when(cut, F.array_join(F.slice(word_ends, 1, F.col("_last").cast("int")), "")).otherwise(old("text")))
    )
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("_text")).otherwise(old("n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, old(c)).alias(c) for c in docs.columns])
