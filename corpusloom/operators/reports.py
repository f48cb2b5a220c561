"""Reports over pages, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import retrieval


def corpus_stats(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: pages, chunks, pages with chunks, chunks for each of these (0 without any)."""
    a = pages.agg(F.count("*").alias("pages"))
    b = chunks.agg(F.count("*").alias("chunks"), F.count_distinct("page_id").alias("covered"))
    per = F.when(F.col("covered") > 0, F.round(F.col("chunks") / F.col("covered"), 6)).otherwise(0.0)
    return a.join(b, F.lit(True)).withColumn("chunks_per_page", per)  # one row each


def index_audit(pages: DataFrame, chunks: DataFrame, needles: tuple[str, ...], sample: int = 500) -> DataFrame:
    """One row: counts, mean chunks of a page, mean length of the first chunks, pages with records, pages by needle."""
    counts = [F.count_if(F.contains(F.lower("url"), F.lit(n))).alias("url_" + "".join(c if c.isalnum() else "_" for c in n).strip("_")) for n in needles]
    a = pages.agg(F.count("*").alias("pages"), F.count("embedding_units").alias("pages_with_units"), *counts)
    b = chunks.groupBy("page_id").agg(F.count("*").alias("n")).agg(F.round(F.avg("n"), 6).alias("mean_chunks"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))
    c = chunks.orderBy("page_id", "chunk_index").limit(sample).agg(F.round(F.avg(F.length("content")), 6).alias("mean_chars"))
    return a.join(b, F.lit(True)).join(c, F.lit(True))  # one row each


def coverage(questions: DataFrame, chunks: DataFrame, top_n: int = 120) -> DataFrame:
    """questions: query_id, embedding; chunks: chunk_id, page_id, embedding. query_id, page_id, min_d of the nearest
    chunks of every question."""
    hits = retrieval.nearest(questions.withColumn("variant", F.lit(0)), chunks, top_n)
    return hits.join(chunks.select("chunk_id", "page_id"), "chunk_id").groupBy("query_id", "page_id").agg(F.round(F.min("d"), 5).alias("min_d"))


def coverage_by_page(found: DataFrame) -> DataFrame:
    return found.groupBy("page_id").agg(F.min("min_d").alias("min_d"), F.count("*").alias("questions"))


def never_hit(found: DataFrame, pages: DataFrame) -> DataFrame:
    return pages.select("page_id").distinct().join(found.select("page_id"), "page_id", "left_anti")


def coverage_report(found: DataFrame, pages: DataFrame, questions: DataFrame, top_n: int) -> DataFrame:
    """The report as rows of part, key and value, so that its lists may be as long as they get: top_n, question_count and
    page_count; one row for each page never in the top n; the least distance of each page; and for each question a JSON array of its
    pages and distances (top_n of them at most)."""
    row = lambda part, key, value: [F.lit(part).alias("part"), key.cast("string").alias("key"), value.cast("string").alias("value")]
    none = F.lit("")
    one = questions.sparkSession.range(1).select(*row("top_n", none, F.lit(top_n)))
    asked = questions.agg(F.count_distinct("query_id").alias("n")).select(*row("question_count", none, F.col("n")))
    held = pages.agg(F.count_distinct("page_id").alias("n")).select(*row("page_count", none, F.col("n")))
    never = never_hit(found, pages).select(*row("pages_never_in_top_n", F.col("page_id"), none))
    least = coverage_by_page(found).select(*row("min_cosine_distance_by_page", F.col("page_id"), F.col("min_d")))
    lists = found.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("page_id", "min_d")))).alias("value"))
    return one.union(asked).union(held).union(never).union(least).union(lists.select(*row("per_question", F.col("query_id"), F.col("value"))))


def scrape_coverage(pages: DataFrame, needles: tuple[str, ...], first: int = 5) -> DataFrame:
    """needle, pages, first addresses (sorted) of every needle, in one pass."""
    hits = pages.select("url", F.explode(F.array(*map(F.lit, needles))).alias("needle")).where(F.contains(F.lower("url"), "needle"))
    order = W.partitionBy("needle").orderBy("url")
    some = hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= first).groupBy("needle").agg(F.array_sort(F.collect_list("url")).alias("first_urls"))
    return hits.groupBy("needle").agg(F.count("*").alias("pages")).join(some, "needle")


def person_probe(chunks: DataFrame, name: str) -> DataFrame:
    """One row: chunks with the name as it is written (any case), and folded."""
    return chunks.agg(F.count_if(F.contains(F.lower("content"), F.lit(name.lower()))).alias("plain_hits"), F.count_if(text.contains_folded(F.col("content"), name)).alias("folded_hits"))


def rubric_means(scores: DataFrame) -> DataFrame:
    """scores: qid, mode, accuracy, format, claims. Means of every mode."""
    return scores.groupBy("mode").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 2).alias(c) for c in ("accuracy", "format", "claims")])


def evaluation_records(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """answers: qid, mode, answer. One record for each question with the answers of all modes."""
    by_mode = answers.groupBy("qid").pivot("mode", ["base", "base_prompted", "adapter"]).agg(F.first("answer"))
    renamed = by_mode.select("qid", *[F.col(m).alias(f"{m}_answer") for m in ("base", "base_prompted", "adapter")])
    return questions.join(renamed, "qid", "left")
