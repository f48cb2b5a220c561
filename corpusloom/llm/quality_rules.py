"""Quality rules: per-document base rules, then cross-document line frequency.

Normalised lines are hashed, and for each host (the source of a document) the distinct documents
that hold a line are counted; on request (count_by="texts") the distinct texts, so that exact copies count once and do not
condemn each other where duplicates have not been removed yet. Lines above the host's limit
are removed; a document that keeps too few of its words is depleted and rejected.

Built from DataFrame functions only. The text is read once: the measures and the line hashes of
every row go to a table in the shared folder, and only hashes are shuffled after that. The join
with the frequent lines is a plain equi-join of two shuffled sides, which adaptive execution
splits where one line holds a large part of the rows.

Defined results: a null text is an empty one (no words: base_failed); a null host is a host of its
own; repeated rows are judged alike, all returned, and are one document; rows without an id are judged like any others,
equal ones as repeated rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACE, WORD, stored, text_of, words_of

SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: A line is frequent in a host if more of its documents (or texts) hold it than both.
LINE_MIN_DOCS, LINE_MAX_SHARE = 20, 0.05
#: A document is depleted if fewer words or a smaller share of them is left.
LEFT_WORDS, LEFT_SHARE = 10, 0.2


def normalised_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def _windows(words: Column, n: int) -> Column:
    """Hashes of all windows of n words."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, n)]))


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, digest, the measures of the base rules and _lines (hash and number of words of each)."""
    words, hashes, at = F.col("_words"), F.col("_hashes"), F.col("_at")
    rows = (
        docs.select("doc_id", F.col(host).alias("host"), text_of().alias("_text"))
        .withColumn("_words", words_of(F.col("_text")))
        .withColumn("_hashes", _windows(words, WINDOW))
        .withColumn("_hashes", F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), hashes).otherwise(F.array().cast("array<bigint>")))
        .withColumn("_sorted", F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    )
    sorted_ = F.col("_sorted")
    again = F.transform(
        sorted_,
        lambda x, k: F.when((F.get(sorted_, k - 1)["h"] == x["h"]) | (F.get(sorted_, k + 1)["h"] == x["h"]), x["i"]),
    )
    rows = rows.withColumn("_at", F.sort_array(F.array_compact(again))).withColumn(
        "_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD))
    )
    covered = F.aggregate(
        F.transform(at, lambda x, k: F.coalesce(F.least(F.lit(WINDOW), F.get(at, k + 1) - x), F.lit(WINDOW))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    normal = F.transform("_lines", lambda x: normalised_line(x))
    return rows.withColumn("_normal", normal).select(
        "doc_id",
        "host",
        F.xxhash64("_text").alias("digest"),
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.transform("_normal", lambda x: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1).alias("words"))).alias("_lines"),
    )


def frequent_lines(lines: DataFrame, docs: DataFrame, min_docs: int = LINE_MIN_DOCS, max_share: float = LINE_MAX_SHARE) -> DataFrame:
    """lines: host, unit, line; docs: host, unit (what is counted). The lines of each host that too many of its units hold."""
    limits = docs.groupBy("host").agg(F.greatest(F.lit(float(min_docs)), max_share * F.count_distinct("unit")).alias("limit"))
    counts = lines.groupBy("host", "line").agg(F.count_distinct("unit").alias("docs")).where(F.col("docs") > min_docs)
    limits = limits.withColumnRenamed("host", "limit_host")
    return counts.join(limits, counts["host"].eqNullSafe(limits["limit_host"])).where("docs > limit").select("host", "line", "docs")


def judge(docs: DataFrame, host: str = "source", min_docs: int = LINE_MIN_DOCS, max_share: float = LINE_MAX_SHARE, count_by: str = "documents") -> DataFrame:
    """The measures, words_left (after frequent lines are removed), base_failed and kept of each row."""
    units = {"documents": F.xxhash64("doc_id", "digest"), "texts": F.col("digest")}
    rows = stored(measured(docs, host), "quality-measures").withColumn("host_key", F.coalesce(F.concat(F.lit("h"), "host"), F.lit("n")))
    lines = rows.select("doc_id", "host_key", "digest", F.explode("_lines").alias("x")).select("doc_id", F.col("host_key").alias("host"), "digest", "x.line", "x.words")
    counted = lines.select("host", units[count_by].alias("unit"), "line")
    frequent = frequent_lines(counted, rows.select(F.col("host_key").alias("host"), units[count_by].alias("unit")), min_docs, max_share).select("host", "line")
    found = lines.join(frequent, ["host", "line"]).groupBy("doc_id", "host", "digest").agg(F.sum("words").alias("all_words"))
    removed = found.select(F.col("doc_id").alias("_id"), F.col("host").alias("_host"), F.col("digest").alias("_digest"), "all_words")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("host_key") == F.col("_host")) & (F.col("digest") == F.col("_digest"))
    copies = rows.groupBy("doc_id", "host_key", "digest").agg(F.count("*").alias("copies"))
    removed = copies.join(removed, same).select("_id", "_host", "_digest", F.expr("all_words div copies").alias("removed"))
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = F.coalesce(F.col("removed") > 0, F.lit(False)) & ((F.col("words_left") < LEFT_WORDS) | (F.col("words_left") < LEFT_SHARE * F.col("n_words")))
    return (
        rows.join(removed, same, "left")
        .withColumn("words_left", left)
        .withColumn("base_failed", base_failed)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "words_left", "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"))
    )
