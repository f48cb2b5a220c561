"""What the query modules share: tables, fixed questions, SQL pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text

#: Questions that the queries over rules and intents run on.
QUESTIONS = (
    (1, "Who are the teachers of computer engineering?"),
    (2, "How much is the tuition fee for medicine?"),
    (3, "Where is the campus? address please"),
    (4, "international students application requirements"),
    (5, "Can foreign students apply and what documents do they need?"),
    (6, "What is the ECTS of web programming in the 4th semester?"),
    (7, "bilgisayar mühendisliği ders programı 3. dönem"),
    (8, "list of all fees and scholarships"),
    (9, "Who is the dean of health sciences?"),
    (10, "hello there"),
    (11, "what is the weather forecast"),
    (12, "Tell me everything about electrical engineering"),
    (13, "phd admission for international applicants"),
    (14, "Merhaba"),
    (15, "İletişim ve ulaşım bilgileri nerede?"),
    (16, None),
)


#: More of them, for questions that are said in conversations.
MORE_QUESTIONS = (
    "compare both tracks of computer programming", "first year courses of civil engineering", "who is Jane Doe?", "head of the department of software", "annual payment for the mba", "what courses does the medical school offer",
    "thanks a lot", "who is elon?", "burs ve ücret listesi", "summary of the mechanical program",
)
SAID = tuple(q or "" for _, q in QUESTIONS) + MORE_QUESTIONS


def registry() -> tuple[dict, Callable]:
    found: dict[str, tuple[Callable, str | None]] = {}

    def query(sql: str | None = None) -> Callable:
        def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
            found[run.__name__] = (run, sql)
            return run

        return add

    return found, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, q) for i, q in QUESTIONS], "query_id long, question string")


def questions_sql() -> str:
    rows = ", ".join(f"({i}, " + ("null" if q is None else "'" + q.replace("'", "''") + "'") + ")" for i, q in QUESTIONS)
    return f"questions as (select i::bigint as query_id, q as question from (values {rows}) v(i, q))"


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users say in conversations, with one of the questions in front; every third turn is the question alone."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    n = F.col("conv_id") * 5 + F.col("turn")
    phrase = F.get(F.array(*map(F.lit, SAID)), (n % len(SAID)).cast("int"))
    return c.select("conv_id", "turn", F.when(n % 3 == 0, phrase).otherwise(F.concat(phrase, F.lit(" "), F.coalesce("text", F.lit("")))).alias("question"))


_SAID_VALUES = ", ".join("'" + q.replace("'", "''") + "'" for q in SAID)
#: The same: k is the number of the question (from 0), alone whether nothing follows it, low the folded text, padded its words.
SAID_SQL = rf"""spoken as (select conv_id, turn, (conv_id * 5 + turn) % {len(SAID)} as k, (conv_id * 5 + turn) % 3 = 0 as alone,
  ([{_SAID_VALUES}])[(conv_id * 5 + turn) % {len(SAID)} + 1] || case when (conv_id * 5 + turn) % 3 = 0 then '' else ' ' || coalesce(text, '') end as question from conversations where role = 'user'),
said as (select *, lower(translate(question, '{text.FOLD_FROM}', '{text.FOLD_TO}')) as low, ' ' || regexp_replace(lower(translate(question, '{text.FOLD_FROM}', '{text.FOLD_TO}')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g') || ' ' as padded from spoken)"""


def fold_sql(x: str) -> str:
    return f"lower(translate({x}, '{text.FOLD_FROM}', '{text.FOLD_TO}'))"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: chunk_id, page_id, content, source_url, page_title."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("chunk_id"), F.expr("doc_id div 4").alias("page_id"), F.coalesce("text", F.lit("")).alias("content"),
        F.concat(F.lit("https://example.edu/"), "lang", F.lit("/"), "source", F.when(F.col("doc_id") % 7 == 0, "/news/").otherwise("/page/"), "doc_id").alias("source_url"),
        F.substring(F.coalesce("text", F.lit("")), 1, 60).alias("page_title"),
    )


CHUNKS_SQL = """chunks as (
  select doc_id as chunk_id, doc_id // 4 as page_id, coalesce(text, '') as content,
    'https://example.edu/' || lang || '/' || source || case when doc_id % 7 = 0 then '/news/' else '/page/' end || doc_id as source_url,
    coalesce(text, '')[1:60] as page_title from documents)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


ASKED_SQL = "asked as (select item_id as query_id, text as question from benchmark)"


def words_sql(x: str, n: int = 4) -> str:
    return f"regexp_extract_all(lower(replace({x}, 'İ', 'i')), '[a-zğüşıöç]{{{n},}}')"


def distinct_sql(x: str) -> str:
    return f"list_distinct({x})"
