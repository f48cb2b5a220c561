"""Conversations: sessions, history, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.functions import rules, text

HISTORY, PRIOR, CONTEXT_MAX = 12, 2, 14_000
BODY_BYTES, MESSAGE_MAX = 32_768, 5000


def sessions_of(sessions: DataFrame, client: str, most: int = 100) -> DataFrame:
    return sessions.where(F.col("client_id") == client).orderBy(F.desc("updated_at"), "session_id").limit(most)


def with_messages(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with their messages in order; a session may have none."""
    lists = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("messages"))
    return sessions.join(lists, "session_id", "left").withColumn("messages", F.coalesce("messages", F.array().cast(lists.schema["messages"].dataType)))


def deleted(sessions: DataFrame, messages: DataFrame, session: str, client: str) -> tuple[DataFrame, DataFrame]:
    """A session of a client goes with its messages; another client's stays."""
    gone = (F.col("session_id") == session) & (F.col("client_id") == client)
    left = sessions.where(~gone)
    return left, messages.join(sessions.where(gone).select("session_id"), "session_id", "left_anti")


def prior_questions(turns: DataFrame, n: int = PRIOR) -> DataFrame:
    """turns: conv_id, turn, role, text. The current (last) user turn and the n user turns before it that are not blank."""
    order = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    users = turns.where((F.col("role") == "user") & (F.trim("text") != "")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= n + 1)
    said = F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.struct("turn", "text"))))
    return users.groupBy("conv_id").agg(F.max(F.when(F.col("n") == 1, F.col("text"))).alias("current"), F.transform(said, lambda s: s["text"]).alias("prior"))


def history(turns: DataFrame, n: int = HISTORY) -> DataFrame:
    """The last n turns, and which of them is the last of the user."""
    order = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = turns.withColumn("back", F.row_number().over(order)).where(F.col("back") <= n)
    last = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(W.partitionBy("conv_id"))
    return rows.withColumn("is_last_user", F.coalesce(F.col("turn") == last, F.lit(False))).drop("back")


def with_prompt(turns: DataFrame, prompts: DataFrame) -> DataFrame:
    """History with the last user turn replaced by its prompt (conv_id, prompt)."""
    rows = history(turns).join(prompts, "conv_id", "left")
    return rows.withColumn("text", F.when(F.col("is_last_user"), text.trimmed_last_turn(F.coalesce("prompt", "text"))).otherwise(text.trimmed(F.col("text")))).drop("prompt")


def guarded(requests: DataFrame) -> DataFrame:
    """requests: message, body. HTTP status a request gets before anything is done with it."""
    message = F.trim(F.coalesce("message", F.lit("")))
    status = F.when(F.octet_length("body") > BODY_BYTES, 413).when(message == "", 400).when(F.length(message) > MESSAGE_MAX, 400).otherwise(200)
    return requests.withColumn("status", status)


def wrapped(question: Column, context: Column, most: int = CONTEXT_MAX) -> Column:
    """Context and question between marks; a long context is cut so that the question stays, to 500 characters at least."""
    tail = F.concat(F.lit("\n===QUESTION===\n"), question, F.lit("\n===END_QUESTION==="))
    head = F.lit("===CONTEXT===\n")
    room = F.greatest(F.lit(500), F.lit(most) - F.length(tail) - F.length(head))
    return F.when(F.trim(context) == "", question).otherwise(F.concat(head, F.substring(context, F.lit(1), room), tail))


def system_prompt(question: Column, context: Column, base: str = "Answer from the context only.") -> Column:
    """The base instruction and what the question's intents add, in a fixed order."""
    # Instructions by intent.
    adds = (
        ("overview", "Give a structured overview."), ("department", "List every item that the context names."), ("roster", "Name the staff that the context names."),
        ("fee", "Quote amounts and years as they stand."), ("scholarship", "Tell discounts from fees."), ("requirements", "List every requirement."),
        ("undergraduate_only", "Leave out graduate admissions."), ("leadership", "Give offices and names."), ("location", "Give the full address."), ("curriculum", "Keep course codes and credits."),
    )
    empty = F.when(F.trim(context) == "", F.lit("Say that nothing was found."))
    return F.concat_ws("\n", F.lit(base), *[F.when(rules.intent(question, n), F.lit(line)) for n, line in adds], empty)


def visibility(question: Column, context: Column) -> Column:
    """What a reply tells about its retrieval."""
    turn = wrapped(question, context)
    return F.struct(F.substring(question, 1, 400).alias("rag_query_preview"), F.length(context).alias("context_chars_sent"), F.length(turn).alias("llm_user_turn_chars"), F.contains(turn, F.lit("===CONTEXT===")).alias("context_block_in_llm"))


def model_options(question: Column, context: Column) -> Column:
    """More room for long lists and long contexts."""
    long = rules.intent(question, "department") | rules.intent(question, "roster") | rules.intent(question, "overview") | (F.length(context) >= 4000)
    return F.struct(F.when(long, 900).otherwise(512).alias("num_predict"), F.when(long, 12_288).otherwise(8192).alias("num_ctx"))


def chat_turns(stored: DataFrame, asked: DataFrame, answered: DataFrame) -> DataFrame:
    """stored: session_id, turn, role, content; asked: session_id, content; answered: session_id, reply, ok. Both new turns
    of every answered question are added; of a failed one none is."""
    last = stored.groupBy("session_id").agg(F.max("turn").alias("last"))
    new = asked.join(answered.where("ok"), "session_id").join(last, "session_id", "left").withColumn("n", F.coalesce(F.col("last"), F.lit(-1)))
    user = new.select("session_id", (F.col("n") + 1).alias("turn"), F.lit("user").alias("role"), "content")
    reply = new.select("session_id", (F.col("n") + 2).alias("turn"), F.lit("assistant").alias("role"), text.sanitized_reply(F.col("reply")).alias("content"))
    return stored.unionByName(user).unionByName(reply)
