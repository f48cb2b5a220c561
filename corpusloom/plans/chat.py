"""Queries of conversations and request streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.operators import chat
from corpusloom.streaming import limiter
from corpusloom.plans.common import registry, said, table
from corpusloom.scratch import ready_checkpoints

QUERIES, query = registry()


def _sessions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy(F.col("conv_id").alias("session_id")).agg((F.max("turn") * 10 + F.col("session_id") % 7).alias("updated_at")).withColumn("client_id", F.concat(F.lit("c"), F.col("session_id") % 5))


_SESSIONS = "sessions as (select conv_id as session_id, max(turn) * 10 + conv_id % 7 as updated_at, 'c' || (conv_id % 5) as client_id from conversations group by conv_id)"


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


@query(f"with {_SESSIONS} select session_id, updated_at, client_id from sessions where client_id = 'c1' order by updated_at desc, session_id limit 100")
def sessions_of_client(spark, sf_dir):
    return chat.sessions_of(_sessions(spark, sf_dir), "c1")


@query("select conv_id as session_id, count(*) as n, md5(string_agg(role || ':' || text, chr(10) order by turn)) as transcript from conversations group by conv_id")
def session_transcripts(spark, sf_dir):
    rows = chat.with_messages(_sessions(spark, sf_dir), _messages(spark, sf_dir))
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return rows.select("session_id", F.size("messages").cast("long").alias("n"), F.md5(F.array_join(lines, "\n").cast("binary")).alias("transcript"))


@query("select conv_id as session_id, turn, role from conversations where conv_id <> 1")
def delete_session(spark, sf_dir):
    return chat.deleted(_sessions(spark, sf_dir), _messages(spark, sf_dir), "1", "c1")[1].select("session_id", "turn", "role")


@query("""with u as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn desc) as n from conversations where role = 'user' and trim(text) <> '')
select conv_id, max(text) filter (n = 1) as current, coalesce(string_agg(text, chr(10) order by turn) filter (n between 2 and 3), '') as prior from u group by conv_id""")
def prior_questions(spark, sf_dir):
    return chat.prior_questions(table(spark, sf_dir, "conversations")).select("conv_id", "current", F.array_join("prior", "\n").alias("prior"))


@query("""with c as (select *, row_number() over (partition by conv_id order by turn desc) as back, max(turn) filter (role = 'user') over (partition by conv_id) as last from conversations)
select conv_id, turn, role, coalesce(turn = last, false) as is_last_user from c where back <= 4""")
def last_turns(spark, sf_dir):
    return chat.history(table(spark, sf_dir, "conversations"), 4).select("conv_id", "turn", "role", "is_last_user")


@query("""with c as (select *, row_number() over (partition by conv_id order by turn desc) as back, max(turn) filter (role = 'user') over (partition by conv_id) as last from conversations)
select conv_id, turn, case when turn = last then 'PROMPT ' || conv_id else case when length(trim(text)) <= 900 then trim(text) else trim(text)[1:899] || '…' end end as text from c where back <= 12""")
def replaced_prompt(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    prompts = turns.select("conv_id").distinct().withColumn("prompt", F.concat(F.lit("PROMPT "), "conv_id"))
    return chat.with_prompt(turns, prompts).select("conv_id", "turn", "text")


@query("select doc_id, case when octet_length(encode(text)) > 32768 then 413 when trim(text) = '' then 400 when length(trim(text)) > 5000 then 400 else 200 end::bigint as status from documents")
def request_guards(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("message"), F.col("text").alias("body"))
    return chat.guarded(d).select("doc_id", F.col("status").cast("long").alias("status"))


@query("""with w as (select item_id, text as q, chr(10) || '===QUESTION===' || chr(10) || text || chr(10) || '===END_QUESTION===' as tail, repeat(text || ' ', 30) as c from benchmark)
select item_id, case when trim(c) = '' then q else '===CONTEXT===' || chr(10) || c[1:greatest(500, 2000 - length(tail) - 14)] || tail end as prompt from w""")
def wrapped_context(spark, sf_dir):
    q = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", chat.wrapped(q, F.repeat(F.concat(q, F.lit(" ")), 30), 2000).alias("prompt"))


@query()
def prompts_and_options(spark, sf_dir):
    q, c = F.col("question"), F.repeat(F.lit("fact "), 900)
    o, v = chat.model_options(q, c), chat.visibility(q, c)
    return said(spark, sf_dir).select("conv_id", "turn", chat.system_prompt(q, c).alias("system"), o["num_predict"].cast("long").alias("num_predict"), o["num_ctx"].cast("long").alias("num_ctx"), v["llm_user_turn_chars"].cast("long").alias("turn_chars"))


@query(r"""select item_id, regexp_replace(regexp_replace(regexp_replace('Based on the website, ' || ltrim(text, ', ') || repeat(chr(10), 4), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\s+$', '') as reply from benchmark""")
def sanitized_replies(spark, sf_dir):
    from corpusloom.functions import text

    raw = F.concat(F.lit("According to ===CONTEXT===,  "), F.col("text"), F.lit("\n\n\n\n===END_QUESTION==="))
    return table(spark, sf_dir, "benchmark").select("item_id", text.sanitized_reply(raw).alias("reply"))


@query("""select conv_id as session_id, turn, role from conversations union all
  select conv_id, max(turn) + 1, 'user' from conversations where conv_id % 2 = 0 group by conv_id union all select conv_id, max(turn) + 2, 'assistant' from conversations where conv_id % 2 = 0 group by conv_id""")
def appended_turns(spark, sf_dir):
    m = _messages(spark, sf_dir)
    ids = m.select("session_id").distinct()
    asked = ids.select("session_id", F.lit("and then?").alias("content"))
    answered = ids.select("session_id", F.lit("so.").alias("reply"), (F.col("session_id") % 2 == 0).alias("ok"))
    return chat.chat_turns(m, asked, answered).select("session_id", "turn", "role")


@query("select event_id, user_id, count(*) over (partition by user_id order by epoch_us(ts) range between 3600000000 preceding and current row) as recent from events")
def trailing_requests(spark, sf_dir):
    return limiter.trailing_count(table(spark, sf_dir, "events"), 3600)


@query("""with recursive e as (select user_id, event_id, epoch_us(ts) as at, row_number() over (partition by user_id order by ts, event_id) as n from events),
f(user_id, n, event_id, allowed, times) as (
  select distinct user_id, 0::bigint, -1::bigint, true, []::bigint[] from e
  union all
  select e.user_id, e.n, e.event_id, len(k) < 3, case when len(k) < 3 then list_append(k, e.at) else k end
  from f join e on e.user_id = f.user_id and e.n = f.n + 1, lateral (select list_filter(f.times, lambda t: t > e.at - 86400000000) as k))
select user_id, event_id, allowed from f where n > 0""")
def rate_limited_stream(spark, sf_dir):
    root = f"{ready_checkpoints(spark).rstrip('/')}/limiter-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    stream = limiter.requests_of(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"))
    found = limiter.run_to_table(spark, limiter.limited(stream, limit=3, seconds=86_400), root)
    return found.select("user_id", "event_id", "allowed")


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def windowed_counts(spark, sf_dir):
    found = limiter.windowed_counts(table(spark, sf_dir, "events"))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("select conv_id as reply_id, string_agg(text, '' order by turn) as reply from conversations group by conv_id")
def folded_replies(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    line = F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("message")))
    bodies = c.groupBy(F.col("conv_id").alias("reply_id")).agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("ls"))
    return limiter.folded_replies(bodies.select("reply_id", F.concat(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("\nnot json")).alias("body")))


@query("""with t as (select event_id, case when user_id % 3 = 0 then '10.0.' else '9.8.' end || user_id % 256 || '.' || event_id % 256 as peer, case event_id % 4 when 0 then null when 1 then ' 8.8.' || event_id % 9 || '.8 , 1.1.1.1' when 2 then '' else '7.7.7.' || event_id % 7 end as forwarded from events)
select event_id, case when starts_with(peer, '10.0.') and event_id % 4 = 1 then '8.8.' || event_id % 9 || '.8' when starts_with(peer, '10.0.') and event_id % 4 = 3 then '7.7.7.' || event_id % 7 else peer end as client from t""")
def client_addresses(spark, sf_dir):
    from corpusloom.functions import urls

    e, u = F.col("event_id"), F.col("user_id")
    peer = F.concat(F.when(u % 3 == 0, "10.0.").otherwise("9.8."), u % 256, F.lit("."), e % 256)
    forwarded = F.when(e % 4 == 1, F.concat(F.lit(" 8.8."), e % 9, F.lit(".8 , 1.1.1.1"))).when(e % 4 == 2, "").when(e % 4 == 3, F.concat(F.lit("7.7.7."), e % 7))
    return table(spark, sf_dir, "events").select("event_id", urls.client_ip(peer, forwarded, ("10.0",)).alias("client"))
