"""Queries of the assembly. Their SQL states what each phrase asks for by hand and folds with recursive tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators import assembly, retrieval
from corpusloom.plans.common import registry, table

QUERIES, query = registry()

#: What is put in front of a benchmark item to make it a question, by its id.
PHRASES = ("which courses are in the curriculum", "tuition fee", "academic staff", "scholarship", "who is the dean", "where is the campus", "tell me about", "compare the courses")

_PHRASED = "qs as (select item_id as query_id, item_id % 8 as k from benchmark), n as (select count(*) as c from benchmark)"


def _phrased(spark, sf_dir):
    """Benchmark items as questions of several intents."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.get(F.array(*map(F.lit, PHRASES)), (F.col("item_id") % 8).cast("int")), "text").alias("question"))


def _dealt(spark, sf_dir):
    """Every document as a chunk of one question."""
    n = table(spark, sf_dir, "benchmark").count()
    d = table(spark, sf_dir, "documents")
    on_tab = F.col("doc_id") % 3 == 1
    url = F.when(on_tab, F.concat(F.lit("https://o.example.edu/catalogue/courses.aspx?lang="), "lang", F.lit("&curSunit="), F.col("doc_id") % 5)).otherwise(F.concat(F.lit("https://example.edu/"), "source", F.when(F.col("doc_id") % 11 == 0, "/news/").otherwise("/p/"), F.col("doc_id") % 7))
    return d.select(
        (F.col("doc_id") % n).alias("query_id"), F.col("doc_id").alias("chunk_id"), url.alias("source_url"), F.when(F.col("doc_id") % 4 == 0, "fee list").otherwise(F.concat(F.lit("page "), "source")).alias("page_title"),
        F.coalesce("text", F.lit("")).alias("content"), (F.col("n_chars") % 1000 / 1000).alias("distance"), "lang",
        F.when(on_tab & (F.col("doc_id") % 2 == 0), 0).when(F.col("lang") == "fr", 2).otherwise(1).alias("origin"), F.col("n_chars").cast("int").alias("place"),
    )


_DEALT = """dealt as (select doc_id % n.c as query_id, doc_id as chunk_id,
    case when doc_id % 3 = 1 then 'https://o.example.edu/catalogue/courses.aspx?lang=' || lang || '&curSunit=' || doc_id % 5 else 'https://example.edu/' || source || case when doc_id % 11 = 0 then '/news/' else '/p/' end || doc_id % 7 end as url,
    case when doc_id % 4 = 0 then 'fee list' else 'page ' || source end as title, coalesce(text, '') as content, n_chars % 1000 / 1000 as distance, lang, doc_id % 3 = 1 as tab, doc_id % 11 = 0 and doc_id % 3 <> 1 as blocked,
    case when doc_id % 3 = 1 and doc_id % 2 = 0 then 0 when lang = 'fr' then 2 else 1 end as origin, n_chars::int as place from documents, n)"""


@query(f"""with {_PHRASED}, {_DEALT},
rows_ as (select *, row_number() over (partition by query_id, lang order by place, chunk_id) as nth from dealt),
own as (select r.*, k from rows_ r join qs using (query_id)),
held as (
  select query_id, chunk_id, 0 as counts, nth, 0.59::double as nominal, 'person' as list, 3 as shown from own where lang = 'en' and nth <= 8 and not blocked
  union all select query_id, chunk_id, 1, nth, 0.12, 'roster', 4 from own where lang <> 'de' and k = 2 and nth <= 20 and not blocked
  union all select query_id, chunk_id, 2, nth, 0.2, 'leadership', 5 from own where lang = 'es' and k = 4 and nth <= 22 and not blocked
  union all select query_id, chunk_id, 5, nth, distance, 'vector', 8 from own where chunk_id % 2 = 0 and not blocked
  union all select query_id, chunk_id, 6, nth, 0.72, 'keyword', 9 from own where lang = 'de' and not blocked
  union all select query_id, chunk_id, 8, nth, 0.1, 'person', 2 from own where lang = 'en' and nth <= 20
  union all select query_id, chunk_id, 9, nth, 0.1, 'roster', 1 from own where lang <> 'de' and k = 2 and nth <= 20),
first_ as (select * from held qualify row_number() over (partition by query_id, chunk_id order by counts, nth) = 1)
select query_id, chunk_id, nominal, list, row_number() over (partition by query_id order by shown, nth, chunk_id) as place from first_""")
def ordered_candidates(spark, sf_dir):
    rows = _dealt(spark, sf_dir)
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("query_id", "lang").orderBy("place", "chunk_id"))).withColumn("d", F.col("distance"))
    lists = {"person": rows.where("lang = 'en'"), "roster": rows.where("lang <> 'de'"), "leadership": rows.where("lang = 'es'"), "vector": rows.where("chunk_id % 2 = 0"), "keyword": rows.where("lang = 'de'"), "course_tab": rows.where("lang = 'en'")}
    return assembly.ordered_lists(_phrased(spark, sf_dir), lists).withColumn("place", F.col("place").cast("long"))


_FEE = r"tuition|ucret|ogrenim|program\s+fee|annual\s+fee|\busd\b|\btry\b|₺|\$\s*[\d,\.]+|vat|kdv|yillik|taksit|per\s+year|/year|scholarship|burs|financial\s+aid|odeme|payment\s+plan|pesin"


def _fold(name: str, items: str, begin: str) -> str:
    """One step takes the next item of each question, or passes it over."""
    return rf"""{name}(query_id, nth, used, pin, urls, ids, tabs, parts, srcs, detail) as (
  {begin} union all
  select f.query_id, x.nth, case when ok then used + size else used end, case when open_ and x.unit is not null and pin is null then x.unit else pin end, case when ok then list_append(urls, x.url) else urls end,
    case when ok then list_append(ids, x.chunk_id) else ids end, case when ok and x.whole then list_append(tabs, x.url) else tabs end,
    case when ok then list_append(parts, '[' || x.title || ']' || chr(10) || substring(x.part, (case when x.middle >= 0 then greatest(0, least(x.middle - size // 2, length(x.part) - size)) else 0 end + 1)::bigint, size)) else parts end,
    case when ok then list_append(srcs, x.url || '|' || x.distance) else srcs end, f.detail or (ok and x.tab)
  from {name} f join {items} x on x.query_id = f.query_id and x.nth = f.nth + 1,
    lateral (select used < x.budget and x.grounded and not list_contains(ids, x.chunk_id) as open_, least(length(x.part), case when x.dynamic then least(x.most, greatest(500, x.budget - used - 100)) else length(x.part) end)::bigint as size),
    lateral (select open_ and not x.blocked and (x.unit is null or pin is null or x.unit = pin) and not list_contains(x.skipped, x.url) and len(list_filter(urls, lambda u: u = x.url)) < x.per_url
      and not (x.whole and list_contains(tabs, x.url)) and used + size <= x.budget as ok))"""


@query(rf"""with recursive {_PHRASED}, {_DEALT},
least_ as (select query_id, min(chunk_id) as chunk_id from dealt group by query_id),
blocks as (
  select query_id, k, case k when 1 then 'roster' when 2 then 'roster' when 3 then 'scholarship' when 4 then 'management' when 5 then 'location' when 6 then 'requirements' end as kind, content[1:300] as block, url from least_ join dealt using (query_id, chunk_id) join qs using (query_id)
  where k between 1 and 6 and content <> ''),
own as (
  select query_id, k, kind, block, b.url as block_url, k in (0, 7) as courses, k in (1, 3) as fee, case when k in (0, 7) then 14000 when kind = 'requirements' then 12000 when kind = 'roster' then 9000 else 3000 end as budget,
    case when kind in ('roster', 'management') and k <> 1 or kind = 'location' then kind end as alone, case when kind in ('roster', 'requirements', 'scholarship') then [b.url] else [] end as skipped
  from qs left join blocks b using (query_id, k)),
merged as (select url, trim(string_agg(content, chr(10) order by chunk_id))[1:400000] as merged from dealt where tab group by url),
bodies as (select d.*, own.* exclude (query_id), tab and courses as on_tab, tab and courses and length(trim(coalesce(merged, ''))) >= 500 as whole, coalesce(merged, '') as merged from dealt d join own using (query_id) left join merged using (url)),
needled as (select *, case when whole then merged else content end as body, case when query_id % 16 = 0 then strpos(lower(case when whole then merged else content end), 'tion') else 0 end as hit, case when whole then 10000 else 2400 end as most from bodies),
windows as (select *, hit - 1 + 2 as centre, greatest(0, hit - 1 + 2 - most) as begin_ from needled),
items as (
  select query_id, origin, place, chunk_id, url, title, distance, tab, blocked, budget, skipped, whole, most, on_tab as dynamic, 2 + (k = 3)::int as per_url, not fee or contains(title, 'fee') or contains(title || url, 'scholarship') or regexp_matches(lower(title || chr(10) || content)[1:80000], '{_FEE}') as grounded,
    case when k = 0 and tab then regexp_extract(url, 'curSunit=(.*)', 1) end as unit,
    case when not on_tab then content[1:700] when hit > 0 then substring(body, begin_ + 1, least(length(body), centre + most) - begin_) else body[1:most] end as part, case when on_tab and hit > 0 then centre - begin_ else -1 end as middle
  from windows),
line as (select *, row_number() over (partition by query_id order by origin, place, chunk_id) as nth from items where origin = 1 or origin = 0 and budget = 14000),
{_fold("taken", "line", "select query_id, 0::bigint, 0::bigint, null::varchar, []::varchar[], []::bigint[], []::varchar[], []::varchar[], []::varchar[], false from own")},
full_ as (select * from taken qualify row_number() over (partition by query_id order by nth desc) = 1),
near as (select i.* from items i join full_ f using (query_id) where origin = 2 and not list_contains(f.ids, i.chunk_id) qualify row_number() over (partition by query_id order by place, chunk_id) <= 16),
four as (select * from near where grounded qualify row_number() over (partition by query_id order by place, chunk_id) <= 4),
pool as (select *, row_number() over (partition by query_id order by distance, chunk_id) as nth from four),
{_fold("filled", "pool", "select query_id, 0::bigint, used, pin, urls, ids, tabs, parts, srcs, detail from full_")},
done as (select * from filled qualify row_number() over (partition by query_id order by nth desc) = 1),
late as (
  select query_id, list(l.chunk_id order by l.chunk_id) as ids, list('[' || l.title || ']' || chr(10) || l.content[1:700] order by l.chunk_id) as parts, list(l.url || '|0.9999' order by l.chunk_id) as srcs
  from (select * from dealt where content <> '' qualify row_number() over (partition by query_id order by chunk_id) <= 2) l join done f using (query_id) join own using (query_id)
  where courses and not f.detail and (not l.tab or k <> 0 or f.pin is null or regexp_extract(l.url, 'curSunit=(.*)', 1) = f.pin) group by query_id),
whole_ as (
  select query_id, own.*, used, list_concat(f.ids, coalesce(late.ids, [])) as ids, list_concat(f.parts, coalesce(late.parts, [])) as parts, list_concat(f.srcs, coalesce(late.srcs, [])) as srcs from own join done f using (query_id) left join late using (query_id))
select query_id, alone, case when alone is null then used else 0 end as context_chars, case when alone is null then array_to_string(ids, ',') else '' end as chunk_ids,
  md5(case when alone is not null then block else array_to_string(case when kind is not null then list_prepend(block, parts) else parts end, chr(10) || chr(10)) end) as context,
  md5(case when alone is not null then block_url || '|0.0' else array_to_string(case when kind is null then srcs when kind = 'roster' and len(list_filter(srcs, lambda s: starts_with(s, block_url || '|'))) > 0 then srcs
    else list_prepend(block_url || '|0.0', list_filter(srcs, lambda s: not starts_with(s, block_url || '|'))) end, ',') end) as sources
from whole_""")
def question_contexts(spark, sf_dir):
    """Candidates of every document, blocks of the least document of a question, tabs merged from whole texts."""
    dealt, phrased = _dealt(spark, sf_dir), _phrased(spark, sf_dir)
    questions = phrased.withColumns({"name": F.lit(None).cast("string"), "course": F.when(F.col("query_id") % 16 == 0, "Tion")})
    first = dealt.groupBy("query_id").agg(F.min_by(F.struct("source_url", "content"), "chunk_id").alias("x"))
    kind = F.get(F.array(*[F.lit(k) for k in (None, "roster", "roster", "scholarship", "management", "location", "requirements", None)]), (F.col("query_id") % 8).cast("int"))
    blocks = first.select("query_id", kind.alias("kind"), F.substring("x.content", 1, 300).alias("block"), F.array(F.struct(F.col("x.source_url").alias("url"), F.lit("b").alias("title"), F.lit(0.0).alias("distance"))).alias("sources")).where("kind is not null")
    tabs = retrieval.merged_tabs(dealt.where(F.contains("source_url", F.lit("courses.aspx"))).withColumn("chunk_index", F.lit(0)))
    low = dealt.where("content <> ''").withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("chunk_id"))).where("place <= 2").withColumn("distance", F.lit(None).cast("double"))
    found = assembly.contexts(questions, dealt.withColumn("state", F.lit(None).cast("boolean")), blocks, tabs, low)
    as_text = F.array_join(F.transform("sources", lambda s: F.concat_ws("|", s["url"], s["distance"].cast("string"))), ",")
    return found.select("query_id", "alone", "context_chars", F.array_join("chunk_ids", ",").alias("chunk_ids"), F.md5("context").alias("context"), F.md5(as_text).alias("sources"))
