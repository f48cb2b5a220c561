"""Queries of hybrid retrieval and context assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import rules, vectors
from corpusloom.operators import catalogue, retrieval as r
from corpusloom.plans.common import ASKED_SQL, CHUNKS_SQL, asked, chunks, fold_sql, registry, table
from corpusloom.scratch import stored

QUERIES, query = registry()

_WORDS = "regexp_extract_all(lower({x}), '[a-zğüşıöç]{{{n},}}')"
_TERMS3 = _WORDS.format(x="question", n=3)

_FULL_TEXT = f"""qt as (select query_id, list_distinct({_TERMS3}) as all_terms, {_TERMS3} as raw from asked),
qf as (select query_id, list_filter(raw, lambda w, i: list_position(raw, w) = i)[1:10] as terms from qt),
qx as (select query_id, len(terms) as n, unnest(terms) as term from qf),
cw as (select chunk_id, term, count(*) as tf from (select chunk_id, unnest({_WORDS.format(x="content", n=3)}) as term from chunks) group by all),
tw as (select distinct chunk_id, unnest({_WORDS.format(x="page_title", n=3)}) as term from chunks),
w as (select coalesce(cw.chunk_id, tw.chunk_id) as chunk_id, coalesce(cw.term, tw.term) as term, coalesce(tf, 0) as tf, case when tw.term is null then 0 else 1 end as in_title from cw full join tw on cw.chunk_id = tw.chunk_id and cw.term = tw.term),
pts as (select query_id, chunk_id, any_value(n) as n, sum(least(tf, 4) * 10 + in_title * 16) as points from qx join w using (term) group by query_id, chunk_id),
ft as (select query_id, chunk_id, rank, place from (select *, row_number() over (partition by query_id order by rank desc, chunk_id) as place from (select query_id, chunk_id, round(points / 40.0 / n, 6) as rank from pts) where rank > 0.01) where place <= 20)"""


@query(f"with {CHUNKS_SQL}, {ASKED_SQL}, {_FULL_TEXT} select query_id, chunk_id, rank, place from ft")
def full_text_top(spark, sf_dir):
    found = r.full_text(asked(spark, sf_dir), chunks(spark, sf_dir))
    return found.select("query_id", "chunk_id", "rank", F.col("place").cast("long").alias("place"))


@query(f"""with {CHUNKS_SQL}, {ASKED_SQL}, cw as (select chunk_id, term, count(*) as tf from (select chunk_id, unnest({_WORDS.format(x="content", n=3)}) as term from chunks) group by all),
s as (select chunk_id, sum(tf) as size from cw group by chunk_id), whole as (select count(*) as n, avg(size) as mean from s), df as (select term, count(*) as df from cw group by term),
t as (select distinct query_id, unnest({_TERMS3}) as term from asked),
sc as (select query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) as score from t join cw using (term) join df using (term) join s using (chunk_id), whole group by query_id, chunk_id)
select query_id, place, score from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as place from sc) where place <= 20""")
def bm25_top(spark, sf_dir):
    return r.bm25(asked(spark, sf_dir), chunks(spark, sf_dir)).select("query_id", F.col("place").cast("long").alias("place"), "score")


_VAR = """v as (select vec_id // 150 as query_id, (vec_id // 50 % 3)::int as variant, embedding::double[] as e from embeddings where vec_id % 50 = 0),
c as (select vec_id as chunk_id, embedding::double[] as e, 'https://example.edu/' || case when vec_id % 7 = 0 then 'news/' else 'page/' end || vec_id as source_url from embeddings),
cos as (select query_id, variant, chunk_id, round(1 - list_dot_product(v.e, c.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(c.e, c.e))), 12) + 0.0 as d from v, c),
hits as (select * from (select *, row_number() over (partition by query_id, variant order by d, chunk_id) as n from cos) where n <= 80),
merged as (select query_id, chunk_id, min(d) as d_min, min(case when variant = 0 then d end) as d_primary from hits where chunk_id % 7 <> 0 group by query_id, chunk_id)"""


def _variants(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked_ = e.where("vec_id % 50 = 0").select(F.expr("vec_id div 150").alias("query_id"), F.expr("vec_id div 50 % 3").cast("int").alias("variant"), "embedding")
    url = F.concat(F.lit("https://example.edu/"), F.when(F.col("vec_id") % 7 == 0, "news/").otherwise("page/"), "vec_id")
    return asked_, e.select(F.col("vec_id").alias("chunk_id"), "embedding", url.alias("source_url"))


def _merged(spark, sf_dir):
    asked_, rows = _variants(spark, sf_dir)
    return r.min_merged(r.without_blocked(r.nearest(asked_, rows), rows))


@query(f"with {_VAR} select query_id, variant::bigint as variant, chunk_id, round(d, 6) + 0.0 as d from hits")
def vector_top_k(spark, sf_dir):
    found = r.nearest(*_variants(spark, sf_dir))
    return found.select("query_id", F.col("variant").cast("long").alias("variant"), "chunk_id", (F.round("d", 6) + 0.0).alias("d"))


@query(f"with {_VAR} select query_id, chunk_id, round(d_min, 6) + 0.0 as d_min, round(d_primary, 6) + 0.0 as d_primary from merged")
def vector_min_merge(spark, sf_dir):
    return _merged(spark, sf_dir).select("query_id", "chunk_id", (F.round("d_min", 6) + 0.0).alias("d_min"), (F.round("d_primary", 6) + 0.0).alias("d_primary"))


@query(f"""with {_VAR}, texts as (select query_id, chunk_id from (select (doc_id % 10) as query_id, (doc_id * 3) % 500 as chunk_id from documents) group by all),
both_ as (select query_id, chunk_id, d_min from merged union all select query_id, chunk_id, 0.55 from texts t where not exists (select 1 from merged m where m.query_id = t.query_id and m.chunk_id = t.chunk_id))
select query_id, chunk_id, round(d_min, 6) + 0.0 as d_min, ord from (select *, row_number() over (partition by query_id order by d_min, chunk_id) as ord from both_) where ord <= 80""")
def hybrid_merge(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("query_id"), ((F.col("doc_id") * 3) % 500).alias("chunk_id")).distinct()
    found = r.hybrid(_merged(spark, sf_dir), texts)
    return found.select("query_id", "chunk_id", (F.round("d_min", 6) + 0.0).alias("d_min"), F.col("ord").cast("long").alias("ord"))


def _candidates(spark, sf_dir, pool: int = 40):
    """Questions, embedded by hashing, with their nearest documents."""
    q, c = asked(spark, sf_dir), chunks(spark, sf_dir)
    # stored: the vectors, which several steps look at, and the candidates, whose size then tells how texts are to meet them
    e = stored(c.select("chunk_id", vectors.hashed_embedding(F.col("content")).alias("embedding")), "embedded")
    v = q.select("query_id", F.lit(0).alias("variant"), vectors.hashed_embedding(F.col("question")).alias("embedding"))
    hits = r.min_merged(r.without_blocked(r.nearest(v, e, pool), c))
    found = stored(r.hybrid(hits, r.full_text(q, c), pool), "candidates")
    return r.fetched(found, c).join(q, "query_id")


@query()
def hybrid_retrieval(spark, sf_dir):
    rows = r.thresholded(r.entity_tuned(r.reranked(_candidates(spark, sf_dir))))
    return rows.select("query_id", "chunk_id", F.round("d_min", 6).alias("d_min"), F.round("rerank_key", 6).alias("rerank_key"), F.col("place").cast("long").alias("place"), "relaxed")


@query()
def effective_ranking(spark, sf_dir):
    rows = _candidates(spark, sf_dir, 20).withColumns({"real": F.col("d_primary"), "nominal": F.lit(0.62), "name": F.lit(None).cast("string"), "roster": F.lit(False)})
    ranked = r.ranked(rows.withColumn("eff_d", r.effective_distance()))
    return ranked.select("query_id", "chunk_id", F.round("eff_d", 6).alias("eff_d"), F.col("rank").cast("long").alias("rank"))


#: Questions of every kind that a term of the effective distance looks at; a document is a candidate of one of them, by its id.
_TERM_QUESTIONS = (
    "computer engineering courses", "computer engineering learning outcomes", "software jobs", "where is the campus", "who is Ann Lee", "international bachelor application",
    "which lessons does medical school have", "tell me about health sciences", "tuition fee of software programs",
)
_TERM_URLS = (
    "https://o.example.edu/bologna/progCourses.aspx?curUnit={u}&curSunit={s}", "https://o.example.edu/bologna/progCourseMatrix.aspx?curSunit={s}", "https://o.example.edu/bologna/index.aspx?curop=showPac&curUnit={u}&curSunit={s}",
    "https://o.example.edu/bologna/info.aspx", "https://example.edu/news/{s}", "https://example.edu/academic-staff/{s}", "https://example.edu/graduate/{s}", "https://example.edu/commissions/{s}",
)
_TERM_TITLES = ("Information package", "Message from Head of Department", "Course Structure", "page", "About | it")
_TERM_ENDS = (" Computer Engineering", " medical school", " Ann Lee", "")


def _term_rows(spark, sf_dir):
    """Documents as candidates: question, address, title and the words behind the text by the id."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    unit, sub = pick(("31", "32"), F.expr("doc_id div 72 % 2")), pick(("7001", "7002", "9999"), F.expr("doc_id div 72 % 3"))
    url = F.replace(F.replace(pick(_TERM_URLS, i % 8), F.lit("{u}"), unit), F.lit("{s}"), sub)
    return d.select(
        i.alias("chunk_id"), pick(_TERM_QUESTIONS, i % 9).alias("question"), url.alias("source_url"), pick(_TERM_TITLES, F.expr("doc_id div 8 % 5")).alias("page_title"),
        F.concat(F.coalesce("text", F.lit("")), pick(_TERM_ENDS, F.expr("doc_id div 5 % 4"))).alias("content"), F.when(i % 7 > 0, F.col("n_chars") % 100 / 100).alias("real"), F.lit(0.6).alias("nominal"),
        F.when(i % 9 == 4, "Ann Lee").alias("name"), (i % 13 == 0).alias("roster"),
    )


_TERM_SQL = f"""a as (select doc_id, doc_id % 9 as k, doc_id % 8 as u, (['31', '32'])[doc_id // 72 % 2 + 1] as unit, (['7001', '7002', '9999'])[doc_id // 72 % 3 + 1] as sub, doc_id // 8 % 5 as t,
    ([{", ".join(f"'{x}'" for x in _TERM_TITLES)}])[doc_id // 8 % 5 + 1] as title, coalesce(text, '') || ([{", ".join(f"'{x}'" for x in _TERM_ENDS)}])[doc_id // 5 % 4 + 1] as content,
    case when doc_id % 7 > 0 then n_chars % 100 / 100.0 else 0.6 end as d0, doc_id % 13 = 0 as roster from documents),
b as (select *, k in (0, 1, 6) as asks, k in (0, 6) as lessons, k in (0, 1, 6, 7) as entity, {fold_sql("title || chr(10) || content")} as low, {fold_sql("content")} as body from a),
c as (select *, (k in (0, 1) and (contains(low, 'computer engineering') or contains(low, 'bilgisayar muhendisligi')))::int + (k in (0, 1) and contains(low, 'computer engineering') and contains(low, 'bilgisayar muhendisligi'))::int
    + (k = 6)::int * len(list_filter(['faculty of medicine', 'medical school', 'tip fakultesi', 'hekimlik'], lambda n: contains(low, n))) + (k = 7)::int * len(list_filter(['faculty of health sciences', 'health sciences', 'saglik bilimleri fakultesi'], lambda n: contains(low, n))) as own,
    len(list_filter(['computer programming', 'computer programmer', 'bilgisayar programciligi', 'computer engineering', 'bilgisayar muhendisligi', 'faculty of health sciences', 'health sciences', 'saglik bilimleri fakultesi', 'faculty of medicine', 'medical school', 'tip fakultesi', 'hekimlik'], lambda n: contains(low, n))) as names_,
    u < 4 or t = 2 as cat, u < 3 as detail, u < 4 or t = 2 or contains(body, 'course') or contains(body, 'bologna') or contains(body, '/catalogue/') as cat_any,
    t in (0, 2) or contains(body, 'information package') or contains(body, 'program learning outcomes') or contains(body, 'course structure') as headed,
    k in (0, 1) and ((u in (0, 2) and unit = '31') or (u in (0, 1, 2) and sub <> '9999')) as ours, k in (0, 1) and u < 3 as judged from b),
e as (select *, d0 + case when k in (0, 1, 2) and u = 4 then 0.14 else 0 end + case when entity then least(0.04, 0.01 * (names_ - own)) - least(0.06, 0.02 * own) else 0 end + case when entity and u = 4 then 0.04 else 0 end
    + case when asks and own > 0 and cat_any then -0.08 when asks and headed and not ours then 0.22 else 0 end as d1, k = 4 and contains(body, 'ann') and contains(body, 'lee') as named, u = 5 or t = 1 as high, u = 7 as less from c),
f as (select *, case when not named then d1 when high then least(d1, 0.05) when less then d1 + 0.36 else least(d1, 0.12) end as d2 from e),
g as (select *, case when roster then least(d2, 0.12) else d2 end as d3 from f)
select doc_id as chunk_id, round(d3 + case when asks and u = 5 then 0.18 else 0 end + case when asks and not cat then 0.24 + case when t in (1, 4) then 0.2 else 0 end else 0 end
  + case when asks and cat and detail then -0.1 + case when own = 0 and judged and not ours and not (u < 2 and lessons) then 0.24 else 0 end when asks and cat and t = 0 then 0.08 else 0 end
  + case when not cat then 0 when k = 3 then 0.22 when asks and detail then -0.16 when asks then -0.1 else 0.03 end
  + case when not judged then 0 when lessons and u < 2 then case when u = 0 and unit = '31' then -0.14 else 0 end + case when sub <> '9999' then -0.12 else -0.08 end
      else case when u = 1 then 0 when unit = '31' then -0.2 else 0.5 end + case when sub <> '9999' then -0.14 else 0.34 end end
  + case when k = 0 and u < 3 and sub = '7002' then -0.09 else 0 end + case when lessons and u = 0 then -0.22 when lessons and u = 1 then -0.16 else 0 end + case when k = 5 and u = 6 then 0.18 else 0 end, 6) + 0.0 as eff_d from g"""


@query(f"with {_TERM_SQL}")
def effective_terms(spark, sf_dir):
    site = rules.Site(preferred=(("computer-engineering", "cursunit=7002"),))
    hints = spark.createDataFrame([("computer-engineering", "31", "7001"), ("computer-engineering", "31", "7002")], "entity string, unit string, sub_unit string")
    rows = r.with_units(_term_rows(spark, sf_dir), hints)
    return rows.select("chunk_id", (F.round(r.effective_distance(site, F.col("units"), F.col("sub_units")), 6) + 0.0).alias("eff_d"))


_LEX_BLOCK = "not regexp_matches(lower(source_url), '/news|/archive|/events|/event|/haber|/duyuru|/blog')"


@query(f"""with {CHUNKS_SQL}, {ASKED_SQL}, q as (select query_id, list_distinct({_WORDS.format(x="question", n=4)}) as terms from asked),
t as (select query_id, unnest(terms) as w from q), c as (select chunk_id, lower(content) as c, lower(page_title) as t, lower(source_url) as u from chunks where {_LEX_BLOCK}),
sc as (select query_id, chunk_id, sum((case when contains(c, w) then 1 else 0 end) + (case when contains(c.t, w) then 2 else 0 end) + (case when contains(u, w) then 2 else 0 end))::bigint as score from t, c group by query_id, chunk_id),
f as (select * from sc where score > 0)
select query_id, chunk_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from f) where rank <= 40""")
def lexical_fallback(spark, sf_dir):
    found = r.lexical(asked(spark, sf_dir), chunks(spark, sf_dir))
    return found.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


_GREEDY = """rows_ as (select doc_id // 20 as query_id, doc_id as chunk_id, 'u' || (doc_id % 3) as url, text[1:700] as snippet, row_number() over (partition by doc_id // 20 order by doc_id % 7, doc_id) as rank from documents where length(text) > 0),
fold(query_id, rank, used, seen, ids) as (
  select query_id, 0::bigint, 0::bigint, []::varchar[], []::bigint[] from (select distinct query_id from rows_)
  union all
  select f.query_id, x.rank, case when ok then used + n else used end, case when ok then list_append(seen, x.url) else seen end, case when ok then list_append(ids, x.chunk_id) else ids end
  from fold f join (select *, length(snippet) as n from rows_) x on x.query_id = f.query_id and x.rank = f.rank + 1, lateral (select used + n <= 3000 and len(list_filter(seen, lambda u: u = x.url)) < 2 as ok))"""


@query(f"with recursive {_GREEDY} select query_id, arg_max(used, rank) as context_chars, len(arg_max(ids, rank))::bigint as chunks_used, array_to_string(arg_max(ids, rank), ',') as chunk_ids from fold group by query_id")
def context_assembly(spark, sf_dir):
    from pyspark.sql import Window as W

    d = table(spark, sf_dir, "documents").where("length(text) > 0")
    rows = d.select(F.expr("doc_id div 20").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.concat(F.lit("u"), F.col("doc_id") % 3).alias("source_url"), F.lit("t").alias("page_title"), F.substring("text", 1, 700).alias("snippet"))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("chunk_id") % 7, "chunk_id")))
    return r.assembled(rows).select("query_id", "context_chars", "chunks_used", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query("select query_id, url, n as place from (select lang as query_id, source as url, doc_id, row_number() over (partition by lang, source order by n_chars desc, doc_id) as n from documents) where n <= 2")
def per_url_cap(spark, sf_dir):
    from pyspark.sql import Window as W

    order = W.partitionBy("lang", "source").orderBy(F.desc("n_chars"), "doc_id")
    d = table(spark, sf_dir, "documents").withColumn("n", F.row_number().over(order)).where("n <= 2")
    return d.select(F.col("lang").alias("query_id"), F.col("source").alias("url"), F.col("n").cast("long").alias("place"))


@query("select doc_id, row_number() over (order by case when lang = 'en' then 0 when lang = 'de' then 1 else 2 end, n_chars desc, doc_id) as place from documents qualify place <= 8")
def bucket_sort(spark, sf_dir):
    from pyspark.sql import Window as W

    key = [F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2), F.desc("n_chars"), F.col("doc_id")]
    top = table(spark, sf_dir, "documents").orderBy(*key).limit(8)
    return top.select("doc_id", F.row_number().over(W.orderBy(*key)).cast("long").alias("place"))


@query("""with q(query_id, term) as (values (1, 'idiot'), (1, 'clown'), (2, 'license')), c as (select doc_id, lower(text) as low from documents),
h as (select term, doc_id, row_number() over (partition by term order by doc_id) as n from c, (select distinct term from q) where contains(low, term))
select query_id::bigint as query_id, doc_id as chunk_id from q join h using (term) where n <= 6 group by all""")
def term_boost(spark, sf_dir):
    q = spark.createDataFrame([(1, ["idiot", "clown"]), (2, ["license"])], "query_id long, terms array<string>")
    c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit("").alias("page_title"), F.col("text").alias("content"))
    return r.term_rows(q, c, F.col("terms"), 6, 0.65).select("query_id", "chunk_id")


@query("""with q(query_id, a, b) as (values (1, 'pathetic', 'clown'), (2, 'nosuchword', 'idiot')), c as (select doc_id, lower(text) as low from documents),
t as (select query_id, doc_id, case when contains(low, a) and contains(low, b) then 1 when contains(low, b) then 2 when contains(low, a) then 3 end as tier from q, c),
best as (select query_id, min(tier) as tier from t group by query_id)
select query_id::bigint as query_id, doc_id as chunk_id, tier::bigint as tier from (select t.*, row_number() over (partition by query_id order by doc_id) as n from t join best using (query_id, tier)) where n <= 8""")
def person_tiers(spark, sf_dir):
    q = spark.createDataFrame([(1, "Pathetic Clown"), (2, "Nosuchword Idiot")], "query_id long, name string")
    c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit("").alias("page_title"), F.col("text").alias("content"))
    return r.person_rows(q, c).select("query_id", "chunk_id", F.col("tier").cast("long").alias("tier"))


_UNIT_URLS = "p as (select doc_id as page_id, 'https://o.example.edu/x?curUnit=' || (doc_id % 4) || case when doc_id % 3 = 0 then '' else '&curSunit=' || (doc_id % 6) end as url, case doc_id % 3 when 0 then 'a' when 1 then 'b' else 'c' end as entity from documents)"


def _unit_pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://o.example.edu/x?curUnit="), F.col("doc_id") % 4, F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("&curSunit="), F.col("doc_id") % 6)))
    return d.select(F.col("doc_id").alias("page_id"), url.alias("url"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("doc_id") % 3 + 1).cast("int")).alias("entity"))


@query(f"""with {_UNIT_URLS}, x as (select *, regexp_extract(url, 'curUnit=([0-9]*)', 1) as u, nullif(regexp_extract(url, 'curSunit=([0-9]*)', 1), '') as s from p)
select page_id, case entity when 'c' then null when 'a' then u in ('0', '1') or coalesce(s in ('0', '3'), false) else u = '2' or coalesce(s = '4', false) end as state from x""")
def unit_states(spark, sf_dir):
    hints = spark.createDataFrame([("a", "0", "0"), ("a", "1", "3"), ("b", "2", "4")], "entity string, unit string, sub_unit string")
    return catalogue.unit_state(_unit_pages(spark, sf_dir), hints).select("page_id", "state")


@query(f"""with {_UNIT_URLS} select page_id from p where coalesce(nullif(regexp_extract(url, 'curSunit=([0-9]*)', 1), ''), regexp_extract(url, 'curUnit=([0-9]*)', 1)) in ('0', '1', '3')""")
def pages_of_units(spark, sf_dir):
    hints = spark.createDataFrame([("0", "0"), ("1", "3")], "unit string, sub_unit string")
    return catalogue.of_units(_unit_pages(spark, sf_dir), hints).select("page_id")


@query(f"""with {_UNIT_URLS}, x as (select *, try_cast(nullif(regexp_extract(url, 'curSunit=([0-9]+)', 1), '') as bigint) as n from p where contains(url, 'curSunit'))
select chunk_id, place from (select page_id as chunk_id, row_number() over (order by n is null, n, page_id) as place from x) where place <= 24""")
def course_chunks(spark, sf_dir):
    c = _unit_pages(spark, sf_dir).select(F.col("page_id").alias("chunk_id"), F.col("url").alias("source_url"))
    return catalogue.course_chunks(c, F.contains("source_url", F.lit("curSunit"))).select("chunk_id", F.col("place").cast("long").alias("place"))


@query(f"with {_VAR}, h as (select * from (select *, row_number() over (partition by query_id, variant order by d, chunk_id) as n from cos where chunk_id % 7 <> 0) where n <= 10) select query_id, chunk_id, round(min(d), 6) + 0.0 as d_min from h group by all")
def host_pool(spark, sf_dir):
    asked_, rows = _variants(spark, sf_dir)
    rows = rows.withColumn("source_url", F.when(F.contains("source_url", F.lit("news")), F.lit("https://other.org/x")).otherwise(F.col("source_url")))
    return catalogue.host_pool(asked_, rows, "example.edu", 10).select("query_id", "chunk_id", (F.round("d_min", 6) + 0.0).alias("d_min"))


@query("select url, row_number() over (order by url <> (select max(url) from pages), url) as place from (select distinct url from pages)")
def pinned_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    index_url = p.agg(F.max("url")).first()[0]
    return catalogue.pinned_first(p, index_url).select("url", F.col("place").cast("long").alias("place"))


@query("""with l as (select distinct source as label from documents), h as (select label, case when contains(label, 'src1') then 0 when contains(label, '5') then 1 when contains(label, '7') then 1 end as tier, case when contains(label, 'src1') then 0 when contains(label, '5') then 0 when contains(label, '7') then 1 end as word from l)
select label, tier::bigint as tier, row_number() over (order by tier, word, label) as place from h where tier is not null""")
def menu_order(spark, sf_dir):
    labels = table(spark, sf_dir, "documents").select(F.col("source").alias("label")).distinct()
    return catalogue.menu_ranked(labels, [["src1"], ["5", "7"]]).select("label", F.col("tier").cast("long").alias("tier"), F.col("place").cast("long").alias("place"))


@query()
def person_pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://example.edu/"), "doc_id").alias("url"), F.lit("t").alias("title"), F.col("text").alias("content"))
    return catalogue.person_pages(d, "Pathetic Clown").select("page_id", F.col("place").cast("long").alias("place"), F.length("part").cast("long").alias("n_chars"))


@query(f"""with {CHUNKS_SQL}, c as (select chunk_id, content, case when chunk_id % 3 = 0 then 'https://example.edu/bologna/' || case when chunk_id % 2 = 0 then 'computer-engineering/' else 'x/' end || chunk_id else source_url end as url from chunks),
q(query_id, entity) as (values (6, null), (7, 'computer-engineering')),
e as (select chunk_id, contains(url, 'computer-engineering') as named, contains(lower(content), 'computer engineering') or contains(lower(translate(content, 'ıİşŞğĞüÜöÖçÇâÂîÎ', 'iissgguuooccaaii')), 'bilgisayar muhendisligi') as alias, contains(url, 'course') as course from c where contains(url, 'bologna') or contains(url, 'course') or contains(url, '/catalogue/')),
f as (select *, row_number() over (order by chunk_id) as n from e where named or alias)
select query_id::bigint as query_id, chunk_id, place from (select *, row_number() over (order by course desc, named desc, alias desc, chunk_id) as place from f where n <= 120), q where place <= 5 and entity is not null""")
def catalogue_fallback(spark, sf_dir):
    from corpusloom.plans.common import questions

    c = chunks(spark, sf_dir).withColumn("source_url", F.when(F.col("chunk_id") % 3 == 0, F.concat(F.lit("https://example.edu/bologna/"), F.when(F.col("chunk_id") % 2 == 0, "computer-engineering/").otherwise("x/"), "chunk_id")).otherwise(F.col("source_url")))
    return catalogue.fallback_chunks(questions(spark), c).select("query_id", "chunk_id", F.col("place").cast("long").alias("place"))


# The second and the eighth question ask for fees, the eighth for scholarships; addresses of chunks whose id leaves 1 of 9 name fees.
@query(f"""with {CHUNKS_SQL}, first_ as (select chunk_id, {fold_sql("content")} as low from chunks where chunk_id % 9 = 1 order by chunk_id limit 24),
m as (select chunk_id, contains(low, 'discount') or contains(low, 'indirim') or len(list_intersect(string_split_regex(low, '[^a-z0-9]+'), ['scholar', 'scholarship', 'scholarships', 'burs', 'burslar', 'burslari'])) > 0 as mentions from first_)
select query_id::bigint as query_id, chunk_id, case when query_id = 8 and mentions then 0.08 else 0.12 end::double as nominal from m, (values (2), (8)) q(query_id)""")
def fee_prepend(spark, sf_dir):
    from corpusloom.plans.common import questions

    c = chunks(spark, sf_dir).withColumn("source_url", F.when(F.col("chunk_id") % 9 == 1, F.concat(F.lit("https://example.edu/fees/"), "chunk_id")).otherwise(F.col("source_url")))
    return r.fee_rows(questions(spark), c)


@query("""with k(kind, query_id, part, most, chars) as (values ('location', 3, '/en/', 2, 1200), ('location', 15, '/en/', 2, 1200), ('requirements', 4, '/de/', 1, 14000), ('international', 4, '.html', 2, 2200),
  ('international', 5, '.html', 2, 2200), ('international', 13, '.html', 2, 2200), ('scholarship', 8, '/fr/', 1, 14000), ('roster', 1, '/es/', 1, 10000)),
f as (select kind, query_id, url, least(length(html), chars) as n_chars, most, row_number() over (partition by kind, query_id order by length(url), url) as place from k join pages on contains(lower(url), part))
select query_id::bigint as query_id, kind, url, n_chars::bigint as n_chars, place from f where place <= most""")
def intent_page_blocks(spark, sf_dir):
    from corpusloom.plans.common import questions

    p = table(spark, sf_dir, "pages").select("url", F.lit("t").alias("title"), F.col("html").alias("content"))
    kinds = (("location", "/en/", 2, 1200), ("requirements", "/de/", 1, 14_000), ("international", r"\.html", 2, 2200), ("scholarship", "/fr/", 1, 14_000), ("roster", "/es/", 1, 10_000))
    out = None
    for kind, pattern, n, chars in kinds:
        rows = r.page_blocks(questions(spark), p, kind, pattern, n, chars).select("query_id", F.lit(kind).alias("kind"), "url", F.length("block").cast("long").alias("n_chars"), F.col("place").cast("long").alias("place"))
        out = rows if out is None else out.union(rows)
    return out
