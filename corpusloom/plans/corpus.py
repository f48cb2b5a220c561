"""Queries of reports, aggregates, and the link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import chunking
from corpusloom.operators import crawl, reports
from corpusloom.plans.common import CHUNKS_SQL, chunks, registry, table
from corpusloom.scratch import ready_checkpoints

QUERIES, query = registry()

_FIXED = """d as (select doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as c from documents),
ch as (select doc_id as page_id, i as chunk_index, trim(c[i * 580 + 1:i * 580 + 700]) as content from (select doc_id, c, unnest(range(0, (greatest(0, ceil((length(c) - 700) / 580.0)) + 1)::bigint)) as i from d where c <> ''))"""


def _fixed(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("page_id"), F.posexplode(chunking.fixed_windows(F.col("text"))).alias("chunk_index", "content"))


@query(f"with {_FIXED} select (select count(*) from documents) as pages, count(*) as chunks, count(distinct page_id) as covered, round(count(*)::double / count(distinct page_id), 6) as chunks_per_page from ch")
def corpus_stats(spark, sf_dir):
    return reports.corpus_stats(table(spark, sf_dir, "documents"), _fixed(spark, sf_dir))


@query(f"""with {_FIXED}, a as (select count(*) as pages, count(nullif(html, '')) as pages_with_units, count(*) filter (contains(lower(url), '/en/')) as url_en, count(*) filter (contains(lower(url), '.html')) as url_html from pages),
b as (select round(avg(n), 6) as mean_chunks, sum(n)::bigint as chunks from (select page_id, count(*) as n from ch group by page_id)), c as (select round(avg(length(content)), 6) as mean_chars from (select * from ch order by page_id, chunk_index limit 500))
select a.*, b.*, c.* from a, b, c""")
def index_audit(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("embedding_units", F.expr("nullif(html, '')"))
    return reports.index_audit(pages, _fixed(spark, sf_dir), ("/en/", ".html"))


_NEAR = """cos as (select q.vec_id as query_id, c.vec_id as chunk_id, c.label::bigint as page_id,
    round(1 - list_dot_product(q.embedding::double[], c.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(c.embedding::double[], c.embedding::double[]))), 12) + 0.0 as d
  from embeddings q, embeddings c where q.vec_id % 50 = 0),
near as (select * from (select *, row_number() over (partition by query_id order by d, chunk_id) as n from cos) where n <= 120)"""


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return asked, e.select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("page_id"), "embedding")


@query(f"with {_NEAR} select query_id, page_id, round(min(d), 5) as min_d from near group by query_id, page_id")
def coverage_top_n(spark, sf_dir):
    asked, rows = _vectors(spark, sf_dir)
    return reports.coverage(asked, rows)


@query(f"with {_NEAR} select page_id, min(min_d) as min_d, count(*) as questions from (select query_id, page_id, round(min(d), 5) as min_d from near group by all) group by page_id")
def coverage_by_page(spark, sf_dir):
    asked, rows = _vectors(spark, sf_dir)
    return reports.coverage_by_page(reports.coverage(asked, rows))


@query(f"with {_NEAR} select vec_id as page_id from embeddings where vec_id not in (select chunk_id from near)")
def never_hit_vectors(spark, sf_dir):
    asked, rows = _vectors(spark, sf_dir)
    rows = rows.withColumn("page_id", F.col("chunk_id"))
    return reports.never_hit(reports.coverage(asked, rows), rows)


@query(f"with {_NEAR} select query_id, array_to_string(list_sort(list(distinct page_id)), ',') as page_ids from near group by query_id")
def coverage_pages_of_question(spark, sf_dir):
    asked, rows = _vectors(spark, sf_dir)
    found = reports.coverage(asked, rows)
    return found.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("page_id")), ",").alias("page_ids"))


@query(f"""with {_NEAR}, found as (select query_id, page_id, round(min(d), 5) as min_d from near group by query_id, page_id)
select 'top_n' as part, '' as key, '120' as value union all select 'question_count', '', count(distinct vec_id)::varchar from embeddings where vec_id % 50 = 0
union all select 'page_count', '', count(distinct label)::varchar from embeddings
union all select 'pages_never_in_top_n', label::varchar, '' from (select distinct label from embeddings where label not in (select page_id from found))
union all select 'min_cosine_distance_by_page', page_id::varchar, round(min(min_d) * 100000)::bigint::varchar from found group by page_id
union all select 'per_question', query_id::varchar, string_agg(page_id::varchar || ':' || round(min_d * 100000)::bigint, ',' order by page_id) from found group by query_id""")
def coverage_report_json(spark, sf_dir):
    """The report's rows; distances in units of 1e-5."""
    asked, rows = _vectors(spark, sf_dir)
    found = reports.coverage_report(reports.coverage(asked, rows), rows, asked, 120)
    units = lambda c: F.round(c.cast("double") * 100_000).cast("long").cast("string")
    pages = F.array_sort(F.from_json("value", "array<struct<page_id:long,min_d:double>>"))
    short = F.array_join(F.transform(pages, lambda x: F.concat(x["page_id"].cast("string"), F.lit(":"), units(x["min_d"]))), ",")
    value = F.when(F.col("part") == "per_question", short).when(F.col("part") == "min_cosine_distance_by_page", units(F.col("value"))).otherwise(F.col("value"))
    return found.select("part", "key", value.alias("value"))


@query("""with n as (select unnest(['/en/', '/de/', '.html', '?', 'casino']) as needle), h as (select needle, url, row_number() over (partition by needle order by url) as k from pages, n where contains(lower(url), needle))
select needle, count(*) as pages, array_to_string(list(url order by url) filter (k <= 5), ' ') as first_urls from h group by needle""")
def scrape_coverage(spark, sf_dir):
    found = reports.scrape_coverage(table(spark, sf_dir, "pages"), ("/en/", "/de/", ".html", "?", "casino"))
    return found.withColumn("first_urls", F.array_join("first_urls", " "))


@query("select count(*) filter (contains(lower(text), 'idiot')) as plain_hits, count(*) filter (contains(lower(translate(text, 'ıİşŞğĞüÜöÖçÇâÂîÎ', 'iissgguuooccaaii')), 'idiot')) as folded_hits from documents")
def person_probe(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumnRenamed("text", "content")
    return reports.person_probe(d, "Idiot")


@query("""with s as (select doc_id as qid, case when doc_id % 2 = 0 then 'base' else 'tuned' end as mode, quality + 1 as accuracy, toxic as format, (quality + toxic) % 3 as claims from labels)
select mode, count(*) as n, round(avg(accuracy), 2) as accuracy, round(avg(format), 2) as format, round(avg(claims), 2) as claims from s group by mode""")
def rubric_means(spark, sf_dir):
    s = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("qid"), F.when(F.col("doc_id") % 2 == 0, "base").otherwise("tuned").alias("mode"), (F.col("quality") + 1).alias("accuracy"), F.col("toxic").alias("format"), ((F.col("quality") + F.col("toxic")) % 3).alias("claims"))
    return reports.rubric_means(s)


@query("""select b.item_id as qid, max(case when a.doc_id % 3 = 0 then a.lang end) as base_answer, max(case when a.doc_id % 3 = 1 then a.lang end) as base_prompted_answer, max(case when a.doc_id % 3 = 2 then a.lang end) as adapter_answer
  from benchmark b left join documents a on a.doc_id // 3 = b.item_id group by b.item_id""")
def evaluation_records(spark, sf_dir):
    answers = table(spark, sf_dir, "documents").select(F.expr("doc_id div 3").alias("qid"), F.element_at(F.array(*map(F.lit, ("base", "base_prompted", "adapter"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("mode"), F.col("lang").alias("answer"))
    return reports.evaluation_records(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid")), answers)


@query("select lang, source, count(*) as n, count(distinct text) as texts, round(avg(n_chars), 4) as mean_chars, max(n_chars) as most, bool_or(n_chars > 5000) as any_long, bool_and(n_chars > 10) as all_some, count(*) filter (contains(text, '%')) as with_percent from documents group by lang, source")
def source_profile(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.max("n_chars").alias("most"), F.bool_or(F.col("n_chars") > 5000).alias("any_long"), F.bool_and(F.col("n_chars") > 10).alias("all_some"), F.count_if(F.contains("text", F.lit("%"))).alias("with_percent"))


@query(f"with {CHUNKS_SQL} select source_url, substr(trim(content), 1, 400000) as merged from chunks")
def merged_tabs(spark, sf_dir):
    from corpusloom.operators.retrieval import merged_tabs as merge

    rows = chunks(spark, sf_dir).withColumn("chunk_index", F.lit(0))
    return merge(rows)


@query(f"with {_FIXED} select page_id, trim(string_agg(content, chr(10) order by chunk_index))[1:400000] as merged from ch group by page_id")
def merged_pages(spark, sf_dir):
    from corpusloom.operators.retrieval import merged_tabs as merge

    rows = _fixed(spark, sf_dir).withColumn("chunk_id", F.col("chunk_index")).withColumnRenamed("page_id", "source_url")
    return merge(rows).withColumnRenamed("source_url", "page_id")


_LINKS = r"""l as (select page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1)) as href from pages),
links as (select page_id, url, href, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) as root, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path from l where not regexp_matches(href, '(?i)^\s*(mailto:|tel:|javascript:)')),
resolved as (select url, regexp_replace(case when regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') then h when starts_with(h, '//') then regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || h when starts_with(h, '/') then root || h
  when starts_with(h, '?') then root || path || h when h = '' or starts_with(h, '#') then url else root || coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || h end, '#.*$', '') as link from (select *, replace(trim(href), '&amp;', '&') as h from links))"""


@query(f"with {_LINKS} select url, link, count(*) as n from resolved group by url, link")
def page_links(spark, sf_dir):
    return crawl.page_links(table(spark, sf_dir, "pages")).groupBy("url", "link").agg(F.count("*").alias("n"))


@query("""with recursive edges as (select distinct user_id as a, (user_id * 7 + length(event_type)) % 150 as b from events),
walk(url, level) as (select 'u1', 0 union select 'u' || e.b, w.level + 1 from walk w join edges e on w.url = 'u' || e.a where w.level < 4)
select url, min(level)::bigint as level from walk group by url""")
def crawl_levels(spark, sf_dir):
    ready_checkpoints(spark)
    e = table(spark, sf_dir, "events")
    edges = e.select(F.concat(F.lit("u"), "user_id").alias("url"), F.concat(F.lit("u"), (F.col("user_id") * 7 + F.length("event_type")) % 150).alias("link")).distinct()
    seeds = spark.createDataFrame([("u1",)], "url string")
    return crawl.reached(edges, seeds, 4).select("url", F.col("level").cast("long").alias("level"))


def _crawl_sql(budget: int, depth: int) -> str:
    """The levels of a crawl, each as its candidates, their order and those visited before the budget is spent."""
    out = []
    for i in range(depth + 1):
        before = " union all ".join(f"select a, n, page from v{j}" for j in range(i)) or "select 0 as a, 0 as n, false as page where false"
        named = f"select b as a, min(v.n * 1000 + p) as key from v{i - 1} v join edges e on e.a = v.a where v.page and b not in (select a from ({before})) group by b" if i else "select a, a as key from (values (2), (5), (4)) s(a)"
        out.append(f"""c{i} as ({named}), o{i} as (select c.a, key, coalesce(page, false) as page, row_number() over (order by key) as m from c{i} c left join fetches using (a)),
v{i} as (select a, {i} as level, m + (select coalesce(max(n), 0) from ({before})) as n, page from (
  select *, coalesce(sum(page::int) over (order by m rows between unbounded preceding and 1 preceding), 0) + (select count(*) from ({before}) where page) as spent from o{i}) where spent < {budget})""")
    return ", ".join(out)


@query(f"""with edges as (select distinct user_id as a, length(event_type) as p, (user_id * 7 + length(event_type)) % 150 as b from events),
fetches as (select distinct user_id as a, user_id % 4 <> 0 and user_id % 7 <> 3 and not (user_id % 3 = 1 and starts_with(user_id::varchar, '1')) as page from events),
{_crawl_sql(12, 5)} select 'https://h' || a % 3 || '.example.org/u/' || a as url, level::bigint as level, n::bigint as place, page from ({" union all ".join(f"select * from v{i}" for i in range(6))})""")
def crawl_with_budget(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    address = lambda n: F.concat(F.lit("https://h"), n % 3, F.lit(".example.org/u/"), n)
    links = e.select(address(F.col("user_id")).alias("url"), F.length("event_type").alias("place"), address((F.col("user_id") * 7 + F.length("event_type")) % 150).alias("link")).distinct()
    answers = e.select(address(F.col("user_id")).alias("url"), (F.col("user_id") % 4 != 0).alias("ok"), F.when(F.col("user_id") % 7 == 3, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type")).distinct()
    rules = spark.createDataFrame([("h1.example.org", "/u/1")], "host string, prefix string")
    seeds = spark.createDataFrame([(2,), (5,), (4,)], "n long").select(address(F.col("n")).alias("url"), F.col("n").alias("place"))
    rows = crawl.visited(links, seeds, crawl.fetchable(answers, rules), 5, 12)
    return rows.select("url", F.col("level").cast("long").alias("level"), "place", "page")


@query("""with d as (select distinct lang as shell, 'u' || doc_id as url, text as body from documents), n as (select *, row_number() over (partition by shell order by url) as n from d)
select shell, md5(string_agg(body[1:8000], chr(10) || chr(10) order by url)) as merged from n where n <= 12 group by shell""")
def merged_details(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("shell"), F.concat(F.lit("u"), "doc_id").alias("url"), F.col("text").alias("body"))
    return crawl.merged_details(d).select("shell", F.md5(F.col("merged").cast("binary")).alias("merged"))


@query("""select page_id, url from pages where not exists (select 1 from (values ('casino-win.example.net', '/'), ('tionsh.example.net', '/de/')) r(host, prefix)
  where regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '') = r.host and starts_with(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), r.prefix))""")
def robots_gate(spark, sf_dir):
    rules = spark.createDataFrame([("casino-win.example.net", "/"), ("tionsh.example.net", "/de/")], "host string, prefix string")
    return crawl.allowed(table(spark, sf_dir, "pages"), rules).select("page_id", "url")
