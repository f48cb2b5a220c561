"""Queries of index upkeep, set operations and joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import chunking, urls
from corpusloom.operators import index
from corpusloom.plans.common import registry, table
from corpusloom.scratch import ready_checkpoints
from corpusloom.streaming import upkeep

QUERIES, query = registry()


def _pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    key = F.regexp_replace("url", r"[?#].*$", "")
    return p.select(key.alias("url"), "page_id", F.length("html").cast("long").alias("size"), (F.col("page_id") % 5).alias("updated_at"))


@query(r"""with p as (select regexp_replace(url, '[?#].*$', '') as url, page_id, length(html)::bigint as size, page_id % 5 as updated_at from pages),
b as (select *, 0 as fresh from p where page_id % 3 <> 0 union all select url, page_id + 1000000, size, updated_at + 1, 1 from p where page_id % 3 <> 1)
select url, page_id, size, updated_at from (select *, row_number() over (partition by url order by updated_at desc, fresh desc, page_id desc) as n from b) where n = 1""")
def upsert_by_url(spark, sf_dir):
    p = _pages(spark, sf_dir)
    stored = p.where("page_id % 3 <> 0").groupBy("url").agg(F.max_by(F.struct("page_id", "size", "updated_at"), F.struct("updated_at", "page_id")).alias("r")).select("url", "r.*")
    new = p.where("page_id % 3 <> 1").select("url", (F.col("page_id") + 1_000_000).alias("page_id"), "size", (F.col("updated_at") + 1).alias("updated_at"))
    new = new.groupBy("url").agg(F.max_by(F.struct("page_id", "size", "updated_at"), F.struct("updated_at", "page_id")).alias("r")).select("url", "r.*")
    return index.upserted(stored, new)


@query("select l_orderkey as page_id, l_linenumber::bigint as chunk_index, l_quantity as content from lineitem where l_orderkey not in (select l_orderkey from lineitem where l_orderkey % 10 = 0) union all select l_orderkey, l_linenumber + 100, l_quantity * 2 from lineitem where l_orderkey % 10 = 0")
def replace_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").cast("long").alias("chunk_index"), F.col("l_quantity").alias("content"))
    new = rows.where("page_id % 10 = 0").select("page_id", (F.col("chunk_index") + 100).alias("chunk_index"), (F.col("content") * 2).alias("content"))
    return index.chunks_replaced(rows, new)


@query("select o_orderkey as page_id, o_orderpriority as source from orders where o_orderpriority <> '1-URGENT'")
def delete_source_pages(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.col("o_orderpriority").alias("source"))
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), "l_linenumber")
    return index.without_source(p, c, "1-URGENT")[0]


@query("select l_orderkey as page_id, count(*) as n from lineitem where l_orderkey in (select o_orderkey from orders where o_orderpriority <> '1-URGENT') group by l_orderkey")
def delete_source_chunks(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.col("o_orderpriority").alias("source"))
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), "l_linenumber")
    return index.without_source(p, c, "1-URGENT")[1].groupBy("page_id").agg(F.count("*").alias("n"))


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def cascade_delete(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return index.cascaded(lines, orders, "l_orderkey", F.col("o_orderstatus") == "F")


@query("select url, case when regexp_matches(url, '(?i)prog[a-z]*\\.') and not regexp_matches(url, '(?i)program') then 'http' else 'browser' end as fetch from (select distinct url from pages where url not in (select url from pages where page_id % 4 = 0) order by url limit 6000)")
def second_pass(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return index.second_pass(p, p.where("page_id % 4 = 0"))


@query("select page_id, url, row_number() over (order by contains(url, 'tionsh'), url, page_id) as place from pages")
def light_first(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return index.light_first(p, "tionsh").select("page_id", "url", F.col("place").cast("long").alias("place"))


@query("select page_id, url from (select page_id, url from pages order by page_id limit 25)")
def incremental_index(spark, sf_dir):
    return index.incremental(table(spark, sf_dir, "pages").select("page_id", "url"), limit=25)


@query("""with t as (select distinct 'https://x.example/' || p || '?curSunit=' || (doc_id % 50) as url from documents, (values ('a.aspx'), ('b.aspx')) v(p)),
s as (select 'https://x.example/a.aspx?curSunit=' || (doc_id % 50) as url, case when doc_id % 3 = 0 then '' else 'x' end as content from documents where doc_id % 50 < 20)
select url, case when url in (select url from s where trim(content) <> '') then 'skipped' else 'to_fetch' end as status from t""")
def backfill_plan(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    shells = d.select(F.concat(F.lit("https://x.example/shell?curSunit="), F.col("doc_id") % 50).alias("url"))
    stored = d.where("doc_id % 50 < 20").select(F.concat(F.lit("https://x.example/a.aspx?curSunit="), F.col("doc_id") % 50).alias("url"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("x").alias("content")).distinct()
    plan = index.backfill(shells, stored, urls.unit_tabs(F.col("url"), ("/a.aspx", "/b.aspx")))
    return plan.distinct()


@query("select event_type as status, count(*) as n from events group by event_type")
def job_counters(spark, sf_dir):
    return index.job_counters(table(spark, sf_dir, "events").withColumnRenamed("event_type", "status"))


@query("select l.doc_id, l.quality, d.lang from labels l join documents d on l.doc_id = d.doc_id where l.toxic = 0")
def denormalised_join(spark, sf_dir):
    return table(spark, sf_dir, "labels").where("toxic = 0").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "quality", "lang")


@query("select d.doc_id, coalesce(l.quality, -1) as quality, l.doc_id is not null as labelled from documents d left join labels l on d.doc_id = l.doc_id")
def left_default(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("labelled"))
    return table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("labelled", F.lit(False)).alias("labelled"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def not_present(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("select doc_id from documents where doc_id in (select doc_id from labels where toxic = 1)")
def id_in(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("""with l(doc_id, src_ord) as (select doc_id, 0 from labels where toxic = 1 union all select doc_id, 1 from labels where quality = 0 union all select doc_id, 2 from documents)
select doc_id, min(src_ord)::bigint as src_ord from l group by doc_id""")
def first_wins_union(spark, sf_dir):
    from corpusloom.operators.retrieval import prepended

    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    one = lambda d: d.select(F.lit(1).alias("query_id"), F.col("doc_id").alias("chunk_id"))
    inner = prepended(one(labels.where("quality = 0")), one(docs)).withColumnRenamed("src_ord", "inner_ord")
    whole = prepended(one(labels.where("toxic = 1")), inner)
    return whole.select(F.col("chunk_id").alias("doc_id"), F.when(F.col("src_ord") == 0, 0).otherwise(F.col("inner_ord") + 1).cast("long").alias("src_ord"))


@query("select distinct url from (select url from pages where page_id % 2 = 0 union select url from pages where page_id % 3 = 0)")
def url_set_union(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.where("page_id % 2 = 0").select("url").union(p.where("page_id % 3 = 0").select("url")).distinct()


@query("with t as (select unnest(['idiot', 'clown', 'license', 'tion']) as term) select term, count(*) as docs from documents, t where contains(lower(text), term) group by term")
def term_join(spark, sf_dir):
    terms = spark.createDataFrame([(t,) for t in ("idiot", "clown", "license", "tion")], "term string")
    d = table(spark, sf_dir, "documents").select(F.lower("text").alias("low"))
    return d.join(F.broadcast(terms), F.contains("low", "term")).groupBy("term").agg(F.count("*").alias("docs"))


@query("select o_orderkey, coalesce(x.s, y.s, 0) as amount from orders left join (select l_orderkey as k, round(sum(l_quantity), 4) as s from lineitem where l_returnflag = 'R' group by 1) x on x.k = o_orderkey left join (select l_orderkey as k, round(-sum(l_quantity), 4) as s from lineitem group by 1) y on y.k = o_orderkey")
def fallback_lookup(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    x = li.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_quantity"), 4).alias("x"))
    y = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(-F.sum("l_quantity"), 4).alias("y"))
    return o.select("o_orderkey").join(x, "o_orderkey", "left").join(y, "o_orderkey", "left").select("o_orderkey", F.coalesce("x", "y", F.lit(0.0)).alias("amount"))


# All documents come first; then every one again, of which a tenth has changed: version 2 stands at their chunks alone.
@query("""with d as (select doc_id, case when doc_id % 10 = 0 then 2 else 1 end::bigint as version, trim(regexp_replace(case when doc_id % 10 = 0 then 'Changed. ' else '' end || coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as c from documents)
select 'd' || doc_id as url, version, i::bigint as chunk_index, trim(c[i * 580 + 1:i * 580 + 700]) as chunk from (select doc_id, version, c, unnest(range(0, (greatest(0, ceil((length(c) - 700) / 580.0)) + 1)::bigint)) as i from d where c <> '') where trim(c[i * 580 + 1:i * 580 + 700]) <> ''""")
def chunks_kept_current(spark, sf_dir):
    root = f"{ready_checkpoints(spark).rstrip('/')}/chunks-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parquet*")
    for version in (1, 2):
        prefix = F.when(F.lit(version == 2) & (F.col("doc_id") % 10 == 0), "Changed. ").otherwise("")
        pages = stream.select(F.concat(F.lit("d"), "doc_id").alias("url"), F.concat(prefix, F.coalesce("text", F.lit(""))).alias("content"), F.lit(version).cast("long").alias("version"))
        upkeep.followed(pages, f"{root}/table", f"{root}/state{version}", chunking.fixed_windows, 16).awaitTermination()
    return upkeep.chunk_rows(spark, f"{root}/table").select("url", "version", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk")
