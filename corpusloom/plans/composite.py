"""Queries of the steps around retrieval. Patterns in their SQL are written out, not taken from the engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import html, questions as q, urls, vectors
from corpusloom.operators import composite, crawl, retrieval
from corpusloom.plans.common import ASKED_SQL, CHUNKS_SQL, SAID_SQL, asked, chunks, questions, questions_sql, registry, said, table
from corpusloom.plans.scalars import SEGMENT, says

QUERIES, query = registry()

_FOLD = "lower(translate({x}, 'ıİşŞğĞüÜöÖçÇâÂîÎ', 'iissgguuooccaaii'))"


@query("""with p as (select url, page_id, length(html)::bigint as size, case when page_id % 3 = 0 then '' else 'old' end as title from pages),
n as (select url, case when page_id % 2 = 0 then 'new ' || page_id else '  ' end as title, page_id from pages where page_id % 5 < 3)
select p.url, p.page_id, size, case when trim(n.title) <> '' then n.title else p.title end as title from p left join n on n.url = p.url""")
def enriched_shells(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    stored = p.select("url", "page_id", F.length("html").cast("long").alias("size"), F.when(F.col("page_id") % 3 == 0, "").otherwise("old").alias("title"))
    found = p.where("page_id % 5 < 3").select("url", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("new "), "page_id")).otherwise("  ").alias("title"))
    return composite.enriched(stored, found, ("title",))


@query(f"with {CHUNKS_SQL} select chunk_id from chunks where source_url not in (select source_url from chunks where chunk_id % 3 = 0) and source_url not in (select source_url from chunks where contains(source_url, '/news/'))")
def skip_urls(spark, sf_dir):
    c = chunks(spark, sf_dir)
    skipped = [c.where(x).select(F.col("source_url").alias("url")) for x in (F.col("chunk_id") % 3 == 0, F.contains("source_url", F.lit("/news/")))]
    return composite.without_urls(c, *skipped).select("chunk_id")


_TABS = "p as (select doc_id as page_id, 'https://o.example.edu/' || case when doc_id % 2 = 0 then 'a/' else 'b/' end || 'Courses.aspx?lang=' || lang || '&curSunit=' || (doc_id % 40) as url, case when doc_id % 3 = 0 then '' else text end as content from documents)"


@query(f"""with {_TABS}, w as (select distinct url from p union select 'https://o.example.edu/c/courses.aspx?x=1&cursunit=' || i as url from range(45) t(i)),
held as (select *, regexp_extract(url, 'curSunit=([0-9]+)', 1) as unit from p where trim(coalesce(content, '')) <> ''),
e as (select url, arg_min(content, page_id) as c from held group by url), a as (select unit, arg_min(content, page_id) as c from held group by unit)
select w.url, md5(coalesce(e.c, a.c, '')) as text from w left join e using (url) left join a on a.unit = regexp_extract(w.url, '(?i)curSunit=([0-9]+)', 1)""")
def tab_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://o.example.edu/"), F.when(F.col("doc_id") % 2 == 0, "a/").otherwise("b/"), F.lit("Courses.aspx?lang="), "lang", F.lit("&curSunit="), (F.col("doc_id") % 40).cast("string"))
    p = d.select(F.col("doc_id").alias("page_id"), url.alias("url"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text")).alias("content"))
    more = spark.range(45).select(F.concat(F.lit("https://o.example.edu/c/courses.aspx?x=1&cursunit="), "id").alias("url"))
    return composite.page_texts(p.select("url").union(more).distinct(), p).select("url", F.md5(F.col("text").cast("binary")).alias("text"))


@query("""with s as (select lang, doc_id, (doc_id % 7 - 3) * case when lang = 'de' then 0 else 1 end as score from documents)
select lang as query_id, doc_id as chunk_id, round(score / coalesce(nullif(max(abs(score)) over (partition by lang), 0), 1), 6) + 0.0 as scaled from s""")
def scaled_scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("chunk_id"), ((F.col("doc_id") % 7 - 3) * F.when(F.col("lang") == "de", 0).otherwise(1)).alias("score"))
    return composite.scaled_scores(rows, "score", "scaled").select("query_id", "chunk_id", (F.round("scaled", 6) + 0.0).alias("scaled"))


@query("""with r as (select lang || doc_id % 11 as query_id, doc_id as rank, case when doc_id % 4 = 0 then null else 'u' || doc_id % 3 end as unit from documents),
f as (select query_id, arg_min(unit, rank) as pin from r where unit is not null group by query_id)
select query_id, rank as chunk_id, unit from r left join f using (query_id) where unit is null or unit = pin""")
def pinned_units(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.concat("lang", F.col("doc_id") % 11).alias("query_id"), F.col("doc_id").alias("rank"), F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("u"), F.col("doc_id") % 3)).alias("unit"))
    return composite.one_unit(rows, F.col("unit")).select("query_id", F.col("rank").alias("chunk_id"), "unit")


@query("""with b as (select page_id, url, case when contains(lower(url), 'contact-details') then 0 when contains(lower(url), '/en/') then 1 when regexp_matches(lower(url), '/de/|/fr/') then 2 else 90 end as bucket from pages)
select page_id, url, bucket::bigint as bucket, place from (select *, row_number() over (order by bucket, length(url), url, page_id) as place from b) where place <= 12""")
def page_buckets(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    found = composite.bucketed(p, (("url", "contact-details"), ("url", "/en/"), ("url", "/de/|/fr/")), 12)
    return found.select("page_id", "url", F.col("bucket").cast("long").alias("bucket"), F.col("place").cast("long").alias("place"))


@query("""select page_id, contains(url, '/en/') or contains(url, 'casino') as both_, contains(url, '/en/') as one, false as none from pages""")
def optional_predicates(spark, sf_dir):
    en, casino = F.contains("url", F.lit("/en/")), F.contains("url", F.lit("casino"))
    pick = lambda a, b: composite.any_of((a, en), (b, casino))
    return table(spark, sf_dir, "pages").select("page_id", pick(True, True).alias("both_"), pick(True, False).alias("one"), pick(False, False).alias("none"))


@query("""with t(i, c) as (values (0, 'text/html; charset=utf-8'), (1, 'APPLICATION/XHTML+XML'), (2, 'application/pdf'), (3, null))
select page_id, i in (0, 1) as is_page from pages join t on i = page_id % 4""")
def content_types(spark, sf_dir):
    kinds = F.array(F.lit("text/html; charset=utf-8"), F.lit("APPLICATION/XHTML+XML"), F.lit("application/pdf"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", crawl.is_page(F.get(kinds, (F.col("page_id") % 4).cast("int"))).alias("is_page"))


@query(f"""with s as (select page_id, '<a href="/catalogue/progAbout.aspx?curSunit=' || page_id || '&amp;lang=en">x</a> onclick="open(''index.aspx?a=1'')" <a href="https://www.courses.example.edu/catalogue/showPac.aspx?u=' || page_id || '#top">y</a> program.aspx?z=1 https://other.org/catalogue/x.aspx?b=2 ' || html as h from pages)
select page_id, 'https://courses.example.edu/catalogue/index.aspx?a=1' as url, false as is_detail from s union all
select page_id, 'https://courses.example.edu/catalogue/progAbout.aspx?curSunit=' || page_id || '&lang=en', false from s union all
select page_id, 'https://www.courses.example.edu/catalogue/showPac.aspx?u=' || page_id, true from s""")
def mined_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    source = F.concat(F.lit('<a href="/catalogue/progAbout.aspx?curSunit='), "page_id", F.lit('&amp;lang=en">x</a> onclick="open(\'index.aspx?a=1\')" <a href="https://www.courses.example.edu/catalogue/showPac.aspx?u='), "page_id", F.lit('#top">y</a> program.aspx?z=1 https://other.org/catalogue/x.aspx?b=2 '), "html")
    found = urls.mined(source, F.col("url"), "courses.example.edu", "/catalogue/")
    return p.select("page_id", F.explode(found).alias("x")).select("page_id", "x.url", "x.is_detail")


@query("""with m as (select page_id, unnest(list_filter(regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1), lambda h: not regexp_matches(h, '(?i)^\\s*(mailto:|tel:|javascript:)'))) as label from pages)
select page_id, label from m where not contains(lower(label), 'login') and not contains(lower(label), '/p1')""")
def kept_links(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(html.links(F.col("html"))).alias("label"))
    return rows.where(~urls.skipped_label(F.col("label"), ("login", "/p1")))


@query(f"""with {CHUNKS_SQL}, {questions_sql()}, c as (select chunk_id, lower(source_url || chr(10) || page_title || chr(10) || content) as whole, lower(source_url || chr(10) || page_title) as head, lower(page_title || chr(10) || content) as body from chunks),
i as (select query_id, regexp_matches({_FOLD.format(x="coalesce(question, '')")}, '\\b(price|prices|fee|fees|tuition|ucret|ucreti|ucretler|scholarship|burs|how\\s+much|what\\s+.*\\s+cost|costs?|annual|yillik|ogrenim|payment|odeme)\\b') as fee,
  regexp_matches({_FOLD.format(x="coalesce(question, '')")}, '\\bscholar(ship|ships)?\\b|\\bburs(lar[ıi]?)?\\b') as scholarship, query_id in (4, 5) as undergraduate from questions)
select query_id, chunk_id from i join c on query_id = chunk_id % 16 + 1 where (not fee or regexp_matches(head, 'fee|ucret|tuition|ogrenim|burs|scholarship|financial|pricing')
    or regexp_matches(body, 'tuition|ucret|ogrenim|program\\s+fee|annual\\s+fee|\\busd\\b|\\btry\\b|₺|\\$\\s*[\\d,\\.]+|vat|kdv|yillik|taksit|per\\s+year|/year|scholarship|burs|financial\\s+aid|odeme|payment\\s+plan|pesin'))
  and (not scholarship or regexp_matches(whole, '\\bscholar(ship|ships)?\\b|\\bburs(lari?)?\\b|discount|indirim|financial\\s+aid'))
  and (not undergraduate or not regexp_matches(head, 'graduate|post-?grad|yuksek\\s*lisans|master[’''s]?\\s*program|phd|doktora|\\btez\\b|mba\\s*admission'))""")
def grounded_candidates(spark, sf_dir):
    """Every chunk is a candidate of one question."""
    pairs = chunks(spark, sf_dir).withColumn("query_id", F.col("chunk_id") % 16 + 1).join(questions(spark), "query_id")
    return composite.grounded(pairs).select("query_id", "chunk_id")


@query(f"""with {questions_sql()}, d as (select query_id, doc_id as chunk_id, doc_id % 4 as l from questions, documents where doc_id % 16 + 1 = query_id),
f as (select *, case l when 0 then 0 when 1 then 1 when 2 then 5 else 6 end as src_ord from d),
a as (select query_id, chunk_id, src_ord from f where src_ord <> 1 or query_id in (1)),
b as (select * from a where src_ord <> 6 or query_id not in (1, 7, 12))
select query_id, chunk_id, min(src_ord)::bigint as src_ord from b group by all""")
def list_order(spark, sf_dir):
    asked_, d = questions(spark), table(spark, sf_dir, "documents")
    rows = asked_.join(d.select((F.col("doc_id") % 16 + 1).alias("query_id"), F.col("doc_id").alias("chunk_id")), "query_id").select("query_id", "chunk_id")
    lists = {name: rows.where(F.col("chunk_id") % 4 == n) for n, name in enumerate(("person", "roster", "vector", "keyword"))}
    return composite.candidate_lists(asked_, lists).select("query_id", "chunk_id", F.col("src_ord").cast("long").alias("src_ord"))


@query(f"""with {SAID_SQL}, s as (select *, {SEGMENT} as segment, {says("fee")} as fee, {says("scholarship")} as scholarship, contains(padded, ' payment ') as payment from said)
select conv_id, turn, case segment when 'computer-engineering' then 'bilgisayar muhendisligi|computer engineering|muhendisligi bolum|bolum bilgisayar' when 'faculty-of-medicine' then 'faculty of medicine|doctor of medicine|medical school|tip fakultesi|hekimlik'
  when 'computer-programming' then 'bilgisayar programciligi|computer programming|computer programmer|programming' when 'faculty-of-health-sciences' then 'faculty of health sciences|saglik bilimleri fakultesi|health sciences faculty|saglik bilimleri|health sciences'
  when 'electrical' then 'electronics|electrical|elektronik|elektrik' when 'mechanical' then 'mechanical|makine' when 'civil' then 'mimarlik insaat|insaat|civil' when 'software' then 'yazilim m|software|yazilim' end as department,
  nullif(array_to_string(case when fee and scholarship then ['Scholarship', 'Scholarships', 'Tuition Fees and Scholarships', 'Burs', 'Burslar', 'Ücret ve Burs', 'Öğrenim Ücretleri ve Burslar'] else [] end
    || case when fee and payment then ['Payment', 'Ödeme', 'Taksit', 'Payment Plan'] else [] end, '|'), '') as fee from s""")
def snippet_anchors(spark, sf_dir):
    joined = lambda c: F.expr(f"nullif(array_join({c}, '|'), '')")
    rows = said(spark, sf_dir).select("conv_id", "turn", q.department_anchors(F.col("question")).alias("d"), q.fee_anchors(F.col("question")).alias("f"))
    # the label of the path equals one of its names but for the case of letters
    return rows.select("conv_id", "turn", joined("transform(d, x -> lower(x))").alias("department"), joined("f").alias("fee"))


@query("""with c as (select doc_id, 'Course anchor: C' || doc_id || '. ' || chr(10) || 'ECTS value: ' || case when doc_id % 3 = 0 then 'NOT FOUND IN EXCERPT' else (doc_id % 9)::varchar end || chr(10) || 'Unit row (if available): row ' || doc_id as c,
  case when doc_id % 5 = 0 then 'what is it' else 'ECTS of it?' end as question from documents)
select doc_id, case when question = 'ECTS of it?' then 'C' || doc_id end as course, case when question = 'ECTS of it?' then case when doc_id % 3 = 0 then 'not_found' else 'ok' end end as status,
  case when question = 'ECTS of it?' then 'row ' || doc_id end as row from c""")
def direct_answers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    value = F.when(F.col("doc_id") % 3 == 0, "NOT FOUND IN EXCERPT").otherwise((F.col("doc_id") % 9).cast("string"))
    context = F.concat(F.lit("Course anchor: C"), "doc_id", F.lit(". \nECTS value: "), value, F.lit("\nUnit row (if available): row "), "doc_id")
    answer = q.direct_answer(F.when(F.col("doc_id") % 5 == 0, "what is it").otherwise("ECTS of it?"), context)
    return d.select("doc_id", answer.alias("a")).select("doc_id", "a.course", "a.status", "a.row")


@query("""with w as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}')) as w from documents), b as (select doc_id, ('0x' || md5(w)[1:7])::bigint % 64 as bucket, count(*)::double as n from w group by all),
s as (select *, sqrt(sum(n * n) over (partition by doc_id)) as norm from b) select d.doc_id, bucket, round(n / norm, 6) as weight from documents d left join s using (doc_id)""")
def embedded_once(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = composite.embedded_once(d, "text", composite.embedder("hashing", vectors.hashing_model))
    cells = F.filter(F.transform("embedding", lambda v, i: F.struct(i.cast("long").alias("bucket"), F.round(v, 6).alias("weight"), v.alias("v"))), lambda c: c["v"] > 0)
    return rows.select("doc_id", F.explode_outer(cells).alias("c")).select("doc_id", "c.bucket", "c.weight")


@query(f"""with {CHUNKS_SQL}, {ASKED_SQL}, q as (select query_id, list_distinct(regexp_extract_all(lower(question), '[a-zğüşıöç]{{4,}}')) as terms from asked), t as (select query_id, unnest(terms) as w from q),
c as (select chunk_id, lower(content) as c, lower(page_title) as t, lower(source_url) as u, content[1:700] as snippet from chunks where not contains(source_url, '/news/')),
sc as (select query_id, chunk_id, sum((case when contains(c, w) then 1 else 0 end) + (case when contains(c.t, w) then 2 else 0 end) + (case when contains(u, w) then 2 else 0 end))::bigint as score from t, c group by all),
f as (select * from (select *, row_number() over (partition by query_id order by chunk_id) as n from sc where score > 0) where n <= 60)
select query_id, count(*) as found from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from f) where rank <= 12 group by query_id""")
def page_fallback_ranks(spark, sf_dir):
    return retrieval.lexical(asked(spark, sf_dir), chunks(spark, sf_dir), top=12).groupBy("query_id").agg(F.count("*").alias("found"))


@query()
def page_fallback(spark, sf_dir):
    pages = chunks(spark, sf_dir).select("page_id", F.col("source_url").alias("url"), F.col("page_title").alias("title"), "content", "chunk_id").withColumn("page_id", F.col("chunk_id"))
    return composite.page_fallback(asked(spark, sf_dir), pages).select("query_id", "context_chars", "chunks_used", "distance")


@query()
def chosen_snippets(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("chunk_index", F.lit(0))
    q_ = asked(spark, sf_dir)
    rows = retrieval.full_text(q_, c, 5).join(c, "chunk_id").join(q_, "query_id").withColumn("name", F.lit(None).cast("string")).withColumnRenamed("place", "rank_").drop("rank").withColumnRenamed("rank_", "rank")
    found = composite.with_snippets(rows, retrieval.merged_tabs(c))
    return found.select("query_id", "chunk_id", F.length("snippet").cast("long").alias("n_chars"))


@query()
def question_variants(spark, sf_dir):
    rows = said(spark, sf_dir).withColumn("name", q.person(F.col("question")))  # a step of its own: no Python inside array functions
    variants = q.query_variants(q.composed(F.col("question"), F.array().cast("array<string>")), F.col("name"))
    return rows.select("conv_id", "turn", F.posexplode(variants).alias("variant", "question"))
