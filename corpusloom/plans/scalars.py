"""Queries over text, URL, HTML, rule and vector scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import chunking, html, questions as q, rules, text, urls, vectors
from corpusloom.plans.common import SAID_SQL, fold_sql, registry, said, table

QUERIES, query = registry()


@query(f"""select doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as collapsed, {fold_sql("text")} as folded,
  regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g') as short_newlines from documents""")
def text_normalisation(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.collapse(F.col("text")).alias("collapsed"), text.fold(F.col("text")).alias("folded"), text.short_newlines(F.col("text")).alias("short_newlines"))


@query("""select doc_id, case when length(trim(text)) <= 300 then trim(text) else trim(text)[1:299] || '…' end as trimmed,
  trim(text)[1:197] || case when length(trim(text)) > 200 then '…' else '' end as title, md5(text) as key,
  strpos(text, 'the') as first_the from documents""")
def text_trimming(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = F.col("text")
    return d.select("doc_id", text.trimmed(t, 300).alias("trimmed"), text.session_title(t).alias("title"), F.md5(t.cast("binary")).alias("key"), F.instr(t, "the").cast("long").alias("first_the"))


_SNIPPET_AT = f"strpos({fold_sql('t')}, 'tion')"


@query(f"""with d as (select doc_id, coalesce(text, '') as t from documents), h as (select *, {_SNIPPET_AT} - 1 as i, least(200, length(t)) as size from d)
select doc_id, case when i < 0 then t[1:size] else substr(t, (greatest(0, least(i + 2 - size // 2, length(t) - size)) + 1)::bigint, size) end as snippet from h""")
def snippet_around_phrase(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text"), F.lit("tion"), 200).alias("snippet"))


_STOP = ", ".join(f"'{w}'" for w in text.KEYWORD_STOP)


@query(f"""with {SAID_SQL}, w as (select conv_id, turn, unnest(ws) as w, generate_subscripts(ws, 1) as i from (select conv_id, turn, regexp_extract_all(lower(replace(question, 'İ', 'i')), '[a-zğüşıöç]{{4,}}') as ws from said)),
f as (select conv_id, turn, w, min(i) as i from w where w not in ({_STOP}) group by all), n as (select *, row_number() over (partition by conv_id, turn order by i) as n from f)
select s.conv_id, s.turn, coalesce(string_agg(w, ' ' order by i), '') as keywords from said s left join n on n.conv_id = s.conv_id and n.turn = s.turn and n <= 5 group by s.conv_id, s.turn""")
def keyword_extraction(spark, sf_dir):
    return said(spark, sf_dir).select("conv_id", "turn", F.array_join(text.keywords(F.col("question")), " ").alias("keywords"))


@query("""with q as (select unnest(['that', 'tion', 'ing ', 'heit']) as term), c as (select doc_id, count(*) as n from documents, q where contains(lower(text), term) group by doc_id)
select doc_id, coalesce(n, 0)::bigint as overlap from documents left join c using (doc_id)""")
def token_overlap(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.overlap(F.col("text"), F.array(*map(F.lit, ("that", "tion", "ing ", "heit")))).alias("overlap"))


def _trigrams_sql(x: str) -> str:
    ws = f"list_distinct(list_filter(string_split(regexp_replace({fold_sql(x)}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''))"
    return f"list_distinct(flatten(list_transform({ws}, lambda w: list_transform(range(1, length(w) + 2), lambda i: ('  ' || w || ' ')[i:i + 2]))))"


@query(f"""with q as (select {_trigrams_sql("'The nation and the station are on the way'")} as b), d as (select doc_id, {_trigrams_sql("text")} as a from documents)
select doc_id, round(case when len(list_distinct(list_concat(a, b))) > 0 then len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) else 0 end, 6) as similarity from d, q""")
def trigram_similarity(spark, sf_dir):
    b = text.trigrams(F.lit("The nation and the station are on the way"))
    return table(spark, sf_dir, "documents").withColumn("a", text.trigrams(F.col("text"))).select("doc_id", F.round(text.trigram_similarity(F.col("a"), b), 6).alias("similarity"))


@query("""with t as (select unnest(['the', 'tion', 'der']) as w), d as (select doc_id, lower(text[61:]) as c, lower(text[1:60]) as t from documents)
select doc_id, round(sum(least((length(c) - length(replace(c, w, '')))::double / length(w), 4) / 4 + case when contains(d.t, w) then 0.4 else 0 end) / 3, 6) as rank from d, t group by doc_id""")
def full_text_rank(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    terms = F.array(*map(F.lit, ("the", "tion", "der")))
    return d.select("doc_id", F.round(text.rank_any(F.expr("substring(text, 61)"), F.substring("text", 1, 60), terms), 6).alias("rank"))


@query("""select doc_id, not regexp_matches(text, '[çğıöşüÇĞİÖŞÜ]') and regexp_matches(text, '[A-Za-z]') as english_only,
  length(trim(text)) >= 80 and len(list_filter([' ve ', ' için ', ' ile ', ' olarak ', ' veya ', ' değil ', ' bu ', ' şu ', ' bir '], lambda w: contains(' ' || lower(trim(text)) || ' ', w))) >= 2 as turkish from documents""")
def language_detectors(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.english_only(F.col("text")).alias("english_only"), text.probably_turkish(F.col("text")).alias("turkish"))


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '')"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_BLOCKED = " or ".join(f"contains(lower(trim(url)), '{b}')" for b in urls.BLOCKED)


@query(f"""select page_id, {_HOST} as host, {_PATH} as path, regexp_matches({_PATH}, '(?i)^/en(/.*)?$') as english, {_BLOCKED} as blocked,
  ends_with({_HOST}, '.example.com') or {_HOST} = 'example.com' as same_site,
  lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || {_HOST} || {_PATH} || regexp_extract(regexp_replace(url, '#.*$', ''), '^[^?#]*(\\?[^#]*)', 1) as normalized,
  case when regexp_matches(url, '(?i)[?&]ref=') then regexp_extract(url, '(?i)[?&]ref=([^&#]*)', 1) end as ref from pages""")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.host(u).alias("host"), urls.path(u).alias("path"), urls.english_path(urls.path(u)).alias("english"), urls.blocked(u).alias("blocked"),
        urls.same_site(u, ("example.com",)).alias("same_site"), urls.normalized(u).alias("normalized"), urls.parameter(u, "ref").alias("ref"),
    )


_UNIT_PAGES = """v as (select page_id, url || case when contains(url, '?') then '&' else '?' end || case page_id % 4 when 0 then 'lang=en&curSunit=' || page_id when 1 then 'curop=showPac&cursunit=' || page_id when 2 then 'lang=tr' else 'curOp=showPac&curUnit=3&curSunit=x' || page_id end as address from (select page_id, regexp_replace(url, '#.*$', '') as url from pages))"""


def _unit_addresses(spark, sf_dir):
    """Addresses of the pages with parameters of a course catalogue behind."""
    p = table(spark, sf_dir, "pages").select("page_id", urls.without_fragment(F.col("url")).alias("url"))
    i, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    tail = F.when(i == 0, F.concat(F.lit("lang=en&curSunit="), n)).when(i == 1, F.concat(F.lit("curop=showPac&cursunit="), n)).when(i == 2, "lang=tr").otherwise(F.concat(F.lit("curOp=showPac&curUnit=3&curSunit=x"), n))
    return p.select("page_id", F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), tail).alias("address"))


@query(f"""with {_UNIT_PAGES} select page_id, case page_id % 4 when 2 then null when 3 then 'x' || page_id else page_id::varchar end as unit, page_id % 4 <> 2 as preferred,
  case when page_id % 4 < 2 then regexp_extract(address, '^[a-z]+://[^/?#]*') || '/courses.aspx?curSunit=' || page_id || ' ' || regexp_extract(address, '^[a-z]+://[^/?#]*') || '/about.aspx?curSunit=' || page_id else '' end as tabs from v""")
def catalogue_urls(spark, sf_dir):
    u = F.col("address")
    return _unit_addresses(spark, sf_dir).select("page_id", urls.parameter(u, "curSunit").alias("unit"), urls.preferred_language(u, "en").alias("preferred"), F.array_join(urls.unit_tabs(u, ("/courses.aspx", "/about.aspx")), " ").alias("tabs"))


# Every programme has eighteen tabs; the SQL names the first and the last of them and counts the rest.
@query(f"""with {_UNIT_PAGES} select page_id, case when page_id % 4 = 1 then 18 else 0 end::bigint as n_tabs,
  case when page_id % 4 = 1 then regexp_extract(address, '^[a-z]+://[^/?#]*') || '/oibs/bologna/progAbout.aspx?lang=en&curSunit=' || page_id end as first_tab,
  case when page_id % 4 = 1 then regexp_extract(address, '^[a-z]+://[^/?#]*') || '/oibs/bologna/progContact.aspx?lang=en&curSunit=' || page_id end as last_tab from v""")
def programme_tabs(spark, sf_dir):
    rows = _unit_addresses(spark, sf_dir).withColumn("tabs", urls.programme_tabs(F.col("address"), "/oibs/bologna/"))
    at = lambda i: F.try_element_at("tabs", F.lit(i))
    return rows.select("page_id", F.size("tabs").cast("long").alias("n_tabs"), at(1).alias("first_tab"), at(-1).alias("last_tab"))


_ENT = "x"
for _a, _b in html.ENTITIES:
    _ENT = f"replace({_ENT}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"


@query(f"""select page_id, trim({_ENT.replace('x,', "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1),", 1)})[1:500] as title,
  len(regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1))::bigint as n_links from pages""")
def html_titles(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    found = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return p.select("page_id", html.title(F.col("html")).alias("title"), F.size(found).cast("long").alias("n_links"))


@query()
def html_pages(spark, sf_dir):
    p = html.pages_from(table(spark, sf_dir, "pages"))
    return p.select("page_id", "title", F.length("content").cast("long").alias("n_chars"), F.size("embedding_units").cast("long").alias("n_units"), F.array_join("embedding_units", "|").alias("units"))


@query("""with d as (select doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as c from documents)
select doc_id, i::bigint as chunk_index, trim(c[i * 580 + 1:i * 580 + 700]) as chunk from (select doc_id, c, unnest(range(0, (greatest(0, ceil((length(c) - 700) / 580.0)) + 1)::bigint)) as i from d where c <> '') where trim(c[i * 580 + 1:i * 580 + 700]) <> ''""")
def fixed_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(chunking.fixed_windows(F.col("text"))).alias("chunk_index", "chunk")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query()
def page_chunks(spark, sf_dir):
    c = chunking.page_chunks(html.pages_from(table(spark, sf_dir, "pages")))
    return c.select("page_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5(F.col("content").cast("binary")).alias("key"), F.length("content").cast("long").alias("n_chars"))


# What is said for each intent: words of the questions, and parts of words that may stand in any text. A blank is the edge of a word.
_SAYS = {
    "department": ("depart", "faculty", "faculties", "fakult", "bolum", "school ", "schools ", "muhendis", "yuksekokul", "anabilim"),
    "stem": (" computer ", "software", "electrical", "mechanical", "civil", "chemical", "industrial", "biomedical", " engineering ", " engineer ", "programming", "bilgisayar", "yazilim", "elektrik", "makine", "insaat"),
    "location": (" where is ", " location ", " address ", " contact ", " reach ", " transport ", " nerede ", " konum ", " adres ", " iletisim ", " ulasim "),
    "catalogue": (" course ", " courses ", " curriculum ", " lesson ", " lessons ", " module ", " modules ", " ects ", " ders ", " dersler ", " mufredat ", " akts "),
    "roster": (" teacher ", " teachers ", " prof ", " faculty ", " professor ", " professors ", " lecturer ", "ogretim", " hocalar"),
    "leadership": (" dean ", " deans ", " dekan ", " rector ", " rektor ", " provost "),
    "fee": (" price ", " prices ", " fee ", " fees ", " tuition ", " ucret ", " ucreti ", " ucretler ", " scholarship ", " burs ", " how much ", " cost ", " costs ", " annual ", " payment "),
    "broad_fee": (" all ", " every ", " tum ", " butun ", " hepsi ", " ucret listesi ", " fee list "),
    "graduate": (" graduate ", " postgraduate ", " mba ", " ma ", " msc ", " phd ", " doktora ", " tez "),
    "scholarship": (" scholar ", " scholarship ", " scholarships ", " burs ", " burslar "),
    "curriculum": (" lesson ", " lessons ", " course ", " courses ", "curriculum", "module", " ects ", "syllabus", "mufredat", "ders", " semester ", " donem "),
    "multi_shell": (" compare ", " comparison ", " vs ", " versus ", " difference ", " fark ", " both track ", " both tracks "),
    "first_year": ("first year", "freshman", " 1st year ", "year 1 ", "birinci sinif"),
    "department_leader": ("head", "chair", "director", "dean", "baskan", "dekan", "mudur"),
    "overview": (" everything ", " write all ", " overview ", " summary ", " summarize "),
    "abroad": (" international ", " foreign ", " overseas ", " yabanci "),
    "apply": (" apply ", " application ", " admission ", " admissions ", " requirement ", " requirements ", " eligible ", " criteria "),
    "documents": (" document ", " documents "),
    "price": (" tuition ", " fee ", " fees ", " how much ", " price ", " cost ", " payment ", " ucret "),
    "needs": (" requirement ", " requirements ", " diploma ", " exam ", " exams ", " test ", " tests ", " score ", " scores ", " sat ", " act ", " ap "),
}


def says(name: str) -> str:
    words = ", ".join(f"'{w}'" for w in _SAYS[name])
    return f"len(list_filter([{words}], lambda w: contains(padded, w))) > 0"


_INTERNATIONAL = f"({says('abroad')} and ({says('apply')} or {says('documents')}) and not ({says('price')} and not {says('apply')}))"


@query(f"with {SAID_SQL} select conv_id, turn, " + ", ".join(f"{says(n)} as {n}" for n in rules.INTENTS) + " from said")
def intents(spark, sf_dir):
    return said(spark, sf_dir).select("conv_id", "turn", *[rules.intent(F.col("question"), n).alias(n) for n in rules.INTENTS])


_ENTITY = """case when contains(low, 'computer programming') then 'computer-programming' when contains(low, 'computer engineering') or contains(low, 'bilgisayar muhendisligi') then 'computer-engineering'
  when contains(low, 'health sciences') then 'faculty-of-health-sciences' when contains(low, 'medical school') then 'faculty-of-medicine' end"""
# The eleventh question and the one about a person off the topic are so only in short messages; greetings and thanks only alone.
_GATE = """case when alone and k in (9, 13, 22) then 'small_talk' when k in (10, 23) and length(trim(question)) <= 300 then 'off_topic' else 'retrieve' end"""


@query(f"""with {SAID_SQL} select conv_id, turn, {_ENTITY} as entity, {_INTERNATIONAL} as international, {_INTERNATIONAL} and {says("needs")} as requirements,
  {_INTERNATIONAL} and not {says("graduate")} as undergraduate_only, {_GATE} as gate from said""")
def entities_and_gates(spark, sf_dir):
    c = F.col("question")
    i = lambda n: rules.intent(c, n).alias(n)
    return said(spark, sf_dir).select("conv_id", "turn", rules.entity(c).alias("entity"), i("international"), i("requirements"), i("undergraduate_only"), rules.gate(c).alias("gate"))


SEGMENT = f"""coalesce({_ENTITY}, case when contains(padded, ' medicine ') and {says("price")} then 'faculty-of-medicine' when contains(low, 'programming') then 'computer-programming' when contains(low, 'electrical') or contains(low, 'elektr') then 'electrical'
  when contains(low, 'mechanical') or contains(low, 'makine') then 'mechanical' when contains(low, 'civil') or contains(low, 'insaat') then 'civil' when contains(low, 'industrial') then 'industrial' when contains(low, 'biomedical') then 'biomedical' when contains(low, 'software') or contains(low, 'yazilim') then 'software' end)"""
_STEM = f"""case when not {says("stem")} then '' when contains(low, 'computer programming') then 'computer programming|bilgisayar programciligi|associate degree|on lisans'
  when k in (0, 6) then 'bilgisayar muhendisligi|computer engineering' when k = 11 then 'electrical|elektrik|electronics|elektronik' when k = 17 then 'civil|insaat' when k = 19 then 'bilgisayar muhendisligi|computer engineering' when k = 25 then 'mechanical|makine'
  else 'muhendisligi|engineering|faculty of engineering|muhendislik' end"""


@query(f"""with {SAID_SQL} select conv_id, turn, {SEGMENT} as segment, {_STEM} as stem_terms, {says("fee")} and ({says("broad_fee")} or {SEGMENT} is null) as wide_fee, case k when 5 then 4 end::bigint as semester from said""")
def question_paths(spark, sf_dir):
    c = F.col("question")
    return said(spark, sf_dir).select("conv_id", "turn", rules.path_segment(c).alias("segment"), F.array_join(rules.stem_terms(c), "|").alias("stem_terms"), rules.intent(c, "wide_fee").alias("wide_fee"), text.semester(c).cast("long").alias("semester"))


@query(f"""with {SAID_SQL} select conv_id, turn, case when trim(question) = '' then '' else trim(question) || chr(10) || 'Example University' || coalesce(chr(10) || case
  when {says("location")} then 'campus address contact communication and transportation' when {says("catalogue")} then 'course catalogue curriculum program structure ECTS courses'
  when {_INTERNATIONAL} and {says("needs")} then 'international students application requirements diploma exam scores' when {_INTERNATIONAL} then 'international students admission application how to apply deadlines'
  when {says("fee")} and ({says("broad_fee")} or {SEGMENT} is null) then 'tuition fees of all programs academic year fee schedule' when {says("fee")} then 'tuition fee scholarship payment of the department'
  when {says("roster")} then 'department academic staff list faculty members professors' when {says("leadership")} then 'faculty deans rector leadership management board'
  when {says("stem")} then 'faculty of engineering departments' when {says("department")} then 'faculties departments schools programs' end, '') end as composed from said""")
def composed_questions(spark, sf_dir):
    return said(spark, sf_dir).select("conv_id", "turn", q.composed(F.col("question"), F.array().cast("array<string>")).alias("composed"))


# A person's name ends at the question mark behind it, a course's at the end of the question.
@query(f"""with {SAID_SQL} select conv_id, turn, case k when 18 then 'Jane Doe' end as person,
  case when k = 5 then lower(regexp_replace(regexp_replace(array_to_string(list_filter(string_split_regex(question, '[ \\n\\t]+'), lambda w: w <> ''), ' ')[21:], '[ ?.!]+$', ''), ' (course|lesson|class)$', '')) end as course from said""")
def question_details(spark, sf_dir):
    c = F.col("question")
    return said(spark, sf_dir).select("conv_id", "turn", q.person(c).alias("person"), q.course(c).alias("course"))


# Rows of a course table made of a document's first word and its length; what they are worth follows from the form.
@query("""select doc_id, case doc_id % 4 when 3 then 7 else n_chars % 30 end::int as ects from documents""")
def ects_of_rows(spark, sf_dir):
    d, word, n, i = table(spark, sf_dir, "documents"), F.regexp_extract(F.coalesce("text", F.lit("")), r"^(\p{L}*)", 1), F.col("n_chars") % 30, F.col("doc_id") % 4
    row = (
        F.when(i == 0, F.concat(F.lit("CSE 220 "), word, F.lit(" 3+0+0 Compulsory "), n, F.lit(" Face To Face"))).when(i == 1, F.concat(F.lit("CSE 101 "), word, F.lit("\n4 + 0 + 0  Elective  "), n, F.lit(" 12 weeks")))
        .when(i == 2, F.concat(F.lit("MED 300 "), word, F.lit(" 2+2+2 "), n, F.lit(" hours"))).otherwise(F.concat(word, F.lit(" 2019 4+0+2 7")))
    )
    return d.select("doc_id", text.ects_of_row(row).alias("ects"))


@query(f"""select doc_id, regexp_matches({fold_sql("coalesce(text, '')")}, 'tuition|ucret|ogrenim|program\\s+fee|annual\\s+fee|\\busd\\b|\\btry\\b|₺|\\$\\s*[\\d,\\.]+|vat|kdv|yillik|taksit|per\\s+year|/year|scholarship|burs|financial\\s+aid|odeme|payment\\s+plan|pesin') as fee, contains({fold_sql("text")}, 'idiot') as folded_hit,
  contains({fold_sql("text")}, 'the') and contains({fold_sql("text")}, 'and') and contains({fold_sql("text")}, 'ing') as all_terms, contains(lower(text), 'tion') or contains(lower(text), 'heit') as any_term, not contains(lower(text), 'que') as excluded from documents""")
def text_predicates(spark, sf_dir):
    t = F.col("text")
    has = lambda w: text.contains_folded(t, w)
    low = F.lower(t)
    return table(spark, sf_dir, "documents").select(
        "doc_id", rules.has(t, rules.FEE_EVIDENCE).alias("fee"), has("idiot").alias("folded_hit"), (has("the") & has("and") & has("ing")).alias("all_terms"),
        (F.contains(low, F.lit("tion")) | F.contains(low, F.lit("heit"))).alias("any_term"), (~F.contains(low, F.lit("que"))).alias("excluded"),
    )


@query("""select a.vec_id, round(1 - list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))), 6) + 0.0 as distance,
  round(sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])), 6) as norm from embeddings a, (select embedding from embeddings where vec_id = 0) b""")
def cosine_distances(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    first = e.where("vec_id = 0").select(F.col("embedding").alias("b"))
    return e.join(F.broadcast(first), F.lit(True)).select("vec_id", (F.round(vectors.cosine_distance(F.col("embedding"), F.col("b")), 6) + 0.0).alias("distance"), F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@query("""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) as w from documents), b as (select doc_id, ('0x' || md5(w)[1:7])::bigint % 64 as bucket, count(*)::double as n from w group by all),
s as (select *, sqrt(sum(n * n) over (partition by doc_id)) as norm from b) select doc_id, bucket, round(n / norm, 6) as weight from s""")
def hashed_embeddings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(vectors.hashed_embedding(F.col("text"))).alias("bucket", "weight"))
    return d.where("weight > 0").select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.round("weight", 6).alias("weight"))


@query("""select doc_id, greatest(20, least(500, n_chars))::bigint as clamped, least(0.07, 0.02 * (n_chars % 6)) as bonus, round(n_chars / 7.0, 4) as rounded, case when n_chars > 0 then round(length(regexp_replace(text, '[^A-Z]', '', 'g')) / n_chars::double, 5) else 0 end as upper_share from documents""")
def scalar_math(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.greatest(F.lit(20), F.least(F.lit(500), n)).cast("long").alias("clamped"), F.least(F.lit(0.07), 0.02 * (n % 6)).alias("bonus"), F.round(n / 7.0, 4).alias("rounded"),
        F.when(n > 0, F.round(F.regexp_count("text", F.lit("[A-Z]")) / n, 5)).otherwise(F.lit(0.0)).alias("upper_share"),
    )


