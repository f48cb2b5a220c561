"""From candidates to one context for each question: lists in their order, snippets, and the fold that fills a budget.

Questions are rows; their candidates, page blocks and course tabs meet them by equi-joins on query_id and address. Everything that
does not depend on what was taken before (intents, evidence, which part of a text would be shown) is worked out in columns first.
What does depend on it is a fold over a question's candidates in order, one expression over an array of items that tell how much
a candidate would show, but hold no texts; its state holds the characters used, how often each address was taken, the chunks and
tabs taken and the pinned unit. Texts are cut for what was taken only. A whole tab is looked through once for each question that
meets it, however many of its chunks are candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import questions as q
from corpusloom.functions import rules, text, urls
from corpusloom.operators.retrieval import SNIPPET_CHARS
from corpusloom.scratch import stored

# Lists of candidates in their order, the distance that stands in for a measured one, how many of each
# question's count (none: all that are given), the intent that a list needs, the one that rules it out.
LISTS = (
    ("person", 0.59, 8, None, None), ("roster", 0.12, 20, "roster", None), ("leadership", 0.2, 22, "leadership", None), ("stem", 0.62, None, "stem", "fee"),
    ("structured", 0.65, None, "department", "stem"), ("vector", None, None, None, None), ("keyword", 0.72, None, None, "stem"),
)
# Lists whose chunks, where no list above holds them, come before all others, the foremost first.
IN_FRONT = (("course_tab", 0.05, 32, "curriculum", None), ("roster", 0.1, 20, "roster", None), ("person", 0.1, 20, None, None))


@dataclass(frozen=True)
class Limits:
    # Characters of a context (plain, with a roster, with requirements, of a curriculum), chunks of an address.
    plain: int = 3000
    roster: int = 9000
    requirements: int = 12_000
    curriculum: int = 14_000
    per_url: int = 2
    # Characters of a snippet, of a course chunk, of a whole tab; the least of a tab that is taken whole.
    snippet: int = SNIPPET_CHARS
    course: int = 2400
    tab: int = 10_000
    least_tab: int = 500
    least_course: int = 500
    reserve: int = 100
    # Fixed value: characters of a candidate that evidence of fees is looked for in.
    evidence: int = 80_000
    # Candidates that may fill what is left, out of four times as many.
    fill: int = 4


#: Intents that the lists and the fold ask for.
ASKED = ("fee", "scholarship", "undergraduate_only", "international", "catalogue", "curriculum", "multi_shell", "roster", "leadership", "stem", "department", "first_year")
# Words around which a snippet for international applicants is cut, in order.
INTERNATIONAL_ANCHORS = ("International students", "International student", "Yabancı", "Yabanci", "Application", "Admission", "Apply")
# Words around which a course table is cut, in order, behind those of the semester that is asked for.
TABLE_NEEDLES = ("course code", "compulsory courses", "course matrix", "semester course plan", *(f"{n}.semester course plan" for n in range(1, 9)))
FIRST_YEAR_NEEDLES = ("1.semester course plan", "1.semester", "first year", "year 1")
#: Addresses of a catalogue that hold a table of courses, and those of them that list the courses themselves.
TAB, COURSE_LIST = r"courses\.aspx|coursematrix\.aspx", r"courses\.aspx"


def asked(questions: DataFrame) -> DataFrame:
    """questions with their intents (struct `is_`) and entity."""
    low = text.fold(F.coalesce("question", F.lit("")))
    told = text.once(low, lambda w: F.struct(*[rules.folded_intent(w, n).alias(n) for n in ASKED], rules.folded_entity(w).alias("entity")))
    return questions.withColumn("is_", told)


def ordered_lists(questions: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """questions: query_id, question; lists by name: query_id, chunk_id, source_url, place (in the list), and d (the list of vectors).
    One list for each question: query_id, chunk_id, nominal, list, place. A chunk counts where it comes first, with the distance
    of that list; blocked addresses are in no list but those in front."""
    intents = asked(questions).select("query_id", "is_")
    parts = []
    for front, table in ((False, LISTS), (True, IN_FRONT)):
        for n, (name, nominal, most, needs, without) in enumerate(table):
            if name not in lists:
                continue
            rows = lists[name].join(intents, "query_id")
            keep = F.col("place") <= most if most else F.lit(True)
            keep = keep & F.col(f"is_.{needs}") if needs else keep
            keep = keep & ~F.col(f"is_.{without}") if without else keep
            keep = keep & F.col("is_.entity").isNotNull() if name == "course_tab" else keep
            keep = keep if front else keep & ~urls.blocked(F.col("source_url"))
            d = F.col("d").cast("double") if nominal is None else F.lit(nominal)
            # where a chunk counts: in the lists in their order, then in those in front from the last to the foremost
            counts, shown = (len(LISTS) + len(table) - n, n) if front else (n, len(IN_FRONT) + n)
            parts.append(rows.where(keep).select("query_id", "chunk_id", F.struct(F.lit(counts).alias("counts"), F.col("place").cast("long").alias("at"), F.lit(shown).alias("shown"), d.alias("nominal"), F.lit(name).alias("list")).alias("x")))
    if not parts:
        raise ValueError("no list of a known name")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    own = rows.groupBy("query_id", "chunk_id").agg(F.min("x").alias("x"))
    # a question's candidates are a few hundred: their order is an array's
    listed = own.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("x.shown", "x.at", "chunk_id", "x.nominal", "x.list"))).alias("c"))
    return listed.select("query_id", F.posexplode("c").alias("n", "c")).select("query_id", "c.chunk_id", "c.nominal", "c.list", (F.col("n") + 1).alias("place"))


def table_needles(question: Column) -> Column:
    """Words around which a course table is cut, in the order in which they are tried, each once."""
    n = text.semester(question).cast("string")
    suffix = F.when(n == "1", "st").when(n == "2", "nd").when(n == "3", "rd").otherwise("th")
    # How a semester is written.
    of_semester = F.array(
        F.concat(n, F.lit(".semester course plan")), F.concat(n, F.lit(". semester course plan")), F.concat(n, F.lit(".semester")), F.concat(n, F.lit(" semester")),
        F.concat(n, suffix, F.lit(" semester")), F.concat(F.lit("semester "), n),
    )
    none = F.array().cast("array<string>")
    first = F.when(n.isNotNull(), of_semester).when(rules.intent(question, "first_year"), F.array(*map(F.lit, FIRST_YEAR_NEEDLES))).otherwise(none)
    return F.array_distinct(F.concat(first, F.array(*map(F.lit, TABLE_NEEDLES))))


def first_needle(body: Column, needles: Column) -> Column:
    """The first of some lower-case needles that a text holds."""
    return text.once(F.lower(F.coalesce(body, F.lit(""))), lambda low: F.get(F.filter(needles, lambda x: F.contains(low, x)), F.lit(0)))


def _around(body: Column, needle: Column, most: Column) -> Column:
    """What a window of up to so many characters around a needle can show: part, and the needle's middle in it (-1: begin at the
    beginning)."""
    at = F.when(needle.isNull(), F.lit(0)).otherwise(F.instr(F.lower(body), needle))
    middle = at - 1 + F.floor(F.length(needle) / 2).cast("int")
    left = F.greatest(F.lit(0), middle - most)
    none = F.struct(F.substring(body, 1, most).alias("part"), F.lit(-1).alias("middle"))
    return F.when(at > 0, F.struct(F.substring(body, left + 1, F.least(F.length(body), middle + most) - left).alias("part"), (middle - left).alias("middle"))).otherwise(none)


def _window(x: Column, size: Column) -> Column:
    """A window of so many characters of what _around() gives."""
    n = F.length(x["part"])
    start = F.greatest(F.lit(0), F.least(x["middle"] - F.floor(size / 2).cast("int"), n - size))
    return F.substring(x["part"], F.when(x["middle"] >= 0, start).otherwise(0) + 1, size)


def _told(questions: DataFrame) -> DataFrame:
    """questions with what is looked for in candidates: intents, entity, needles of course tables and anchors."""
    anchors = F.filter(F.concat(q.fee_anchors(F.col("question")), q.department_anchors(F.col("question"))), lambda a: F.length(a) >= 4)
    return asked(questions).withColumns({"_needles": table_needles(F.col("question")), "_anchors": F.when(F.col("is_.fee"), anchors), "_ects": F.contains(F.lower(F.coalesce("question", F.lit(""))), F.lit("ects"))})


def _table_part(body: Column, most: Column | int) -> Column:
    """What can be shown of a table of courses: around the course that is asked for, else around the first needle."""
    course = F.when(F.contains(F.lower(body), F.lower("course")), F.lower("course")).when(F.col("_ects") & F.contains(F.lower(body), F.lit("course code")), "course code")
    needle = F.coalesce(course, first_needle(body, F.col("_needles")))
    return text.once(needle, lambda n: _around(body, n, F.lit(most)))


def whole_tabs(candidates: DataFrame, questions: DataFrame, tabs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Tabs that questions about a curriculum meet, each once for a question: query_id, source_url, held (names of entities in the
    tab), part and middle (what it would show), n (characters of that)."""
    told = _told(questions).where(F.col("is_.catalogue") & F.col("is_.curriculum"))
    met = candidates.where(rules.has(F.col("source_url"), TAB)).select("query_id", "source_url").join(told.select("query_id"), "query_id", "left_semi").distinct()
    names = F.array(*[F.lit(n) for of in rules.ENTITIES.values() for n in of])
    long = tabs.where(F.length(F.trim("merged")) >= limits.least_tab)
    rows = long.join(met, "source_url").join(told, "query_id")
    held = F.when(F.col("is_.entity").isNotNull(), text.once(text.fold(F.col("merged")), lambda low: F.filter(names, lambda n: F.contains(low, n))))
    rows = rows.select("query_id", "source_url", held.alias("held"), _table_part(F.col("merged"), limits.tab).alias("x"))
    return rows.select("query_id", "source_url", "held", F.col("x.part").alias("part"), F.col("x.middle").alias("middle"), F.length("x.part").alias("n"))


def _mark() -> Column:
    """What tells the texts of a question's candidates apart: with it and the question goes what is shown."""
    return F.xxhash64("source_url", "content")


def prepared(candidates: DataFrame, questions: DataFrame, whole: DataFrame, site: rules.Site = rules.Site(), limits: Limits = Limits()) -> DataFrame:
    """candidates: query_id, origin (0: pinned tabs, 1: in order, 2: pool to fill up from), place, chunk_id, source_url, page_title,
    content, distance, state (what the address tells of the asked entity's units; null: nothing); questions: query_id, question,
    name (of a person), course (whose credits are asked for); whole as whole_tabs() gives it. query_id, origin, mark, item: how much a candidate would show, and whether it has the evidence that the question asks for and may be shown at all; part
    and middle: what it would show."""
    met = whole.select("query_id", "source_url", F.lit(True).alias("_whole"), "held", F.col("part").alias("_part"), F.col("middle").alias("_middle"), F.col("n").alias("_n"))
    rows = candidates.withColumn("mark", _mark()).join(_told(questions), "query_id").join(met, ["query_id", "source_url"], "left").withColumn("_whole", F.col("_whole").isNotNull())
    i = lambda n: F.col(f"is_.{n}")
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("source_url", "page_title", "content")})
    url, title, raw = F.col("source_url"), F.col("page_title"), F.col("content")
    catalogued, detail = rules.has(url, site.catalogue), rules.has(url, site.detail)
    curriculum = i("catalogue") & i("curriculum")
    on_tab = curriculum & rules.has(url, TAB)
    rows = rows.withColumns({"_tab": on_tab, "_detail": detail, "_in": catalogued})
    # evidence: names of the entity and of its competitors, in what would be shown
    blob = text.fold(F.concat_ws("\n", title, F.when(F.col("_whole"), "").otherwise(raw), url))
    found = lambda low, n: F.contains(low, n) | F.coalesce(F.array_contains("held", n), F.lit(False))
    names = text.once(blob, lambda low: F.struct(*[F.size(F.filter(of(i("entity")), lambda n: found(low, n))).alias(k) for k, of in (("own", rules.aliases), ("other", rules.competitors))]))
    rows = rows.withColumn("_names", F.when(i("entity").isNotNull(), names))
    own, other, some = F.col("_names.own"), F.col("_names.other"), i("entity").isNotNull()
    of_entity = F.when(~F.col("_in"), False).when(F.col("_detail"), F.coalesce(F.col("state"), F.lit(True)) | (own > 0)).otherwise(own > 0)
    allowed = ~urls.blocked(url) & ~(i("undergraduate_only") & rules.has(F.concat_ws(" ", url, title), rules.GRADUATE_SOURCE)) & ~(some & (own == 0) & (other > 0)) & (~(i("catalogue") & some) | of_entity)
    grounded = ~i("fee") | rules.fee_grounded(url, title, raw, most=limits.evidence)
    # what is shown: the first of these that applies
    held = lambda anchors: text.once(F.lower(raw), lambda low: F.get(F.filter(anchors, lambda a: F.contains(low, F.lower(a))), F.lit(0)))
    named = F.col("name").isNotNull() & rules.name_in(raw, F.col("name"))
    rows = rows.withColumns({"_named": named, "_of_fee": held(F.col("_anchors")), "_abroad": F.when(~i("fee") & i("international"), held(F.array(*map(F.lit, INTERNATIONAL_ANCHORS))))})
    tabbed = F.col("_tab") & ~F.col("_named") & ~i("fee") & ~i("international")
    rows = rows.withColumn("_tabbed", tabbed)
    plain = lambda part: F.struct(part.alias("part"), F.lit(-1).alias("middle"))
    cut = lambda phrase: plain(text.snippet(raw, phrase, limits.snippet))
    phrase = F.when(F.col("_named"), F.col("name")).otherwise(F.coalesce("_of_fee", "_abroad"))
    begins = plain(F.substring(raw, 1, limits.snippet))
    most = F.when(F.col("_whole"), limits.tab).otherwise(limits.course)
    rows = rows.withColumns({"_phrase": phrase, "_most": most, "_tab_whole": F.col("_tabbed") & F.col("_whole")})
    shown = F.when(F.col("_tabbed"), _table_part(raw, limits.course)).when(F.col("_phrase").isNotNull(), cut(F.col("_phrase"))).otherwise(begins)
    rows = rows.withColumn("shown", F.when(~F.col("_tab_whole"), shown))  # none where a whole tab is shown
    unit = F.when(curriculum & ~i("multi_shell") & F.col("_detail"), F.nullif(F.trim(urls.parameter(url, "curSunit")), F.lit("")))
    item = F.struct(
        F.col("place").cast("int").alias("place"), F.col("chunk_id").cast("long").alias("chunk_id"), url.alias("url"), F.when(title != "", title).otherwise(url).alias("title"), F.col("distance").cast("double").alias("distance"),
        F.when(F.col("_tab_whole"), F.col("_n")).otherwise(F.length("shown.part")).alias("n"), F.when(F.col("_tabbed"), F.col("_most")).alias("most"), F.col("_whole").alias("whole"), unit.alias("unit"), rules.has(url, TAB).alias("pins"), (F.col("_in") & F.col("_detail")).alias("detail"),
        F.coalesce(grounded, F.lit(False)).alias("grounded"), F.coalesce(allowed, F.lit(False)).alias("allowed"), F.col("mark"),
    )
    return rows.select(
        "query_id", F.col("origin").cast("int").alias("origin"), "mark", item.alias("item"),
        *[F.when(F.col("_tab_whole"), F.col(f"_{c}")).otherwise(F.col(f"shown.{c}")).alias(c) for c in ("part", "middle")],
    )


_SOURCE = "struct<url:string,title:string,distance:double>"
_STATE = f"struct<used:int,pin:string,urls:array<string>,ids:array<bigint>,tabs:array<string>,taken:array<struct<mark:bigint,title:string,size:int>>,sources:array<{_SOURCE}>,detail:boolean>"


def _taken(acc: Column, x: Column, budget: Column, per_url: Column, skipped: Column, limits: Limits) -> Column:
    """The state after one candidate: it is taken, or only its unit is pinned, or nothing changes."""
    left = budget - acc["used"]
    open_ = (left > 0) & x["grounded"] & ~F.array_contains(acc["ids"], x["chunk_id"])
    pin = F.when(open_ & x["pins"], F.coalesce(acc["pin"], x["unit"])).otherwise(acc["pin"])
    same = x["unit"].isNull() | acc["pin"].isNull() | (x["unit"] == acc["pin"])
    size = F.least(x["n"], F.when(x["most"].isNull(), x["n"]).otherwise(F.least(x["most"], F.greatest(F.lit(limits.least_course), left - limits.reserve))))
    often = F.size(F.filter(acc["urls"], lambda u: u == x["url"]))
    fits = open_ & x["allowed"] & same & ~F.array_contains(skipped, x["url"]) & (often < per_url) & ~(x["whole"] & F.array_contains(acc["tabs"], x["url"])) & (size <= left)
    source = F.struct(x["url"].alias("url"), F.substring(x["title"], 1, 200).alias("title"), F.round(x["distance"], 4).alias("distance"))
    more = lambda name, value: F.concat(acc[name], F.array(value))
    state = lambda used, urls_, ids, tabs, taken, sources, detail: F.struct(used.alias("used"), pin.alias("pin"), urls_.alias("urls"), ids.alias("ids"), tabs.alias("tabs"), taken.alias("taken"), sources.alias("sources"), detail.alias("detail")).cast(_STATE)
    one = F.struct(x["mark"].alias("mark"), x["title"].alias("title"), size.cast("int").alias("size"))
    yes = state(acc["used"] + size, more("urls", x["url"]), more("ids", x["chunk_id"]), F.when(x["whole"], more("tabs", x["url"])).otherwise(acc["tabs"]), more("taken", one), more("sources", source), acc["detail"] | x["detail"])
    no = state(*[acc[n] for n in ("used", "urls", "ids", "tabs", "taken", "sources", "detail")])
    return F.when(fits, yes).otherwise(no)


#: Blocks of pages, which of them end a context by themselves, and from the innermost to the outermost of those put in front.
BLOCKS = ("course_row", "scholarship", "international", "requirements", "location", "roster", "person", "management")


def contexts(questions: DataFrame, candidates: DataFrame, blocks: DataFrame, tabs: DataFrame, fallback: DataFrame, site: rules.Site = rules.Site(), limits: Limits = Limits()) -> DataFrame:
    """One row for each question: query_id, context, sources (url, title, distance), context_chars (of chunks), chunk_ids, alone (the
    block that is the whole context, if any).

    questions and candidates as prepared() takes them; tabs: source_url, merged; blocks: query_id, kind (of BLOCKS), block, sources; fallback: query_id, place,
    chunk_id, source_url, page_title, content, distance (course pages for questions that found none of their own).

    A roster (for questions about staff that name no person and no fees), else the pages of the management (no fees), else those
    about the place are a context by themselves. Otherwise the row of the course comes first, then candidates in
    order while they fit: a longer one is passed over, later ones may still fit; at most so many of an address; those of
    blocks are skipped; of curricula one unit is pinned by the first course tab, and a tab is shown whole once. The pool then fills up what is
    left. Course questions without a source that shows a programme's details get the fallback. Blocks go in front."""
    own = asked(questions).select("query_id", "is_", "name")
    kinds = blocks.where(F.length(F.coalesce("block", F.lit(""))) > 0).groupBy("query_id").agg(*[F.min(F.when(F.col("kind") == k, F.struct("block", F.col("sources").cast(f"array<{_SOURCE}>").alias("sources")))).alias(k) for k in BLOCKS])
    whole = stored(whole_tabs(candidates, questions, tabs, limits), "tabs")
    told = prepared(candidates, questions, whole, site, limits).select("query_id", "origin", "item")
    told = told.where((F.col("origin") == 2) | (F.col("item.grounded") & (F.col("item.allowed") | F.col("item.pins"))))  # others change nothing
    items = told.groupBy("query_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("origin") == n, F.col("item")))).alias(name) for n, name in enumerate(("pinned", "ordered", "pool"))])
    last = fallback.where(F.length(F.coalesce("content", F.lit(""))) > 0).select(
        "query_id",
        F.struct(F.col("place").cast("int").alias("place"), F.col("chunk_id").cast("long").alias("chunk_id"), F.col("source_url").alias("url"), F.coalesce(F.nullif(F.col("page_title"), F.lit("")), F.col("source_url")).alias("title"), F.substring("content", 1, limits.snippet).alias("part"), F.col("distance").cast("double").alias("distance"),
                 F.when(rules.has(F.col("source_url"), site.detail), F.nullif(F.trim(urls.parameter(F.col("source_url"), "curSunit")), F.lit(""))).alias("unit")).alias("item"),
    ).groupBy("query_id").agg(F.array_sort(F.collect_list("item")).alias("last"))
    rows = own.join(kinds, "query_id", "left").join(items, "query_id", "left").join(last, "query_id", "left")
    i = lambda n: F.col(f"is_.{n}")
    has = lambda k: F.col(k).isNotNull()
    curriculum = i("catalogue") & i("curriculum")
    budget = F.greatest(F.lit(limits.plain), F.when(has("roster"), limits.roster), F.when(has("requirements"), limits.requirements), F.when(curriculum, limits.curriculum))
    none = F.array().cast(f"array<{_SOURCE}>")
    sources = lambda k: F.coalesce(F.col(f"{k}.sources"), none)
    addresses = lambda s: F.transform(s, lambda x: x["url"])
    told = lambda k: has(k) & (F.size(sources(k)) > 0)
    alone = F.when(told("roster") & i("roster") & F.col("name").isNull() & ~i("fee"), "roster").when(told("management") & ~i("fee"), "management").when(told("location"), "location")
    rows = rows.withColumns({
        "budget": budget, "alone": alone, "per_url": limits.per_url + i("scholarship").cast("int"), "skipped": F.concat(*[addresses(sources(k)) for k in ("roster", "requirements", "scholarship")]),
        "head": F.when(F.length("course_row.block") <= budget, F.col("course_row.block")),
    })
    strings = F.array().cast("array<string>")
    first = F.struct(F.coalesce(F.length("head"), F.lit(0)).alias("used"), F.lit(None).cast("string").alias("pin"), strings.alias("urls"), F.array().cast("array<bigint>").alias("ids"), strings.alias("tabs"), F.array().alias("taken"), none.alias("sources"), F.lit(False).alias("detail")).cast(_STATE)
    step = lambda acc, x: _taken(acc, x, F.col("budget"), F.col("per_url"), F.col("skipped"), limits)
    empty = lambda name, kind: F.coalesce(F.col(name), F.array().cast(kind))
    kind = rows.schema["ordered"].dataType
    rows = rows.withColumn("a", F.aggregate(F.when(curriculum, F.concat(empty("pinned", kind), empty("ordered", kind))).otherwise(empty("ordered", kind)), first, step))
    pool = F.slice(F.filter(empty("pool", kind), lambda x: ~F.array_contains(F.col("a.ids"), x["chunk_id"])), 1, 4 * limits.fill)
    pool = F.slice(F.filter(pool, lambda x: x["grounded"]), 1, limits.fill)
    nearest = F.transform(F.array_sort(F.transform(pool, lambda x: F.struct(x["distance"].alias("d"), x["chunk_id"].alias("id"), x.alias("x")))), lambda y: y["x"])
    rows = rows.withColumn("a", F.aggregate(nearest, F.col("a"), step))
    # course questions that found nothing of a programme
    bare = i("catalogue") & ~F.col("a.detail")
    late = F.filter(empty("last", rows.schema["last"].dataType), lambda x: x["unit"].isNull() | F.col("a.pin").isNull() | (x["unit"] == F.col("a.pin")))
    late = F.when(bare, late).otherwise(F.slice(late, 1, 0))
    rows = rows.withColumn("late", late).drop("pinned", "ordered", "pool", "last")
    # texts of what was taken: few rows, so that those of the candidates stay where they are
    rows = stored(rows, "taken")
    taken = rows.select("query_id", F.posexplode("a.taken").alias("at", "x")).select("query_id", F.col("x.mark").alias("mark"), "at", F.col("x.title").alias("title"), F.col("x.size").alias("size"))
    few = candidates.withColumn("_m", _mark()).join(taken.select("query_id", F.col("mark").alias("_m")), ["query_id", "_m"], "left_semi").drop("_m")
    shown = prepared(few, questions, whole, site, limits).select("query_id", "mark", F.struct("part", "middle").alias("x"))
    cut = shown.join(taken, ["query_id", "mark"]).select("query_id", F.struct("at", F.concat(F.lit("["), "title", F.lit("]\n"), _window(F.col("x"), F.col("size"))).alias("part")).alias("p"))
    rows = rows.join(cut.groupBy("query_id").agg(F.array_sort(F.collect_set("p")).alias("parts")), "query_id", "left")
    head = F.when(has("head"), F.array("head")).otherwise(strings)
    parts = F.concat(head, F.coalesce(F.transform("parts", lambda p: p["part"]), strings), F.transform("late", lambda x: F.concat(F.lit("["), x["title"], F.lit("]\n"), x["part"])))
    shown = F.concat("a.sources", F.transform("late", lambda x: F.struct(x["url"].alias("url"), F.substring(x["title"], 1, 200).alias("title"), F.round(F.coalesce(x["distance"], F.lit(0.9999)), 4).alias("distance"))))
    without = lambda s, of: F.filter(s, lambda x: ~F.array_contains(of, F.coalesce(x["url"], F.lit(""))))
    in_front = [F.col(f"{k}.block") for k in ("person", "roster", "location", "requirements", "international", "scholarship")]
    context = F.array_join(F.filter(F.concat(F.array(*in_front), parts), lambda p: p.isNotNull()), "\n\n")
    heads = F.concat(*[sources(k) for k in ("scholarship", "requirements", "international")])
    rows = rows.withColumn("s", F.concat(heads, without(shown, addresses(heads))))
    rows = rows.withColumn("s", F.concat(without(sources("location"), addresses(F.col("s"))), "s"))
    rows = rows.withColumn("s", F.concat(without(sources("roster"), addresses(F.col("s"))), "s"))
    rows = rows.withColumn("s", F.concat(sources("person"), without(F.col("s"), addresses(sources("person")))))
    by_itself = lambda field: F.coalesce(*[F.when(F.col("alone") == k, F.col(f"{k}.{field}")) for k in ("roster", "management", "location")])
    kept = lambda value, nothing: F.when(F.col("alone").isNull(), value).otherwise(nothing)
    return rows.select(
        "query_id", F.coalesce(by_itself("block"), context).alias("context"), F.coalesce(by_itself("sources"), F.col("s")).alias("sources"), kept(F.col("a.used"), F.lit(0)).cast("long").alias("context_chars"),
        kept(F.concat("a.ids", F.transform("late", lambda x: x["chunk_id"])), F.array().cast("array<bigint>")).alias("chunk_ids"), "alone",
    )
