"""Contexts from hand-made candidates: one case for each thing that the fold decides."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import assembly as a
from corpusloom.operators.assembly import Limits

QUESTION = "query_id long, question string, name string, course string"
CANDIDATE = "query_id long, origin int, place int, chunk_id long, source_url string, page_title string, content string, distance double, state boolean"
BLOCK = "query_id long, kind string, block string, sources array<struct<url:string,title:string,distance:double>>"
TAB, LATE = "source_url string, merged string", "query_id long, place int, chunk_id long, source_url string, page_title string, content string, distance double"
COURSES, FEES, STAFF, PLAIN = "which courses are in the curriculum", "tuition fee", "academic staff of the faculty", "tell me about it"
SHELL = "https://o.example.edu/catalogue/{}.aspx?curSunit={}"


@pytest.fixture(scope="module")
def run(spark):
    def contexts(questions, candidates, blocks=(), tabs=(), late=(), limits=Limits()):
        make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
        made = make([(*x, None, None)[:4] for x in questions], QUESTION)
        own = make([(*x, None)[:9] for x in candidates], CANDIDATE)
        given = make([(q, k, b, [(u, "t", 0.0) for u in us]) for q, k, b, *us in blocks], BLOCK)
        return {r.query_id: r for r in a.contexts(made, own, given, make(tabs, TAB), make(late, LATE), limits=limits).collect()}

    return contexts


def chunk(q, i, content, url=None, origin=1, title="t", d=0.5, state=None):
    return (q, origin, i, i, url or f"https://example.edu/{i}", title, content, d, state)


def urls(row):
    return [s.url for s in row.sources]


def test_longer_ones_are_passed_over_and_addresses_are_capped(run):
    rows = [chunk(1, k, c * n, u) for k, (c, n, u) in enumerate([("a", 400, "u"), ("b", 400, "u"), ("c", 10, "u"), ("d", 900, "v"), ("e", 100, "v"), ("f", 5, None)])]
    got = run([(1, PLAIN)], rows + [chunk(1, 0, "a" * 400, "u", 1)], limits=Limits(plain=1000, snippet=900))[1]
    assert got.chunk_ids == [0, 1, 4, 5] and got.context_chars == 905 and got.context.startswith("[t]\n" + "a" * 400 + "\n\n[t]\nb")
    scholarship = run([(1, "scholarship")], [chunk(1, k, f"scholarship {k}", "u") for k in range(5)])[1]
    assert scholarship.chunk_ids == [0, 1, 2]  # one more of an address


def test_blocks_that_are_a_context_by_themselves(run):
    rows = [chunk(q, 1, "tuition of it") for q in range(1, 8)]
    questions = [(1, STAFF), (2, STAFF, "Ada Lovelace"), (3, STAFF + " and its fee"), (4, PLAIN), (5, FEES), (6, "where is it"), (7, PLAIN)]
    blocks = [(1, "roster", "R", "r"), (1, "management", "M", "m"), (2, "roster", "R", "r"), (3, "roster", "R", "r"), (4, "management", "M", "m"), (5, "management", "M", "m"), (6, "location", "L", "l"), (6, "person", "P", "p"), (7, "roster", "R")]
    got = run(questions, rows, blocks)
    assert {k: (v.alone, v.context, urls(v)) for k, v in got.items() if v.alone} == {1: ("roster", "R", ["r"]), 4: ("management", "M", ["m"]), 6: ("location", "L", ["l"])}
    assert got[2].context == "R\n\n[t]\ntuition of it" and urls(got[2])[0] == "r" and got[3].alone is None and got[5].context == "[t]\ntuition of it"
    assert got[1].chunk_ids == [] and got[1].context_chars == 0 and got[7].context.startswith("R\n\n")


def test_blocks_in_front_and_their_addresses(run):
    rows = [chunk(1, 1, "x", "s1"), chunk(1, 2, "y", "q1"), chunk(1, 3, "z", "i1"), chunk(1, 4, "w", "p1")]
    blocks = [(1, "scholarship", "S", "s1"), (1, "requirements", "Q", "q1"), (1, "international", "I", "i1"), (1, "person", "P", "p1"), (1, "course_row", "head")]
    got = run([(1, PLAIN)], rows, blocks)[1]
    assert got.context == "P\n\nQ\n\nI\n\nS\n\nhead\n\n[t]\nz\n\n[t]\nw"  # those of scholarship and requirements are skipped
    assert urls(got) == ["p1", "s1", "q1", "i1"] and got.context_chars == 6


def test_budgets(run):
    rows = [chunk(q, k, "courses " * 90, SHELL.format(f"x{k}", 1) if q == 4 else None) for q in range(1, 5) for k in range(40)]
    blocks = [(2, "roster", "R"), (3, "requirements", "Q", "q"), (3, "roster", "R")]
    got = run([(1, PLAIN), (2, PLAIN), (3, PLAIN), (4, COURSES)], rows, blocks)
    assert [got[q].context_chars // 700 for q in (1, 2, 3, 4)] == [4, 12, 17, 20]


def test_one_unit_is_pinned(run):
    first = [chunk(1, 1, "about two", SHELL.format("progAbout", 2)), chunk(1, 2, "courses one", SHELL.format("progCourses", 1)), chunk(1, 3, "courses two", SHELL.format("progCourses", 2)), chunk(1, 4, "about one", SHELL.format("progAbout", 1)), chunk(1, 5, "late two", SHELL.format("progAbout", 2)), chunk(1, 6, "no unit", "https://o.example.edu/catalogue/index")]
    both = [(2, *r[1:]) for r in first]
    got = run([(1, COURSES), (2, "compare the courses")], first + both)
    assert got[1].chunk_ids == [1, 2, 4, 6] and got[2].chunk_ids == [1, 2, 3, 4, 5, 6]
    pinned = run([(1, COURSES), (3, PLAIN)], [chunk(1, 9, "pinned", SHELL.format("progCourses", 7), 0), chunk(3, 9, "pinned", SHELL.format("progCourses", 7), 0)] + first)
    assert pinned[1].chunk_ids == [9, 6] and pinned[3].chunk_ids == []  # pinned tabs are for curricula


def test_whole_tabs_are_shown_once_around_what_is_asked(run):
    tab, url = "z" * 9000 + " Web Programming 3+0+0 " + "y" * 9000, SHELL.format("progCourses", 1)
    rows = [chunk(1, 1, "short", url), chunk(1, 2, "again", url), chunk(2, 1, "short", url), chunk(3, 1, "q" * 5000 + "2.semester course plan" + "p" * 5000, SHELL.format("progCourses", 4))]
    got = run([(1, "ects of the course web programming", None, "web programming"), (2, COURSES), (3, "courses of the second semester")], rows, tabs=[(url, tab)])
    assert got[1].chunk_ids == [1] and got[1].context_chars == 10_000 and "Web Programming 3+0+0" in got[1].context
    assert got[2].context == "[t]\n" + "z" * 9000 + " Web Programming 3+0+0 " + "y" * 977
    assert got[3].context_chars == 2400 and "2.semester course plan" in got[3].context
    small = run([(1, COURSES)], rows[:1], tabs=[(url, "x" * 499)])[1]
    assert small.context == "[t]\nshort"


def test_the_pool_fills_up(run):
    rows = [chunk(1, 1, "first")] + [chunk(1, 10 + k, f"pool {k}", origin=2, d=1 - k / 100) for k in range(9)] + [chunk(1, 1, "first", origin=2)]
    assert run([(1, PLAIN)], rows)[1].chunk_ids == [1, 13, 12, 11, 10]  # four of them, nearest first
    fees = [chunk(1, 10 + k, "tuition" if k > 13 else "nothing", origin=2) for k in range(20)]
    assert run([(1, FEES)], fees)[1].chunk_ids == [24, 25]  # of the first sixteen those with evidence


def test_fallback_of_course_questions(run):
    late = [(q, k, 100 + k, SHELL.format("progAbout", k), "late", "l" * 900, None) for q in (1, 2, 3) for k in (1, 2)]
    rows = [chunk(2, 1, "courses", SHELL.format("progCourses", 2)), chunk(3, 1, "courses", "https://o.example.edu/catalogue/index")]
    got = run([(1, COURSES), (2, COURSES), (3, COURSES)], rows, late=late)
    assert got[1].chunk_ids == [101, 102] and [s.distance for s in got[1].sources] == [0.9999] * 2 and len(got[1].context) == 2 * 707 + 2
    assert got[2].chunk_ids == [1] and got[3].chunk_ids == [1, 101, 102]


def test_candidates_that_questions_rule_out(run):
    entity = "courses of computer engineering"
    rows = [
        chunk(1, 1, "tuition"), chunk(1, 2, "nothing"), chunk(1, 3, "tuition", "https://example.edu/news/1"),
        chunk(2, 1, "computer engineering", SHELL.format("a", 1)), chunk(2, 2, "medical school", SHELL.format("b", 1)), chunk(2, 3, "computer engineering", "https://example.edu/x"),
        chunk(2, 4, "none", SHELL.format("c", 1), state=False), chunk(2, 5, "none", SHELL.format("d", 1), state=True), chunk(2, 6, "none", "https://o.example.edu/catalogue/i"), chunk(2, 7, "computer engineering", SHELL.format("e", 1), state=False),
        chunk(3, 1, "x", "https://example.edu/graduate/1"), chunk(3, 2, "how to apply"),
    ]
    got = run([(1, FEES), (2, entity), (3, "international students apply")], rows)
    assert got[1].chunk_ids == [1] and got[2].chunk_ids == [1, 5, 7] and got[3].chunk_ids == [2]


def test_what_a_snippet_is_cut_around(run):
    far = "f" * 2000
    rows = [chunk(1, 1, f"{far} Ada Lovelace {far}"), chunk(2, 1, f"{far} tuition of Computer Engineering {far}"), chunk(3, 1, f"{far} Admission {far}"), chunk(4, 1, f"{far} Ada"), chunk(5, 1, None), chunk(6, 1, "")]
    got = run([(1, "who is ada lovelace", "Ada Lovelace"), (2, "fee of computer engineering"), (3, "international students apply"), (4, PLAIN), (5, PLAIN), (6, None), (7, PLAIN)], rows)
    assert "Ada Lovelace" in got[1].context and "Computer Engineering" in got[2].context and "Admission" in got[3].context and "Ada" not in got[4].context
    assert all(len(got[q].context) == 704 for q in (1, 2, 3, 4)) and got[7].context == "" and got[7].sources == []


def test_needles_of_course_tables(spark):
    rows = spark.createDataFrame([("courses of the 3rd semester",), ("courses of the first year",), ("courses",)], "question string")
    found = [r[0] for r in rows.select(a.table_needles(F.col("question"))).collect()]
    assert found[0][:7] == ["3.semester course plan", "3. semester course plan", "3.semester", "3 semester", "3rd semester", "semester 3", "course code"] and len(found[0]) == 6 + 4 + 7
    assert found[1][:5] == ["1.semester course plan", "1.semester", "first year", "year 1", "course code"] and found[2][:2] == ["course code", "compulsory courses"]
    body = spark.createDataFrame([("x Course Matrix 4.Semester Course Plan",), (None,)], "body string").select(a.first_needle(F.col("body"), a.table_needles(F.lit("courses")))).collect()
    assert [r[0] for r in body] == ["course matrix", None]


def test_lists_in_their_order(spark):
    questions = spark.createDataFrame([(1, "academic staff"), (2, "fee of computer engineering courses"), (3, None)], "query_id long, question string")
    schema = "query_id long, chunk_id long, source_url string, place int, d double"
    make = lambda rows: spark.createDataFrame([(q, c, u, p, 0.3) for q, c, u, p in rows], schema)
    lists = {
        "person": make([(1, 100 + k, "u", k) for k in range(1, 26)]), "roster": make([(1, 200, "u", 1), (1, 101, "u", 2), (1, 201, "https://x/news/1", 3), (3, 200, "u", 1)]),
        "vector": make([(1, 300, "u", 1), (1, 200, "u", 2), (1, 301, "https://x/blog", 3), (1, 110, "u", 4), (2, 300, "u", 1)]), "stem": make([(2, 400, "u", 1)]), "keyword": make([(1, 500, "u", 1), (2, 500, "u", 1)]),
        "course_tab": make([(1, 600, "u", 1), (2, 600, "u", 1), (2, 300, "u", 2)]),
    }
    got = {}
    for r in sorted(a.ordered_lists(questions, lists).collect(), key=lambda r: (r.query_id, r.place)):
        got.setdefault(r.query_id, []).append((r.chunk_id, r.nominal))
    # in front what no list holds: blocked roster chunks, persons beyond the eighth (one of them is in the vector list)
    assert got[1] == [(201, 0.1)] + [(100 + k, 0.1) for k in range(9, 21) if k != 10] + [(100 + k, 0.59) for k in range(1, 9)] + [(200, 0.12), (300, 0.3), (110, 0.3), (500, 0.72)]
    assert got[2] == [(600, 0.05), (300, 0.3)] and 3 not in got
    with pytest.raises(ValueError):
        a.ordered_lists(questions, {})


def test_a_whole_tab_is_looked_through_once_for_each_question(spark):
    url, tab = SHELL.format("progCourses", 1), "x" * 600 + " Medical School " + "course code"
    questions = spark.createDataFrame([(1, COURSES + " of computer engineering", None, None), (2, COURSES, None, None), (3, PLAIN, None, None)], QUESTION)
    candidates = spark.createDataFrame([(*chunk(q, 10 * q + k, "of computer engineering" if k == 0 else "none", url), None)[:9] for q in (1, 2, 3) for k in range(8)], CANDIDATE)
    whole = a.whole_tabs(candidates, questions, spark.createDataFrame([(url, tab), ("https://o.example.edu/catalogue/courses.aspx", None)], TAB))
    assert sorted((r.query_id, r.held, r.n, r.middle > 0) for r in whole.collect()) == [(1, ["medical school"], len(tab), True), (2, None, len(tab), True)]
    told = a.prepared(candidates, questions, whole)
    assert not {"part", "content", "merged"} & set(told.schema["item"].dataType.names)  # what meets in the fold holds no texts
    rows = told.select("query_id", "item.chunk_id", "item.n", "item.whole", "item.allowed", "part").collect()
    assert {(r.query_id, r.n, r.whole, r.allowed, r.part == tab) for r in rows if r.query_id < 3} == {(1, len(tab), True, False, True), (2, len(tab), True, True, True)}  # of another entity only
    assert {(r.n, r.whole) for r in rows if r.query_id == 3} == {(23, False), (4, False)}


def test_tabs_are_collected_up_to_the_cut(spark):
    from corpusloom.operators.retrieval import merged_tabs

    pages = {
        "blanks": [(0, 1, "  ab  "), (0, 2, "    "), (0, 3, None), (0, 4, "c"), (1, 0, "d" * 9)], "first": [(0, 1, None), (0, 2, "    "), (0, 3, "abcdefgh")], "null": [(0, 1, None)], "at": [(0, 1, "abc" + " " * 9), (0, 2, None), (0, 3, "z")],
        "tie": [(0, 1, "b"), (0, 1, "a")], "end": [(0, 1, "ab   ")], "long": [(0, k, "xy ") for k in range(500)],
    }
    rows = spark.createDataFrame([(u, *r) for u, rs in pages.items() for r in rs], "source_url string, chunk_index int, chunk_id long, content string")
    for most in (1, 2, 5, 6, 9, 12, 40):
        got = {r.source_url: r.merged for r in merged_tabs(rows, most).collect()}
        assert got == {u: "\n".join(c for *_, c in sorted(rs, key=lambda r: (r[0], r[1], r[2] or "")) if c is not None).strip(" ")[:most] for u, rs in pages.items()}
    found = merged_tabs(rows.where("source_url = 'long'"), 40)
    assert "Window" in found._jdf.queryExecution().executedPlan().toString()  # chunks behind the cut are left before they are collected
