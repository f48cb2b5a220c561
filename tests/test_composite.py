"""Steps around retrieval: what the registered queries and their SQL do not reach."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import questions as q
from corpusloom.functions import urls
from corpusloom.operators import composite


@pytest.mark.parametrize(
    "text, course, want",
    [
        ("CSE 220 Web Programming 3+0+0 Compulsory 6 Face To Face", "web programming", 6),
        ("CSE 220 Web Programming\n3+0+0 Elective 5", "web programming", 5),
        ("Total ECTS 30\nCSE 1 Algebra 2+2+0", "algebra", None),
        ("Web Programming is taught in spring", "web programming", None),
        ("x | Data Structures and Algorithms | 3+2+0 | Compulsory | 7 | y", "data structures", 7),
        ("", "x", None),
        (None, "web programming", None),
        ("CSE 9 Programming of the Web 3+0+0 Compulsory 4", "web programming", 4),
    ],
)
def test_course_rows(text, course, want):
    found = q.course_row(text, course)
    assert (found and found[1]) == want


def test_query_variants(spark):
    d = spark.createDataFrame([(1, "Who is Ahmet Bulut?", "Ahmet Bulut"), (2, "hello", None), (3, "fees of all programs, ALL FEES", None)], "id long, question string, name string")
    got = {r["id"]: r["v"] for r in d.select("id", q.query_variants(F.col("question"), F.col("name"), {"wide_fee": "HELLO"}).alias("v")).collect()}
    assert got[1][0] == "Who is Ahmet Bulut?" and len(got[1]) == 4 and all("Ahmet Bulut" in v for v in got[1])
    assert got[2] == ["hello"] and got[3] == ["fees of all programs, ALL FEES", "HELLO"]


def test_catalogue_urls(spark):
    base = "https://courses.example.edu/catalogue/x.aspx"
    links = {"progAbout.aspx?a=1&amp;b=2#t": "https://courses.example.edu/catalogue/progAbout.aspx?a=1&b=2", "https://www.courses.example.edu/catalogue/i": "https://www.courses.example.edu/catalogue/i", "https://other.org/catalogue/i": "", "javascript:x()": "", "#a": "", "/else/showPac.aspx": "https://courses.example.edu/else/showPac.aspx", "/else/p.aspx": "", "": ""}
    d = spark.createDataFrame(list(enumerate(links)), "i long, link string")
    got = d.orderBy("i").select(urls.catalogue_url(F.col("link"), F.lit(base), "courses.example.edu", "/catalogue/").alias("u")).collect()
    assert [r["u"] for r in got] == list(links.values())


def test_snippets_by_question(spark):
    body = "x " * 600 + "Ann Lee heads it. " + "y " * 600 + "Tuition Fees and Scholarships: 10 " + "z " * 600
    rows = [(1, 1, "who is Ann Lee", "Ann Lee", "u", "t", body), (2, 1, "scholarship fees", None, "u", "t", body), (3, 1, "courses and ects", None, "u", "t", body), (3, 2, "courses and ects", None, "u", "t", body), (4, 1, "hello", None, "u", "t", body)]
    d = spark.createDataFrame([(a, b, c, n, u, t, x, i) for i, (a, b, c, n, u, t, x) in enumerate(rows)], "query_id long, rank long, question string, name string, source_url string, page_title string, content string, chunk_id long")
    merged = spark.createDataFrame([("u", "m" * 900)], "source_url string, merged string")
    got = {(r["query_id"], r["rank"]): r["snippet"] for r in composite.with_snippets(d, merged).collect()}
    assert "Ann Lee" in got[1, 1] and len(got[1, 1]) == 700 and "Scholarships" in got[2, 1]
    assert got[3, 1] == "m" * 900 and (3, 2) not in got and got[4, 1] == body[:700]


def test_page_fallback(spark):
    pages = spark.createDataFrame([(i, f"https://e.edu/{i}", "t", ("river " if i % 2 else "stone ") * 100) for i in range(30)], "page_id long, url string, title string, content string")
    asked = spark.createDataFrame([(1, "the river please"), (2, "nothing at all"), (3, None)], "query_id long, question string")
    got = composite.page_fallback(asked, pages, chars=600).collect()
    assert [(r["query_id"], r["chunk_ids"], r["distance"]) for r in got] == [(1, [1, 3, 5, 7, 9], 1.0)]


def test_embedding_is_asked_for_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def embed(t):
        calls.add(1)
        return [float(len(t or ""))]

    d = spark.createDataFrame([(i, "same text" if i % 2 else f"text {i}") for i in range(20)] + [(99, None)], "id long, text string")
    got = {r["id"]: r["embedding"] for r in composite.embedded_once(d, "text", embed).collect()}
    assert len(got) == 21 and got[1] == [9.0] and calls.value <= 12


def test_breaker():
    now, loads = [0.0], []

    def load():
        loads.append(now[0])
        if len(loads) < 3:
            raise OSError("not there")
        return lambda x: x + 1

    model = composite.Breaker(load, clock=lambda: now[0])
    assert model(1) is None and model(1) is None and loads == [0.0]
    now[0] = 301
    assert model(1) is None and loads == [0.0, 301]
    now[0] = 700
    assert model(1) == 2 and model(2) == 3 and len(loads) == 3
    gone = composite.Breaker(lambda: 1 / 0, wait=0, attempts=3)
    assert [gone(1) for _ in range(9)] == [None] * 9 and gone.left == 0


def test_served_model_keeps_the_last_texts():
    asked = []

    def model(texts):
        asked.extend(texts)
        return [[float(len(t))] for t in texts]

    one = composite.Served(composite.Breaker(lambda: model), texts=2, chars=10)
    assert one(["a", "bb", "a"]) == [[1.0], [2.0], [1.0]] and asked == ["a", "bb"]
    assert one(["a", "ccc"]) == [[1.0], [3.0]] and list(one.kept) == ["a", "ccc"] and one.held == 4
    assert one(["d" * 11, "bb"]) == [[11.0], [2.0]] and list(one.kept) == ["ccc", "bb"]
    assert one(["e" * 9]) == [[9.0]] and list(one.kept) == ["e" * 9] and one.held == 9
    assert one([]) == []


def test_embedder_in_workers(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else f"text {i % 4}") for i in range(40)], "id int, text string").repartition(3)
    found = {r["id"]: r["embedding"] for r in composite.embedded_once(rows, "text", composite.embedder("lengths", lambda: lambda ts: [[len(t)] for t in ts])).collect()}
    assert len(found) == 40 and found[3] == [0.0] and found[4] == [6.0]

    def broken():
        raise OSError("no model here")

    failures = spark.sparkContext.accumulator(0)
    lost = composite.embedded_once(rows, "text", composite.embedder("broken", broken, failures, wait=0.0, attempts=2)).collect()
    assert len(lost) == 40 and all(r["embedding"] is None for r in lost)
    assert failures.value >= 1  # each worker process tries, twice at most


def test_enriched_keeps_what_is_better(spark):
    pages = spark.createDataFrame([("a", "old", 1), ("b", None, 2), ("c", "kept", 3)], "url string, title string, n int")
    found = spark.createDataFrame([("a", "new"), ("b", " "), ("c", None), ("d", "other")], "url string, title string")
    assert {tuple(r) for r in composite.enriched(pages, found, ("title",)).collect()} == {("a", "new", 1), ("b", None, 2), ("c", "kept", 3)}


def test_enriched_has_a_row_for_each_fetch(spark):
    pages = spark.createDataFrame([("a", "old", 1), ("a", "", 2), ("b", "kept", 3)], "url string, title string, n int")
    found = spark.createDataFrame([("a", "one"), ("a", " "), ("a", "two")], "url string, title string")
    got = sorted(tuple(r) for r in composite.enriched(pages, found, ("title",)).collect())
    assert got == [("a", "", 2), ("a", "old", 1), ("a", "one", 1), ("a", "one", 2), ("a", "two", 1), ("a", "two", 2), ("b", "kept", 3)]


def test_evidence_is_not_found_in_folded_words(spark):
    rows = [(1, "what is the tuition fee", "eine bürste"), (2, "what is the tuition fee", "burs"), (3, "scholarship fee", "die bürs"), (4, "scholarship fee", "BURS")]
    rows = spark.createDataFrame([(*r, "u", "t") for r in rows], "query_id long, question string, content string, source_url string, page_title string")
    assert {r["query_id"] for r in composite.grounded(rows).collect()} == {2, 4}


def test_evidence_is_looked_for_in_whole_texts(spark):
    long = "word " * 20_000
    rows = [(1, "what is the tuition fee", long + "tuition"), (2, "what is the tuition fee", long), (3, "what is the tuition fee", "tuition " + long)]
    rows = spark.createDataFrame([(*r, "u", "t") for r in rows], "query_id long, question string, content string, source_url string, page_title string")
    assert {r["query_id"] for r in composite.grounded(rows).collect()} == {1, 3}
