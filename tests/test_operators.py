"""Operators over DataFrames on small tables."""

import json
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.operators import catalogue, chat, crawl, index, reports, retrieval
from corpusloom.operators.order import placed
from corpusloom.sources import files
from corpusloom.streaming import limiter


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", "old", 1), ("b", "old", 5)], "url string, title string, updated_at int")
    new = spark.createDataFrame([("a", "new", 2), ("b", "late", 4), ("c", "new", 1), ("b", "same", 5)], "url string, title string, updated_at int")
    once = index.upserted(old, new)
    assert {tuple(r) for r in once.collect()} == {("a", "new", 2), ("b", "same", 5), ("c", "new", 1)}
    assert {tuple(r) for r in index.upserted(once, new).collect()} == {tuple(r) for r in once.collect()}


def test_replace_and_cascade(spark):
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "page_id long, chunk_index int, content string")
    new = spark.createDataFrame([(1, 0, "z")], "page_id long, chunk_index int, content string")
    assert {tuple(r) for r in index.chunks_replaced(chunks, new).collect()} == {(1, 0, "z"), (2, 0, "c")}
    pages = spark.createDataFrame([(1, "x"), (2, None)], "page_id long, source string")
    left, kept = index.without_source(pages, chunks, "x")
    assert [r["page_id"] for r in left.collect()] == [2] and [r["page_id"] for r in kept.collect()] == [2]


def test_bootstrap_and_refresh(spark):
    ran = []
    assert index.bootstrap_if_empty(spark.range(0), lambda: ran.append(1)) and not index.bootstrap_if_empty(spark.range(1), lambda: ran.append(2)) and ran == [1]
    assert index.refresh([("a", lambda: ran.append("a")), ("b", lambda: ran.append("b"))]) == ["a", "b"] and ran == [1, "a", "b"]


def test_crawl(spark, tmp_path):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "url string, link string")
    got = {r["url"]: r["level"] for r in crawl.reached(links, spark.createDataFrame([("a",)], "url string"), 5).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert crawl.reached(links, spark.createDataFrame([("a",)], "url string"), 5, 2).count() == 2


@pytest.mark.parametrize("most", [0, 1, 7, 20])
def test_crawl_visits_in_the_order_of_a_queue(spark, most):
    from collections import deque

    r = random.Random(most)
    links = sorted({(f"p{r.randrange(40)}", at, f"p{r.randrange(60)}") for at in range(4) for _ in range(40)})
    links = [(u, i, to) for i, (u, _, to) in enumerate(links)]
    pages = {f"p{n}" for n in range(60) if n % 3}
    seeds = ["p1", "p2", "p3", "p1"]
    queue, seen, want, got = deque((u, 0) for u in seeds), set(), [], 0
    while queue and (not most or got < most):
        url, level = queue.popleft()
        if url in seen:
            continue
        seen.add(url)
        want.append((url, level, len(want) + 1, url in pages))
        if url in pages:
            got += 1
            if level < 3:
                queue.extend((to, level + 1) for u, _, to in links if u == url)
    fetches = spark.createDataFrame([(u, True) for u in pages], "url string, page boolean")
    rows = crawl.visited(spark.createDataFrame(links, "url string, place long, link string"), spark.createDataFrame(list(zip(seeds, range(4))), "url string, place int"), fetches, 3, most)
    assert sorted(map(tuple, rows.collect()), key=lambda x: x[2]) == want


def test_fetchable_passes_all_gates(spark):
    answers = spark.createDataFrame([("https://a.org/x", True, "text/html"), ("https://a.org/no/x", True, "text/html"), ("https://a.org/y", False, "text/html"), ("https://a.org/z", True, "image/png"), ("https://a.org/q", None, None), ("https://b.org/no/x", True, "application/xhtml+xml")], "url string, ok boolean, content_type string")
    rules_ = spark.createDataFrame([("a.org", "/no/")], "host string, prefix string")
    assert {r["url"] for r in crawl.fetchable(answers, rules_).collect()} == {"https://a.org/x", "https://b.org/no/x"}


def test_nearest_matches_brute_force(spark):
    r = np.random.default_rng(0)
    x, q = r.normal(size=(300, 8)), r.normal(size=(5, 8))
    x[7] = 0
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "chunk_id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(q)], "query_id long, variant int, embedding array<double>")
    got = {(h["query_id"], h["chunk_id"]) for h in retrieval.nearest(asked, chunks, 10).collect()}
    n = np.linalg.norm(x, axis=1)
    d = 1 - (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.where(n > 0, n, 1)
    assert got == {(i, int(j)) for i in range(5) for j in np.argsort(d[i], kind="stable")[:10]}


def test_nearest_leaves_odd_vectors_out(spark):
    """Unequal lengths in one shard, null and non-finite entries, on both sides."""
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [1.0, 1.0, 0.0])]
    odd = [(10, [1.0, 0.0, 0.0, 0.0, 0.0]), (11, [1.0]), (12, []), (13, None), (14, [1.0, None, 0.0]), (15, [nan, 0.0, 0.0]), (16, [inf, 0.0, 0.0])]
    chunks = spark.createDataFrame(good + odd, "chunk_id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(i, 0, v) for i, v in good[:1] + odd], "query_id long, variant int, embedding array<double>").coalesce(1)
    got = retrieval.nearest(asked, chunks, 5).orderBy("d", "chunk_id").collect()
    assert [(h["query_id"], h["chunk_id"], round(h["d"], 6)) for h in got] == [(1, 1, 0.0), (1, 3, 0.292893), (1, 2, 1.0)]
    assert retrieval.nearest(asked, chunks.where("chunk_id = 13"), 5).collect() == []


def brute_sums(terms, worth, k):
    out = set()
    for q in {q for q, _ in terms}:
        sums = {}
        for c, t, v in worth:
            if (q, t) in terms:
                sums[c] = sums.get(c, 0.0) + v
        best = sorted((-round(s, 6), c) for c, s in sums.items())[:k]
        out |= {(q, c, -s) for s, c in best}
    return out


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_best_sums_are_brute_force(spark, monkeypatch, k):
    """A word of all questions and all chunks, rare words, ties, questions without a hit; several blocks and shards."""
    monkeypatch.setattr(retrieval, "QUESTION_BLOCK", 7)
    monkeypatch.setattr(retrieval, "SHARD", 60)
    r = np.random.default_rng(k)
    worth = [(c, "the", 1.0 + c % 3 / 4) for c in range(300)] + [(int(c), f"w{w}", float(r.integers(1, 40)) / 8) for w in range(25) for c in r.choice(300, 4 + 3 * w, replace=False)]
    terms = {(q, "the") for q in range(20)} | {(q, f"w{w}") for q in range(20) for w in r.choice(25, 3, replace=False)} | {(50, "nothing")}
    found = retrieval.best_sums(spark.createDataFrame(sorted(terms), "query_id long, term string"), spark.createDataFrame(worth, "chunk_id long, term string, value double"), 300, k)
    assert {tuple(x) for x in found.collect()} == brute_sums(terms, worth, k)
    empty = spark.createDataFrame([], "chunk_id long, term string, value double")
    assert retrieval.best_sums(spark.createDataFrame(sorted(terms), "query_id long, term string"), empty, 0, k).collect() == []


def test_common_words_are_not_added_everywhere():
    """Once the rare words have filled the best, a word that all chunks hold is added to those only."""
    n = 10_000
    ids = np.concatenate([np.arange(n), np.arange(0, n, 100)])
    held = retrieval.Postings(ids, pa.array(["the"] * n + ["rare"] * (n // 100)), np.concatenate([np.full(n, 0.5), np.full(n // 100, 9.0)]))
    got, sums, added = held.best(["the", "rare"], 20)
    assert got.tolist() == list(range(0, 2000, 100)) and set(sums.tolist()) == {9.5} and added == 2 * (n // 100)
    assert held.best(["the"], 3)[0].tolist() == [0, 1, 2] and held.best([], 3)[2] == 0


def rows(spark, data):
    return spark.createDataFrame(data, "query_id long, question string, chunk_id long, content string, source_url string, page_title string, d_min double, ord int")


def test_rerank_keeps_distance(spark):
    got = {r["chunk_id"]: r for r in retrieval.reranked(rows(spark, [(1, "campus library hours", 1, "the campus library hours are long", "u", "t", 0.6, 2), (1, "campus library hours", 2, "nothing", "u", "t", 0.59, 1), (2, "alone here", 3, "alone here", "u", "t", 0.3, 1)])).collect()}
    assert got[1]["rerank_key"] < got[2]["rerank_key"] and got[1]["d_min"] == 0.6 and got[3]["rerank_key"] == 0.3


def test_threshold_and_relaxation(spark):
    data = [(1, "q", i, "c", "u", "t", 0.1 * i, i) for i in range(12)] + [(2, "q", 50, "c", "u", "t", 0.9, 1)] + [(3, "tuition fee", 60, "c", "u", "t", 0.9, 1), (3, "tuition fee", 61, "tuition is 5 usd", "u", "t", 0.95, 2)]
    got = retrieval.thresholded(rows(spark, data).withColumn("rerank_key", F.col("d_min"))).collect()
    assert sorted(r["chunk_id"] for r in got if r["query_id"] == 1) == list(range(7)) and not any(r["relaxed"] for r in got if r["query_id"] == 1)
    assert [(r["chunk_id"], r["relaxed"]) for r in got if r["query_id"] == 2] == [(50, True)] and [r["chunk_id"] for r in got if r["query_id"] == 3] == [61]


def test_blocked_pages_are_not_refilled(spark):
    hits = spark.createDataFrame([(1, 1), (1, 2)], "query_id long, chunk_id long")
    chunks = spark.createDataFrame([(1, "https://e.edu/news/1"), (2, "https://e.edu/a"), (3, "https://e.edu/b")], "chunk_id long, source_url string")
    assert [r["chunk_id"] for r in retrieval.without_blocked(hits, chunks).collect()] == [2]


def test_assembly_passes_over_what_does_not_fit(spark):
    data = [(1, 1, 10, "u1", "t", "a" * 60), (1, 2, 11, "u2", "t", "b" * 60), (1, 3, 12, "u2", "t", "c" * 30), (1, 4, 13, "u1", "t", "d" * 5), (1, 5, 14, "u1", "t", "e" * 1), (1, 6, 15, "u3", "t", "")]
    r = retrieval.assembled(spark.createDataFrame(data, "query_id long, rank int, chunk_id long, source_url string, page_title string, snippet string"), 100, 2).first()
    assert r["chunk_ids"] == [10, 12, 13] and r["context_chars"] == 95 and r["context"].startswith("[t]\naaa")


def test_effective_distance_terms(spark):
    cols = "question string, source_url string, page_title string, content string, real double, nominal double, name string, roster boolean"
    value = lambda *v: spark.createDataFrame([v], cols).select(retrieval.effective_distance().alias("x")).first()["x"]
    assert value("q", "u", "t", "c", 0.5, 0.6, None, False) == 0.5 and value("q", "u", "t", "c", None, 0.6, None, False) == 0.6 and value("q", "u", "t", "c", None, None, None, False) == 1.0
    assert value("q", "u", "t", "c", 0.5, 0.6, None, True) == 0.12
    assert value("software jobs", "u/events", "t", "c", 0.5, 0.6, None, False) == 0.64
    assert value("who", "u/academic-staff", "t", "Ann Lee", 0.5, 0.6, "Ann Lee", False) == 0.05 and value("who", "u/x", "t", "Ann Lee", 0.5, 0.6, "Ann Lee", False) == 0.12
    assert value("who", "u/commissions", "t", "Ann Lee", 0.5, 0.6, "Ann Lee", False) == 0.86
    assert value("course list", "u/x", "t", "c", 0.5, 0.6, None, False) == 0.74 and value("course list", "u/bologna/showpac", "t", "c", 0.5, 0.6, None, False) == 0.24
    assert value("where is it", "u/bologna", "t", "c", 0.5, 0.6, None, False) == 0.72 and value("q", "u/bologna", "t", "c", 0.5, 0.6, None, False) == 0.53
    assert value("computer engineering", "u", "t", "computer engineering", 0.5, 0.6, None, False) == 0.48


def test_effective_distance_knows_units_and_course_pages(spark):
    cols = "question string, source_url string, page_title string, content string, real double, nominal double, name string, roster boolean"
    hints = spark.createDataFrame([("computer-engineering", "31", "7001")], "entity string, unit string, sub_unit string")
    site = rules.Site(preferred=(("computer-engineering", "cursunit=7002"),))
    base, own = "https://o.example.edu/bologna/", "computer engineering"
    #: question, address, title, content and the terms that apply to a distance of 0.5
    table = [
        ("course list", "u/x", "About | it", "c", 0.24 + 0.20),
        (f"{own} courses", "u/x", "Course structure", "c", 0.22 - 0.10),  # the title names the catalogue
        (f"{own} courses", "u/x", "Information package", "c", 0.22 + 0.24),
        ("course list", base + "info", "Information package", "c", 0.08 - 0.10),
        (f"{own} outcomes of the syllabus", base + "x?curUnit=31&curSunit=7001", "t", "c", -0.10 - 0.16 - 0.20 - 0.14),
        (f"{own} learning outcomes", base + "x?curUnit=9", "t", "c", -0.10 + 0.24 - 0.16 + 0.50),
        (f"{own} learning outcomes", base + "x?curSunit=9", "t", own, -0.02 - 0.08 - 0.10 - 0.16 + 0.34),
        (f"{own} learning outcomes", base + "x?curSunit=9", "Course structure", "c", 0.22 - 0.10 + 0.24 - 0.16 + 0.34),
        (f"{own} learning outcomes", base + "x?curSunit=7001", "Course structure", "c", -0.10 - 0.16 - 0.14),
        (f"{own} courses", base + "progCourses.aspx?curUnit=31&curSunit=7001", "t", "c", -0.10 - 0.16 - 0.14 - 0.12 - 0.22),
        (f"{own} courses", base + "progCourses.aspx?curSunit=7002", "t", "c", -0.10 - 0.16 - 0.08 - 0.09 - 0.22),
        (f"{own} courses", base + "progCourseMatrix.aspx?curSunit=9", "t", "c", -0.10 - 0.16 - 0.08 - 0.16),
        ("medical school learning outcomes", base + "x?curUnit=9", "t", "c", -0.10 - 0.16),  # nothing is known of it
        ("international application", "u/graduate/x", "t", "c", 0.18),
        ("international application", "u/x", "t", "see /graduate/ too", 0.0),
    ]
    rows = retrieval.with_units(spark.createDataFrame([(*row[:4], 0.5, 0.6, None, False) for row in table], cols), hints)
    found = {(r["question"], r["source_url"], r["page_title"], r["content"]): r["d"] for r in rows.withColumn("d", retrieval.effective_distance(site, F.col("units"), F.col("sub_units"))).collect()}
    for *row, terms in table:
        assert found[tuple(row)] == pytest.approx(0.5 + terms, abs=1e-8), row


def test_unit_match_has_three_states(spark):
    rows = [("u?curUnit=1", True), ("u?curSunit=5", True), ("u?curunit=1&cursunit=9", True), ("u?curUnit=2&curSunit=9", False), ("u?curUnit=", None), ("u", None)]
    known = [F.array(F.lit("1")), F.array(F.lit("5"))]
    found = spark.createDataFrame(rows, "url string, want boolean").select("url", "want", retrieval.unit_match(F.col("url"), *known).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in found), found


def test_coverage_report(spark):
    e = spark.createDataFrame([(i, i, [1.0, float(i)]) for i in range(6)], "chunk_id long, page_id long, embedding array<double>")
    asked = e.where("chunk_id < 2").select(F.col("chunk_id").alias("query_id"), "embedding")
    found = reports.coverage(asked, e, 2)
    report = [tuple(r) for r in reports.coverage_report(found, e, asked, 2).collect()]
    one = {part: value for part, key, value in report if not key}
    assert one == {"top_n": "2", "question_count": "2", "page_count": "6"}
    of = lambda part: {int(key): value for p, key, value in report if p == part and key}
    never, least = of("pages_never_in_top_n"), of("min_cosine_distance_by_page")
    assert sorted([*never, *least]) == list(range(6)) and all(float(d) >= 0 for d in least.values())
    assert {q: len(json.loads(v)) for q, v in of("per_question").items()} == {0: 2, 1: 2}


def test_places_are_those_of_the_whole_order(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("n"), F.lit("x").alias("place2")).repartition(5)
    assert all(r["place"] == r["n"] + 1 for r in placed(rows, F.col("n")).collect())
    assert placed(rows.limit(0), F.col("n")).collect() == []


def test_fallback_looks_at_each_entitys_own_chunks(spark):
    chunks = [(i, f"https://example.edu/bologna/{'computer-engineering' if i >= 200 else 'computer-programming'}/{i}", "text") for i in range(210)]
    d = spark.createDataFrame(chunks, "chunk_id long, source_url string, content string")
    q = spark.createDataFrame([(1, "courses of computer engineering"), (2, "courses of computer programming"), (3, "hello")], "query_id long, question string")
    got = {(r["query_id"], r["chunk_id"]) for r in catalogue.fallback_chunks(q, d).collect()}
    assert got == {(1, 200 + i) for i in range(5)} | {(2, i) for i in range(5)}


def test_lexical_points_and_words_by_brute_force(spark):
    """Scores of all pairs, from the definition."""
    r = random.Random(4)
    words = ["campus", "address", "contact", "curriculum", "dean", "faculty", "lesson", "river", "stone", "cloud"]
    chunks = [(i, " ".join(r.choice(words) for _ in range(4)), r.choice(words), f"https://example.edu/{r.choice(['catalogue', 'page', 'news'])}/{i}") for i in range(120)]
    asked = [(1, "where is the campus address"), (2, "courses about river stone"), (3, "dean of the faculty"), (4, None), (5, "cloud river"), (6, "is it")]
    d = spark.createDataFrame(chunks, "chunk_id long, content string, page_title string, source_url string")
    q = spark.createDataFrame(asked, "query_id long, question string")
    site, want = rules.Site(), []
    for qid, question in asked:
        terms = set(re.findall("[a-z]{4,}", question or ""))
        if not terms:
            continue
        scored = []
        for cid, content, title, url in chunks:
            if "/news" in url:
                continue
            score = sum((t in content) + 2 * (t in title) + 2 * (t in url) for t in terms)
            score += sum(w for name, pattern, w in retrieval.POINTS if re.search(rules.INTENTS[name], question) and re.search(pattern or site.catalogue, f"{url} {title} {content}"))
            if score > 0:
                scored.append((cid, score))
        best = sorted(scored[:50], key=lambda x: (-x[1], x[0]))[:10]
        want += [(qid, cid, score, k) for k, (cid, score) in enumerate(best, 1)]
    got = retrieval.lexical(q, d, scanned=50, top=10).select("query_id", "chunk_id", "score", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_lexical_ranks_all_positive_chunks(spark):
    """The best chunk is the last of 300; another one's rows, in several parts of the table, count together."""
    chunks = [(i, "campus", "t", f"https://example.edu/page/{i}") for i in range(300)]
    chunks[299] = (299, "campus of the river", "river", "https://example.edu/page/299")
    chunks += [(298, "river", "t", "u")] * 3
    d = spark.createDataFrame(chunks, "chunk_id long, content string, page_title string, source_url string").repartition(7)
    q = spark.createDataFrame([(1, "campus river")], "query_id long, question string")
    got = retrieval.lexical(q, d, top=3).select("query_id", "chunk_id", "score", "rank").collect()
    assert sorted(map(tuple, got), key=lambda r: r[3]) == [(1, 298, 4, 1), (1, 299, 4, 2), (1, 0, 1, 3)]
    got = retrieval.lexical(q, d, scanned=2, top=3).select("chunk_id", "score").collect()
    assert sorted(map(tuple, got)) == [(0, 1), (1, 1)]


def test_conversations(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}" if i != 4 else " ") for i in range(9)], "conv_id long, turn long, role string, text string")
    r = chat.prior_questions(turns).first()
    assert r["current"] == "m8" and r["prior"] == ["m2", "m6"]
    h = chat.with_prompt(turns, spark.createDataFrame([(1, "PROMPT")], "conv_id long, prompt string")).orderBy("turn").collect()
    assert h[-1]["text"] == "PROMPT" and len(h) == 9
    s = spark.createDataFrame([("s1", "c1", 1), ("s2", "c2", 2)], "session_id string, client_id string, updated_at int")
    m = spark.createDataFrame([("s1", 0, "user", "x")], "session_id string, turn int, role string, content string")
    assert {r["session_id"]: len(r["messages"]) for r in chat.with_messages(s, m).collect()} == {"s1": 1, "s2": 0}
    left, kept = chat.deleted(s, m, "s1", "c2")
    assert left.count() == 2 and kept.count() == 1
    left, kept = chat.deleted(s, m, "s1", "c1")
    assert left.count() == 1 and kept.count() == 0
    asked, answered = spark.createDataFrame([("s1", "q")], "session_id string, content string"), spark.createDataFrame([("s1", "r", False)], "session_id string, reply string, ok boolean")
    assert chat.chat_turns(m, asked, answered).count() == 1 and chat.chat_turns(m, asked, answered.withColumn("ok", F.lit(True))).count() == 3


def test_limiter_does_not_count_rejected(spark, tmp_path):
    rows = [(1, i, i * 1_000_000) for i in range(8)] + [(2, 100, 0)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "user_id long, event_id long, at long").write.parquet(path)
    stream = spark.readStream.schema("user_id long, event_id long, at long").parquet(path)
    got = {r["event_id"]: r["allowed"] for r in limiter.run_to_table(spark, limiter.limited(stream, limit=2, seconds=3), str(tmp_path / "run")).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: True, 100: True}


def in_order(spark, tmp_path, batches, **how):
    """Runs the limiter over one file after the other, each a micro-batch, and returns what it allows and the keys in its state."""
    schema = "user_id long, event_id long, at long, path string"
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(source))
    for n, rows in enumerate(batches):
        spark.createDataFrame([(*r, "/api/chat/x")[:4] for r in rows], schema).coalesce(1).write.parquet(str(tmp_path / f"b{n}"))
        next((tmp_path / f"b{n}").glob("part-*")).rename(source / f"{n}.parquet")
        found = limiter.run_to_table(spark, limiter.limited(stream, **how), str(tmp_path / "run"))
    spark.conf.set(*limiter.STORE)
    state = spark.read.format("statestore").option("path", str(tmp_path / "run/state")).option("stateVarName", "last").load()
    return {r["event_id"]: r["allowed"] for r in found.collect()}, {r["key"]["user_id"] for r in state.collect()}


def test_limiter_over_micro_batches(spark, tmp_path):
    """A request of an earlier time in a later micro-batch is judged at the latest time of its key."""
    before, second = spark.conf.get(limiter.STORE[0]), 1_000_000
    try:
        first = [(1, 0, 10 * second), (1, 1, 11 * second), (2, 2, 10 * second)]
        late = [(1, 3, 9 * second), (1, 4, 12 * second + 500_000), (1, 5, 14 * second), (3, 6, 200 * second)]
        after = [(3, 7, 400 * second), (1, 8, 13 * second), (1, 9, 13 * second), (2, 10, -5 * second)]
        got, keys = in_order(spark, tmp_path, [first, late, after], limit=2, seconds=3)
    finally:
        spark.conf.set(limiter.STORE[0], before)
    # 3: at 11 s, with two before it; 4: both still count; 5: none does; 8 and 9: at 14 s
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False, 5: True, 6: True, 7: True, 8: True, 9: False, 10: True}
    assert keys == {1, 2, 3}


def test_idle_keys_leave_the_state(spark, tmp_path):
    before = spark.conf.get(limiter.STORE[0])
    try:
        got, keys = in_order(spark, tmp_path, [[(1, 0, 0), (1, 1, 0), (2, 2, 0)], [(3, 3, 0)], [(3, 4, 0), (1, 5, 0)]], limit=1, seconds=60, idle=0)
    finally:
        spark.conf.set(limiter.STORE[0], before)
    assert got == {0: True, 1: False, 2: True, 3: True, 4: True, 5: True} and 2 not in keys


def test_limiter_honours_a_prefix(spark, tmp_path):
    before = spark.conf.get(limiter.STORE[0])
    try:
        rows = [(1, k, k, "/api/chat/complete" if k % 2 else "/static/x") for k in range(6)] + [(1, 9, 9, None)]
        got, _ = in_order(spark, tmp_path, [rows], limit=2, seconds=60, prefix="/api/chat")
    finally:
        spark.conf.set(limiter.STORE[0], before)
    assert got == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False, 9: True}


def test_files(spark, tmp_path):
    (tmp_path / "q.txt").write_text("first\n\n  second  \n")
    assert [r["question"] for r in files.questions(spark, str(tmp_path / "q.txt")).collect()] == ["first", "second"]
    d = spark.createDataFrame([(1, "é"), (2, None)], "id long, t string")
    files.write_json_lines(d, str(tmp_path / "j"))
    assert sorted(map(tuple, files.json_lines(spark, str(tmp_path / "j"), "id long, t string").collect())) == [(1, "é"), (2, None)]
    files.write_report(spark.createDataFrame([("top_n", "", "2")], "part string, key string, value string"), str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first()["value"]) == {"part": "top_n", "key": "", "value": "2"}
    assert files.alive(spark)["ok"] and files.has_function(spark, "abs") and files.batches(spark.range(9), "id", 3, 2).count() == 2


def test_a_task_of_the_lexical_scan_passes_on_its_first_chunks_only(spark):
    texts = [(i, f"course of everything {i}", f"https://example.edu/page/{i}", "t", 0) for i in range(2000)] + [(3, "everything again", "https://example.edu/page/3", "t", 0)]
    texts = spark.createDataFrame([t[:4] + (0,) for t in texts], "chunk_id long, content string, url string, title string, earns int").repartition(2)
    asked = [(1, ["everything"], 0), (2, ["again", "course"], 0), (3, ["nothing"], 0)]
    got = retrieval._first_hits(texts, asked, 5).collect()
    assert len(got) <= 2 * 2 * 6  # two tasks, two questions with hits, five ids of which one is repeated
    first = {q: sorted({r["chunk_id"] for r in got if r["query_id"] == q})[:5] for q in (1, 2, 3)}
    assert first == {1: [0, 1, 2, 3, 4], 2: [0, 1, 2, 3, 4], 3: []}


def test_hints_of_entities_meet_candidates_without_a_shuffle(spark):
    rows = spark.range(10).select(F.lit("computer engineering courses").alias("question"))
    hints = spark.createDataFrame([("computer-engineering", "31", "7001"), ("nowhere", "9", "9")], "entity string, unit string, sub_unit string")
    found = retrieval.with_units(rows, hints)
    assert "Exchange hashpartitioning(_key" not in found._jdf.queryExecution().executedPlan().toString() and "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert {(tuple(r["units"]), tuple(r["sub_units"])) for r in found.collect()} == {(("31",), ("7001",))}


def test_queries_send_small_batches_to_workers(spark):
    from corpusloom import workers

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, str(1 << 28))
    workers.ship(spark)
    assert int(spark.conf.get(name)) == workers.BATCH_BYTES and retrieval.CELLS * 8 <= workers.BATCH_BYTES


def test_words_of_a_chunk_are_counted_in_one_pass(spark):
    rows = spark.createDataFrame([(1, "Über über İki the THE the ab", "The End"), (2, None, "only title"), (3, "x", None)], "chunk_id long, content string, page_title string")
    got = {r["chunk_id"]: (r["size"], {w["term"]: (w["tf"], w["more"]) for w in r["words"]}) for r in retrieval._counted(rows, "content", "page_title").collect()}
    assert got == {1: (6, {"über": (2, 0), "iki": (1, 0), "the": (3, 1), "end": (0, 1)}), 2: (0, {"only": (0, 1), "title": (0, 1)}), 3: (0, {})}


def test_candidates_embed_every_text_once(spark, tmp_path, monkeypatch):
    from pyspark.sql.types import ArrayType, DoubleType

    from corpusloom.functions import vectors
    from corpusloom.plans import retrieval as plans

    seen = tmp_path / "seen"
    seen.mkdir()
    rows = [(i, f"tuition of course number {i}", "en", "s") for i in range(40)] + [(40, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "what tuition has the course"), (2, "number"), (3, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    @F.pandas_udf(ArrayType(DoubleType()))
    def told(texts: pd.Series) -> pd.Series:
        import uuid

        (seen / uuid.uuid4().hex).write_text(str(sum("tuition of" in (x or "") for x in texts)))
        return pd.Series(vectors._hashed(texts))

    want = sorted(map(tuple, plans.effective_ranking(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(vectors, "hashed_embedding", told)
    assert sorted(map(tuple, plans.effective_ranking(spark, str(tmp_path)).collect())) == want and want
    assert sum(int(p.read_text()) for p in seen.iterdir()) == 40


def test_workers_count_asked_words_only(spark, monkeypatch):
    chunks = spark.createDataFrame([(1, "tuition tuition fee İstanbul", "fee news"), (2, "campus", "Tuition"), (3, None, None), (4, "the fee", "")], "chunk_id long, content string, page_title string")
    questions = spark.createDataFrame([(1, "tuition in istanbul"), (2, "fee news"), (3, None)], "query_id long, question string")
    told = {r.chunk_id: (r["size"], sorted(map(tuple, r.words))) for r in retrieval._counted(chunks, "content", "page_title", asked=frozenset({"tuition", "news"})).collect()}
    assert told == {1: (4, [("news", 0, 1), ("tuition", 2, 0)]), 2: (1, [("tuition", 0, 1)]), 3: (0, []), 4: (2, [])}
    rows = lambda: [sorted(map(tuple, f(questions, chunks.drop(*drop)).collect())) for f, drop in ((retrieval.full_text, ()), (retrieval.bm25, ("page_title",)))]
    found = rows()
    monkeypatch.setattr(retrieval, "TERM_BLOCK", 2)  # more terms than workers hold: all words are counted
    assert retrieval._few(spark.createDataFrame([("a",), ("b",), ("c",)], "term string")) is None and rows() == found and found[0] and found[1]
