"""Winnowed matches against every window of every text."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_llm import ODD, docs

from corpusloom.llm import decontaminate as dc
from corpusloom.llm import oracle
from corpusloom.llm.shingles import gram_hashes, word_hashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}
ITEMS = "item_id long, text string, doc_id string"


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(rows, items, span=10):
    windows = {}
    for item, text in items:
        own = words(text)
        size = min(span, len(own))
        for i in range(len(own) - size + 1) if size else ():
            windows.setdefault(tuple(own[i : i + size]), set()).add("" if item is None else str(item))
    sizes, out = {len(w) for w in windows}, []
    for doc_id, text, *_ in rows:
        own, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(own) - size + 1):
                if got := windows.get(tuple(own[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= got
        out.append((doc_id, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out))


def run(spark, rows, items, **how):
    table = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    return sorted(map(repr, map(tuple, dc.judge(docs(spark, rows), table, **how).collect())))


def planted(r):
    """Passages of all lengths around a span, at borders of texts, changed by a word, in small alphabets with many repeats."""
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "日本", "x1", "b"]
    text = lambda n, v=vocabulary: [r.choice(v) for _ in range(n)]
    items = [(i, " ".join(text(r.choice([1, 2, 3, 7, 9, 10, 11, 14, 40, 80])))) for i in range(40)] + [(900, "a " * 40), (901, "a b " * 30), (901, "other text of the same id, with some more words in it than ten"), (None, "an item that has no id of its own but has words"), (902, None), (903, " .,- ")]
    items += [(904 + i, items[8][1]) for i in range(3)]  # equal items
    rows = []
    for i in range(120):
        own = text(r.randint(0, 120))
        for _ in range(r.randint(0, 3)):
            source = words(r.choice(items)[1]) or ["w1"]
            a = r.randrange(len(source))
            part = source[a : a + r.choice([4, 9, 10, 11, 25, 100])]
            at = r.choice([0, len(own), r.randint(0, len(own))])
            own[at:at] = part
        rows.append((1000 + i, r.choice([" ", "\n", ", ", " - "]).join(w.upper() if r.random() < 0.2 else w for w in own), "en", "a", 0))
    return rows + [(2000, "a " * 5000, "en", "a", 0), (2001, "b a " * 60, "en", "a", 0), (2001, "no words in common", "en", "a", 0)] + rows[:2], items


@pytest.mark.parametrize("span, k", [(10, 5), (10, 10), (6, 1), (3, 2)])
def test_decontamination_is_brute_force(spark, span, k):
    rows, items = planted(random.Random(span * 100 + k))
    rows = ODD + rows
    assert run(spark, rows, items, span=span, k=k) == brute(rows, items, span)


def test_winnowing_guarantee():
    r = random.Random(4)
    for _ in range(200):
        shared = [f"w{r.randint(0, 3)}".encode() for _ in range(10)]
        a, b = ([f"w{r.randint(0, 3)}".encode() for _ in range(r.randint(0, 20))] + shared + [f"w{r.randint(0, 3)}".encode() for _ in range(r.randint(0, 20))] for _ in range(2))
        kept = [set(dc.grams(word_hashes(t), 10, 10, 5)[1].tolist()) for t in (a, b)]
        assert kept[0] & kept[1]


def test_kept_grams_in_blocks(monkeypatch):
    h = gram_hashes(word_hashes([f"w{i * i % 37}".encode() for i in range(5000)]), 5)
    want = sorted({max(j for j in range(i, i + 6) if h[j] == h[i : i + 6].min()) for i in range(len(h) - 5)})
    assert dc.kept_grams(h, 6).tolist() == want
    monkeypatch.setattr(dc, "BLOCK", 100)
    assert dc.kept_grams(h, 6).tolist() == want
    assert dc.kept_grams(np.zeros(3, np.uint64), 6).tolist() == []


def test_without_rows(spark):
    rows, items = planted(random.Random(7))
    assert run(spark, [], items) == [] and run(spark, rows, []) == brute(rows, [])


def test_clean_keeps_the_rest_whole(spark):
    rows, items = planted(random.Random(8))
    rows = ODD + rows
    table = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    kept = dc.clean(docs(spark, rows), table)
    assert kept.columns == docs(spark, rows).columns
    bad = [eval(x)[5] for x in (brute([row], items)[0] for row in rows)]
    assert sorted(repr((r.doc_id, r.text)) for r in kept.collect()) == sorted(repr(row[:2]) for row, b in zip(rows, bad) if not b)


@pytest.mark.parametrize("seed", [9, None])
def test_sql(spark, seed):
    rows, items = planted(random.Random(seed)) if seed else ([], [])
    rows = ODD + rows if seed else rows
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    con.register("benchmark", pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())}))
    assert sorted(map(repr, con.execute(oracle.decontamination()).fetchall())) == run(spark, rows, items)
