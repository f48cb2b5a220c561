"""Cuts against plain slices of decoded texts, units of words, exact round trips."""

import hashlib
import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import ODD, docs

from corpusloom.llm import fill_in_middle as fim
from corpusloom.llm import oracle

TEXTS = ["", "a", "é", "\U0001f600", "a\x00b", "日本語のテキスト", "mixed é日\U0001f600 x" * 40, "<P", "x <S> y", "<M>", "< S >", "<" * 30, "line\nline\r\n\n", "é‍﻿"]


def plain_cut(text, key, share=fim.CUT_PERCENT):
    h = hashlib.sha256(key.encode()).hexdigest()
    a, b, c, d = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    if not text or c % 100 >= share or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    i, j = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = text[:i], text[i:j], text[j:]
    return (n, "spm", i, j - i, f"<S>{s}<P>{p}<M>{m}") if d % 100 < 20 else (n, "psm", i, j - i, f"<P>{p}<S>{s}<M>{m}")


def test_cuts_are_slices():
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice("ab é日\U0001f600\n<>PSM") for _ in range(r.randint(1, 300))) for _ in range(500)]
    for k, t in enumerate(texts):
        for key in (f"1:{k}", f"1:{k + 1000}"):
            n, form, p, m, out = fim.cut(t.encode(), key)
            assert (n, form, p, m, out.decode()) == plain_cut(t, key)


def test_selects_and_masks():
    r = random.Random(2)
    for size in (1, 2, 3, 64, 65, 1000, 4097):
        bits = [r.random() < 0.3 for _ in range(size)]
        bits[r.randrange(size)] = True
        number = sum(1 << i for i, b in enumerate(bits) if b)
        places = [i for i, b in enumerate(bits) if b]
        assert [fim.select(number, k + 1) for k in range(len(places))] == places
    assert fim.mask("aé".encode(), fim._CONTINUES) == 0b100


@pytest.mark.parametrize("text", ["one two  three\n", "  lead in", "   ", "x", "é日 \U0001f600"])
def test_units_of_words(text):
    ends = fim.unit_ends(text.encode(), "word")
    units = re.findall(r"^\s*\S+\s*|\S+\s*", text) or [text]
    at, want = 0, []
    for u in units:
        at += len(u.encode())
        want.append(at - 1)
    assert [fim.select(ends, k + 1) for k in range(ends.bit_count())] == want


def test_rows_and_round_trip(spark):
    rows = ODD + [(100 + i, t, "en", "a", 0) for i, t in enumerate(TEXTS)] + [(200, "long é" * 100_000, "en", "a", 0)]
    got = fim.round_trip(docs(spark, rows)).collect()
    want = []
    for doc_id, text, *_ in rows:
        n, form, p, m, out = plain_cut(text or "", f"1:{'' if doc_id is None else doc_id}")
        want.append((doc_id, n, form, p, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {g.form for g in got} == {"plain", "psm", "spm"}
    assert fim.round_trip(docs(spark, [])).collect() == []


def test_rows_keep_their_columns(spark):
    made = fim.transform(docs(spark, ODD), unit="word")
    assert made.count() == len(ODD) and made.select("row.*").columns == docs(spark, ODD).columns
    back = made.select(F.col("row.text").alias("text"), fim.restored(F.col("output"), F.col("form")).alias("back"))
    assert back.where(F.coalesce("text", F.lit("")) != F.col("back")).count() == 0
    with pytest.raises(ValueError):
        fim.transform(docs(spark, ODD), unit="line")


def test_broken_utf8_is_kept():
    for b in (b"\x80a", b"a\x80\x80", b"\xff\xfe", b"\xc3"):
        assert all(fim.select(fim.unit_ends(b), k + 1) < len(b) for k in range(fim.unit_ends(b).bit_count()))
        out = next(o for o in (fim.cut(b, f"1:{i}") for i in range(50)) if o[1] == "psm")
        p, rest = out[4].removeprefix(b"<P>").split(b"<S>")
        s, m = rest.split(b"<M>")
        assert p + m + s == b


@pytest.mark.parametrize("rows", [ODD + [(100 + i, t, "en", "a", 0) for i, t in enumerate(TEXTS) if "\x00" not in t], []])
def test_sql(spark, rows):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    cur = con.execute(oracle.fill_in_middle())
    names = [c[0] for c in cur.description]
    got = fim.round_trip(docs(spark, rows)).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, cur.fetchall()))
