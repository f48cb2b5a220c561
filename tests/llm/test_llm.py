"""The operators of the subpackage on small fixtures: brute force, round trips, held-out accuracy, odd rows."""

import itertools
import random
import textwrap
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import ann, jaccard_join, licenses, mixing, oracle, quality_cnn, quality_rules, toxicity_crf, url_filter
from corpusloom.llm import sentencepiece_fst as sp
from corpusloom.llm import token_output as tok
from corpusloom.llm.simple8b import pack, unpack

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and long texts, ties, repeated rows.
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t ", "en", "a", 5), (4, "one", "en", "b", 3), (4, "one", "en", "b", 3), (5, "word " * 30_000, "en", "b", 150_000), (None, "no id here at all, is there", "en", None, 27), (6, "a   b é▁ \U0001f600\n\nc  d ", "en", "a", 15)]


def docs(spark, rows, clash=True):
    d = spark.createDataFrame(rows, DOCS)
    if clash:
        for c in ("label", "score", "_text", "_size", "size", "host", "a", "b", "bucket", "place", "rank", "digest", "_row", "row", "target"):
            d = d.withColumn(c, F.lit("x"))
    return d


@pytest.fixture(scope="module")
def prose():
    r = random.Random(3)
    syllables = ["th", "er", "on", "an", "re", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(900)]

    def text(n):
        return "\n".join(" ".join(r.choice(words) for _ in range(min(12, n - i))) for i in range(0, n, 12))

    return text


# Simple-8b and token files


@pytest.mark.parametrize("n", [0, 1, 5, 511, 512, 513, 3000])
@pytest.mark.parametrize("most", [1, 2, 300, 50_000, 2**32, 2**61, 2**64 - 1])
def test_simple8b_round_trip(n, most):
    r = np.random.default_rng(n)
    v = r.integers(0, most, n, dtype=np.uint64, endpoint=most == 2**64 - 1) if n else np.zeros(0, np.uint64)
    if n:
        v[r.random(n) < 0.3] = 0
    if n > 500:
        v[3:9] = (1 << 60) | 1  # looks like an escape
        v[100:450] = 0
    words, offsets = pack(v)
    assert (unpack(words, offsets, n) == v).all()


def test_token_files(spark, prose):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = ODD + [(100 - i, prose(40 + i), "en", "a", 1) for i in range(60)] + [(7, "don't  it's\n  x <|endoftext|>", "en", "a", 1)]
    got = {r["doc_id"]: r for r in tok.round_trip(docs(spark, rows).where("doc_id <> 4"), path).collect()}
    encoder, start = tok.WordEncoder(path), 0
    for doc_id, text in sorted((r[0], r[1] or "") for r in rows if r[0] not in (None, 4)):
        ids = np.append(encoder.numbers(text), np.uint32(0)).astype("<u4").tobytes()
        assert tuple(got[doc_id])[1:] == (start, len(ids) // 4, zlib.crc32(ids)), doc_id
        start += len(ids) // 4
    assert tok.round_trip(docs(spark, ODD), path).count() == len(ODD)
    assert tok.round_trip(docs(spark, []), path).collect() == []


def test_token_ids_are_the_library(prose):
    """A tokenizer as the library loads it; white space of all kinds between words, in one batch."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["a\n b", "c \nd", " x\n \ny", "a\n \nb", " ", "\n", " \n", "\n ", " a ", "\na\n", "it's 's\n's don't", "x <|endoftext|> y", "<|endoftext|>", ""]
    r = random.Random(5)
    atoms = [" ", " ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", " ", "​", "﻿", "a", "don't", "'s", "42", "!?", "é²ª", "你好", "\U0001f600", "Ᲊ", "<|endoftext|>"]
    texts += ["".join(r.choice(atoms) for _ in range(r.randint(1, 12))) for _ in range(3000)]
    texts += [prose(60) for _ in range(20)] + [a + s + b for a in ("x", "'s", "7") for b in ("'s", "é", "!") for s in (" ", "\n")]
    got = tok.WordEncoder(path).encode(pa.array(texts))
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


# SentencePiece


def test_sentencepiece_is_the_library(prose):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, machine = sentencepiece.SentencePieceProcessor(model_file=path), sp.Transducer(path)
    texts = [r[1] or "" for r in ODD[:5]] + ["a   b", " a b ", "<s> a</s>", "你好 世界 \U0001f600", "aaaa     b" + " " * 40, "\x00\x01 ﬁ"] + [prose(200) for _ in range(20)]
    for t in texts:
        ids = machine.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t)
        assert machine.decode(ids) == library.decode(library.encode(t))


def made_model(path, kind, charsmap=b"", bytes_too=False, trims=False):
    """A model file written piece by piece (no training): weights are sums of powers of two, so that no sum is rounded."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    r = random.Random(kind)
    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = kind, bytes_too
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = True, trims, True
    m.normalizer_spec.precompiled_charsmap = charsmap
    add = lambda piece, type_, score=0.0: m.pieces.add(piece=piece, type=type_, score=score)
    add("<unk>", sp.UNKNOWN), add("<s>", sp.CONTROL), add("</s>", sp.CONTROL)
    if bytes_too:
        for b in range(256):
            add(f"<0x{b:02X}>", sp.BYTE)
    long = {"".join(r.choice("abc▁") for _ in range(r.randint(2, 5))) for _ in range(60)}
    pieces = sorted({*"abcf▁", *(p for p in long if "▁" not in p[1:])})
    if kind == sp.BPE:  # merges need both halves
        pieces = [p for p in pieces if len(p) < 3 or p[:2] in pieces] + ["abc", "abca", "▁abc"]
    for i, p in enumerate(dict.fromkeys(pieces)):
        add(p, sp.NORMAL, -float(i) if kind == sp.BPE else -r.randint(1, 64) / 16)
    path.write_bytes(m.SerializeToString())
    return str(path)


@pytest.mark.parametrize("kind, bytes_too, trims, mapped", [(sp.UNIGRAM, False, False, False), (sp.UNIGRAM, True, True, True), (sp.BPE, True, False, True), (sp.BPE, False, True, False)])
def test_made_models_are_the_library(tmp_path, kind, bytes_too, trims, mapped):
    import sentencepiece

    charsmap = b""
    if mapped:
        from sentencepiece import sentencepiece_model_pb2 as pb

        rules = pb.ModelProto()
        rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
        charsmap = rules.normalizer_spec.precompiled_charsmap
        assert len(sp.character_map(charsmap)) > 1000
    path = made_model(tmp_path / "m.model", kind, charsmap, bytes_too, trims)
    library, machine, r = sentencepiece.SentencePieceProcessor(model_file=path), sp.Transducer(path), random.Random(2)
    for _ in range(3000):
        t = "".join(r.choice(["a", "b", "c", "ab", "bca", " ", "é", "ﬁ", "e\u0301", "\t", "\n", "\u3000", "Ａ", "①", "你", "\U0001f600"]) for _ in range(r.randint(0, 14)))
        assert np.frombuffer(machine.encode(t), "<u4").tolist() == library.encode(t), (t, library.encode(t, out_type=str))


def test_unigram_is_the_shortest_path(tmp_path):
    m = sp.Transducer(made_model(tmp_path / "u.model", sp.UNIGRAM))
    cost = lambda parts: sum(-m.score.get(p, -m.unknown_weight) for p in parts)
    for letters in itertools.chain.from_iterable(itertools.product("abcx", repeat=n) for n in range(1, 7)):
        t, n = "".join(letters), len(letters)
        cuts = itertools.chain.from_iterable(itertools.combinations(range(1, n), k) for k in range(n))
        paths = ([t[a:b] for a, b in zip((0, *c), (*c, n))] for c in cuts)
        assert cost(m.path(t)) == min(cost(p) for p in paths if all(x in m.ids or len(x) == 1 for x in p))


def test_sentencepiece_odd_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = sp.round_trip(docs(spark, ODD), path).collect()
    assert len(rows) == len(ODD) and {r["n_pieces"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    back = sp.decode(sp.encode(docs(spark, ODD, False), path), path, to="again").where("doc_id = 5").first()
    assert back["again"] == "word " * 30_000
    assert sp.encoded(docs(spark, []), path).collect() == []


# mixing


def brute_mix(rows):
    import hashlib

    sizes = [(d, s, len((t or "").split()) if t is None or t.isascii() else len(t.encode().split())) for d, t, _, s, _ in rows]
    total, names = sum(x[2] for x in sizes), sorted({x[1] for x in sizes}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    size = {s: sum(x[2] for x in sizes if x[1] == s) for s in names}
    target, free, left = {}, set(names), float(total)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        free -= over
    del hashlib
    return size, target


def test_mixing_meets_targets(spark, prose):
    r = random.Random(1)
    rows = [(i, prose(r.randint(1, 60)), "en", r.choice(["s1", "s1", "s1", "s2", "s3", "s4", None]), 1) for i in range(300)] + [(900, "x y z", "en", "tiny", 5)]
    size, target = brute_mix(rows)
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = Counter()
    source = {x[0]: x[3] for x in rows}
    for x in got:
        assert abs(x["target"] - target[source[x["doc_id"]]]) < 1e-6 and x["source_size"] == size[source[x["doc_id"]]]
        assert 0 <= x["taken"] <= 3 * x["size"]
        by[source[x["doc_id"]]] += x["taken"]
    assert all(by[s] == int(target[s] + 1e-9) for s in target)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs(spark, rows).repartition(7)).collect()))
    copies = mixing.mixed_copies(docs(spark, rows)).withColumn("n", F.size(F.split(F.trim("text"), r"\s+"))).groupBy("source").agg(F.sum("n")).collect()
    assert {x[0]: x[1] for x in copies} == dict(by)


def test_mixing_odd_rows(spark):
    assert mixing.mix(docs(spark, ODD)).count() == len(ODD)
    assert mixing.mixed_copies(docs(spark, ODD)).columns == docs(spark, ODD).columns
    assert mixing.mix(docs(spark, [])).collect() == [] and mixing.mixed_copies(docs(spark, [])).collect() == []


# quality rules, licences, URLs


def test_repeated_windows_and_measures(spark):
    def brute(t):
        w = (t or "").encode().split()
        g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        c, marks = Counter(g), set()
        for i, x in enumerate(g):
            if c[x] > 1:
                marks |= set(range(i, i + 5))
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        return len(w), sum(len(x.decode()) for x in w), sum((t or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(marks)

    texts = ["a b c d e a b c d e", "a b c d e f a b c d e", "x " * 40, "one\ntwo\none\n\n\n", "# $ <tag> | é", "p q r s t u v w x y z a b c"]
    rows = ODD + [(20 + i, t, "en", "a", 1) for i, t in enumerate(texts)]
    got = quality_rules.judge(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {r[0]: brute(r[1]) for r in rows}
    for x in got:
        m = want[x["doc_id"]]
        assert tuple(x[1:6]) == m
        assert x["base_failed"] == (m[0] < 10 or 100 * m[4] > 20 * m[0]) and (not x["base_failed"] or not x["kept"])
    assert quality_rules.judge(docs(spark, [])).collect() == []


def test_frequent_lines_deplete(spark, prose):
    line = "this very line stands in all the documents of one host again"
    rows = [(i, line + "\n" + " ".join(f"w{i}x{k}" for k in range(3)), "en", "h", 1) for i in range(40)]
    rows += [(100 + i, line + "\n" + prose(200) + f" end{i}", "en", "h", 1) for i in range(5)]
    rows += [(200 + i, "copied " * 3 + "text of ten words or more, copied very often here", "en", "k", 1) for i in range(50)]
    got = {x["doc_id"]: x["kept"] for x in quality_rules.judge(docs(spark, rows), count_by="texts").collect()}
    assert not any(got[i] for i in range(40)) and all(got[100 + i] for i in range(5)) and all(got[200 + i] for i in range(50))


def test_frequent_lines_of_documents_and_of_rows_without_id(spark, prose):
    """Copies condemn each other where documents are counted; rows without an id lose lines like any others."""
    line = "this very line stands in all the documents of one host again"
    tail = lambda i: line + "\n" + " ".join(f"w{i}x{k}" for k in range(3))
    rows = [(i, tail(i), "en", "h", 1) for i in range(30)] + [(None, tail(100 + i), "en", "h", 1) for i in range(30)] + [(None, tail(100), "en", "h", 1)] * 2
    rows += [(200 + i, "ten words that are the same in each of the copies, and some more", "en", "k", 1) for i in range(50)] + [(500, "one document whose row is repeated in the table many times over", "en", "r", 1)] * 50
    for count_by, copies_stay in (("documents", False), ("texts", True)):
        got = quality_rules.judge(docs(spark, rows), count_by=count_by).collect()
        assert len(got) == len(rows)
        assert all((x["words_left"], x["kept"]) == (3, False) for x in got if x["doc_id"] is None or x["doc_id"] < 30)
        assert all(x["kept"] is copies_stay for x in got if x["doc_id"] and 200 <= x["doc_id"] < 500)
        assert all(x["kept"] for x in got if x["doc_id"] == 500)
    same_rows(quality_rules.judge(docs(spark, rows, clash=False), count_by="texts"), oracle.quality(), {"documents": docs(spark, rows, clash=False)})


def test_licenses(spark):
    mit = licenses.KNOWN[0][1]
    variant = "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ,").replace("\n", "\n\n")
    british = "This work is LICENCED under the GNU General Public Licence, version 3"
    rows = [(10, variant, "en", "a", 1), (11, "some prose\n" + british + "\nmore", "en", "a", 1), (12, british, "en", "a", 1), (13, "Licensed otherwise", "en", "a", 1)]
    got = {x["doc_id"]: x for x in licenses.scan(docs(spark, rows + ODD)).collect()}
    assert got[10]["text_license"] == "MIT" and got[12]["text_license"] == "GPL-3.0"
    assert (got[11]["text_license"], got[11]["notice_lines"], got[11]["licenses"]) == (None, 1, "GPL-3.0")
    assert got[13]["licenses"] == "" and got[1]["text_license"] is None
    assert licenses.scan(docs(spark, [])).collect() == []
    assert len(licenses.scan(docs(spark, rows + ODD)).collect()) == len(rows + ODD)


def test_license_files(spark):
    """Titles, copyright lines, wrapped lines and repeated rows; long licences where this machine has their texts."""
    known = dict(licenses.KNOWN[:8])
    wrapped = lambda t: "\n\n".join(textwrap.fill(p, 70) for p in t.split("\n"))
    texts = {
        1: ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2020-2021 Some One\nAll rights reserved.\n\n" + wrapped(known["MIT"])),
        2: ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2019, X\n\n" + wrapped(known["BSD-3-Clause"])),
        3: ("ISC", "ISC License\n\n(c) 2001 Y. All rights reserved.\n" + wrapped(known["ISC"])),
        4: ("BSD-2-Clause", wrapped(known["BSD-2-Clause"])),
        5: (None, wrapped(known["MIT"]) + "\nand more"),
    }
    for i, (name, _, _) in enumerate(licenses.LONG):
        file = Path("/usr/share/common-licenses") / name.replace("GPL-3.0", "GPL-3").replace("GPL-2.0", "GPL-2")
        if name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "LGPL-2.1") and file.exists():
            texts[10 + i] = (name, file.read_text())
    header = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    rows = [(i, t, "en", "a", 1) for i, (_, t) in texts.items()] * 3 + [(None, texts[1][1], None, None, 1)] * 2 + [(99, "# a\n\n" + header + "\n\n# b", "en", "a", 1)]
    got = licenses.scan(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] == 99:
            assert (r["text_license"], r["notice_lines"], r["licenses"]) == (None, 1, "GPL-3.0-or-later")
        else:
            assert r["text_license"] == texts[r["doc_id"] or 1][0], r["doc_id"]


def test_urls(spark):
    urls = ["https://a.example.com/en/71", "https://example.com/en/8", "http://X.ORG/es/1?q", "ftp://b.example.net/de/8", "no scheme", None, "https://h.net#/de/", "https://badcom/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("bad", F.lit(2))
    labels = spark.createDataFrame([(71, 1, 0), (None, None, None), (8, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, labels).collect()}
    assert got[0] == ("a.example.com", "/en/71", "example.com/en/7", "allow") and got[1][2:] == ("com/en/", "block")
    assert got[2] == ("x.org", "/es/1", "org/es/", "block") and got[3][2:] == ("example.net/de/8", "block")
    assert got[4][:3] == ("", "", None) and got[5][:3] == ("", "", None) and got[6] == ("h.net", "", None, "allow") and got[7][2] is None
    assert url_filter.judge(pages.limit(0), labels).collect() == []


def test_rules_are_those_of_the_contract(spark):
    said = {("com", "/en/"): "block", ("example.com", "/en/7"): "allow", ("net", "/de/"): "allow", ("example.net", "/de/8"): "block", ("org", "/es/"): "block"}
    assert {(h, p): v for h, p, v in url_filter.RULES} == said and len(url_filter.RULES) == len(said)
    # a domain whose pages are all bad: without the rule its reputation would block it
    rows = [(k, f"http://bad.net/{'de' if k % 2 else 'fr'}/{k}") for k in range(200)] + [(200, "http://a.example.net/de/81")]
    pages, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(k, 0, 1) for k in range(200)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, labels).collect()}
    assert got[1] == ("net/de/", "allow") and got[2] == (None, "block") and got[200] == ("example.net/de/8", "block")
    same_rows(url_filter.judge(pages, labels), oracle.url_judge(), {"pages": pages, "labels": labels})


def test_unseen_hosts_have_their_domains_prior(spark):
    rows = [(i, f"http://h{i % 40}.bad.com/xx/{i}") for i in range(200)] + [(i, f"http://g{i % 40}.good.com/xx/{i}") for i in range(200, 400)]
    rows += [(900, "http://new.bad.com/p"), (901, "http://new.good.com/p"), (902, "http://a.other.com/p"), (903, "http://b.co.uk/p"), (904, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 200), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_filter.judge(pages, labels).collect()}
    assert got[900]["verdict"] == "block" and got[900]["bad_rate"] > 0.9 and got[901]["verdict"] == "allow" and got[901]["bad_rate"] < 0.1
    assert all(got[i]["verdict"] == "allow" and 0.3 < got[i]["bad_rate"] < 0.7 for i in (902, 903, 904))
    one = spark.createDataFrame([("a.b.co.uk",), ("u@x.co.uk:8080",), ("1.2.3.4:80",), ("w.example.com.",), ("localhost",), ("",)], "host string")
    found = one.select(*url_filter.suffix_and_domain(F.col("host"))).collect()
    assert [tuple(r) for r in found] == [("co.uk", "b.co.uk"), ("co.uk", "x.co.uk"), ("1.2.3.4", "1.2.3.4"), ("com", "example.com"), ("localhost", "localhost"), ("", "")]


def test_reputation_shrinks(spark):
    counts = spark.createDataFrame([("bad.x.com", 200, 190), ("new.x.com", 1, 1), ("good.y.com", 300, 10), ("g.z.org", 400, 20)], "host string, pages long, bad long")
    got = {r["host"]: r for r in url_filter.reputation(counts).collect()}
    assert got["bad.x.com"]["lower_bound"] > 0.8 and got["new.x.com"]["bad_rate"] < 1 and got["new.x.com"]["lower_bound"] < got["bad.x.com"]["lower_bound"] and got["good.y.com"]["bad_rate"] < 0.1


def test_labels_go_to_pages_that_end_in_the_id(spark):
    urls = ["http://a.com/en/5", "http://b.com/en/5/more", "http://c.com/x?u=http://q/en/5", "http://d.com/5", "http://e.com/EN/5#top", "http://f.com/en/5?q=1", "http://g.com/en/x5", "http://h.com/en/5\n", "http://i.com/99999999999999999999", "http://5"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(5, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r["host"]: (r["pages"], r["bad"]) for r in url_filter.outcomes(pages, labels).collect()} == {h: (1, 1) for h in ("a.com", "d.com", "e.com", "f.com")}
    same_rows(url_filter.judge(pages, labels), oracle.url_judge(), {"pages": pages, "labels": labels})


def test_few_labels_do_not_block_other_hosts(spark):
    rows = [(k, f"http://one.bad.com/{k}") for k in range(3)] + [(100 + k, f"http://h{k}.other.org/") for k in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for labels in ([(0, 0, 0)], [(0, 0, 0), (1, 0, 0), (2, 0, 1)]):
        marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        got = url_filter.judge(pages, marks).collect()
        assert all(r["verdict"] == "allow" and r["bad_rate"] < 0.5 for r in got if r["page_id"] >= 100)
        assert {r["verdict"] for r in got if r["page_id"] < 100} == {"block" if len(labels) == 3 else "allow"}
        same_rows(url_filter.judge(pages, marks), oracle.url_judge(), {"pages": pages, "labels": marks})


# near duplicates


def brute_components(rows, n, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def hard_rows():
    """Groups of near copies of all degrees, a chain, a passage in many documents, few words, exact copies."""
    r = random.Random(1)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    base = [r.choice(words) for _ in range(200)]
    for _ in range(150):
        t = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6, 8])):
            t[r.randrange(200)] = r.choice(words)
        texts.append(" ".join(t))
    chain = [r.choice(words) for _ in range(150)]
    for _ in range(50):
        texts.append(" ".join(chain))
        for _ in range(2):
            chain[r.randrange(150)] = r.choice(words)
    passage = " ".join(r.choice(words) for _ in range(60))
    texts += [passage + " " + " ".join(r.choice(words) for _ in range(r.choice([0, 3, 5, 6, 40]))) for _ in range(80)]
    texts += [" ".join(r.choice("abc") for _ in range(30)) for _ in range(40)] + [None, "", "  ", "one", "One", "one two", "ONE two"]
    texts += [" ".join(r.choice(words) for _ in range(r.randrange(3, 60))) for _ in range(60)]
    return list(enumerate(texts))


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_jaccard_join_is_exact(spark, n, percent):
    rows = hard_rows()
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).withColumn("n", F.lit(1)).withColumn("region", F.lit(1)).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(d, n, percent).collect()}
    assert got == brute_components(rows, n, percent)


def test_jaccard_join_repeated_rows_and_ids(spark, prose):
    """All rows twice; ids with several texts, which link by any of them; brute force over all pairs of texts."""
    near = [prose(120) for _ in range(6)]
    rows = [(2 * k + j, t + f" end{j}") for k, t in enumerate(near) for j in (0, 1)]  # six near pairs, of equal shape
    rows += [(20, prose(90)), (21, prose(90))] + [(30, prose(80))]
    rows += [(22, rows[-3][1]), (22, rows[-2][1]), (30, near[5] + " end2")]  # 22 has the texts of 20 and 21, 30 a copy of 10
    rows += rows
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(3)
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = t.encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    root = {i: i for i, _ in rows}
    for _ in root:
        for x, y in itertools.combinations(sets, 2):
            if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = rows[x][0], rows[y][0]
                root[a] = root[b] = min(root[a], root[b])
        if all(root[i] == i or root[root[i]] == root[i] for i in root):
            break
    got = jaccard_join.classes(d, 5, 80).collect()
    assert len(got) == len(rows) and {(r["doc_id"], r["component_id"]) for r in got} == set(root.items())
    kept = sorted(r["doc_id"] for r in jaccard_join.distinct_documents(d, 5, 80).collect())
    assert kept == sorted(set(root.values())) == [0, 2, 4, 6, 8, 10, 20]


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_jaccard_join_of_a_large_group(spark, n, percent):
    """Near copies of one text, most of them linked with it or with nothing, edits that differ or are shared by a few:
    the regions are divided more than once."""
    r = random.Random(9)
    words = [f"v{i}" for i in range(3000)]
    base, texts = [r.choice(words) for _ in range(150)], []
    shared = [(r.randrange(150), r.choice(words)) for _ in range(30)]
    for _ in range(700):
        t = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 8, 12])):
            at, word = r.choice(shared) if r.random() < 0.3 else (r.randrange(150), r.choice(words))
            t[at] = word
        texts.append(" ".join(t))
    rows = list(enumerate(texts))
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(3)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.classes(d, n, percent).collect()}
    assert got == brute_components(rows, n, percent)


def test_jaccard_join_odd_rows(spark):
    got = jaccard_join.classes(docs(spark, ODD), 3, 90).collect()
    assert len(got) == len(ODD) and {r["component_id"] for r in got if r["doc_id"] is None} == {None}
    long, more = "word " * 30_000, [(None, ODD[6][1], "en", None, 1), (None, " ", None, None, 1), (None, None, None, None, None), (None, None, None, None, None)]
    kept = jaccard_join.distinct_documents(docs(spark, [*ODD, *more, (50, long, "en", "b", 1), (None, long, "en", "b", 1)]))
    # a copy without an id goes; of two equal texts without one, one stays; rows with neither id nor words stay
    assert Counter(r["doc_id"] for r in kept.collect()) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, None: 4} and kept.columns == docs(spark, ODD).columns
    assert jaccard_join.classes(docs(spark, []), 3, 90).collect() == []


# classifiers


def labelled(prose, n=500):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 5 == 1
        t = prose(r.randint(30, 200))
        if bad:
            w = t.split()
            t = r.choice([" | ".join(w), " ".join(x + r.choice(["%%%", "$$$", "###"]) for x in w), " ".join(" ".join([x] * 10) for x in w[:20])])
        if toxic:
            w = t.split(" ")
            for _ in range(6):
                w.insert(r.randrange(len(w)), r.choice(["moron", "zonk", "blarg"]))
            t = " ".join(w)
        rows.append((i, t, "en", "a", len(t)))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_classifiers_on_held_out_rows(spark, prose):
    rows, labels = labelled(prose)
    d, marks = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {x[0]: x for x in labels}
    for run, k, least in ((quality_cnn.classify, 1, 0.93), (toxicity_crf.classify, 2, 0.97)):
        got = run(d, marks).collect()
        assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got)
        own = [x for x in got if x["held_out"]]
        assert {x["doc_id"] for x in own} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
        assert np.mean([x["predicted"] == truth[x["doc_id"]][k] for x in own]) >= least


def test_quality_score_is_brute_force():
    """Every filter at every place of every text by itself, overlapping chunks, padding, texts of all lengths."""
    r = np.random.default_rng(7)
    q = quality_cnn
    net = q.Network(r.normal(0, 0.4, (q.WIDTH, 256, q.FILTERS)).astype(np.float32), r.normal(0, 1, q.FILTERS), r.normal(0, 0.3, 3 * q.FILTERS + 1), 0.2)

    def brute(text):
        size = -(-(len(text) + q.WIDTH) // q.HALF) * q.HALF
        x = [0] * (q.WIDTH - 1) + list(text) + [0] * (size - len(text))
        response = np.array([sum(net.tables[j][x[p + j]].astype(float) for j in range(q.WIDTH)) for p in range(size)])
        starts = range(0, max(size - 2 * q.HALF, 0) + 1, q.HALF)
        chunks = np.maximum(np.array([response[a : a + 2 * q.HALF].max(axis=0) for a in starts]) + net.bias, 0)
        z = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0), chunks.min(axis=0), [np.log(len(chunks))]]) @ net.out + net.base
        return 1 / (1 + np.exp(-z))

    texts = [bytes(r.integers(1, 256, n, dtype=np.uint8)) for n in (0, 1, 5, 121, 122, 123, 128, 250, 300, 1000, 3000)]
    got = q.scored(net, texts, net.pairs())
    assert np.allclose(got, [brute(t) for t in texts], atol=1e-5)
    assert np.allclose(got[::-1], q.scored(net, texts[::-1], net.pairs()), atol=1e-6)  # neighbours in a batch do not matter
    long = bytes(r.integers(1, 256, q.SLAB + 777, dtype=np.uint8))
    assert abs(q.scored(net, [long, b"x"], net.pairs())[0] - brute(long)) < 1e-5
    top, place = q.pooled_with_places(q.laid_out([long])[0], net.tables)
    assert np.allclose(top, q.pooled(q.laid_out([long])[0], net.pairs()), atol=1e-5) and (place // q.HALF == np.arange(len(place))[:, None]).all()


def test_toxicity_score_is_brute_force():
    """Marginals from all sequences of tags of whole documents, and the score and spans that follow."""
    field = toxicity_crf.Field({b"wbad": 2.5, b"wworse": 4.0, b"wfine": -1.0, b"sbad": 0.3}, -1.0, np.array([[0.0, -0.5], [-0.7, 0.9]]))
    for text in ("", "fine", "bad", "fine bad worse fine", "worse, fine fine bad bad fine worse fine", "a b c d e bad"):
        tokens = text.encode().split()
        e = [field.emission(t) for t in tokens]
        weights = {tags: np.exp(sum(x for x, y in zip(e, tags) if y) + sum(field.transitions[a, b] for a, b in zip(tags, tags[1:]))) for tags in itertools.product((0, 1), repeat=len(e))}
        z = sum(weights.values())
        p = np.array([sum(w for t, w in weights.items() if t[i]) / z for i in range(len(e))])
        scores, spans = toxicity_crf.Tagger(field).scored([text.encode()])
        assert abs(scores[0] - max(p.max(initial=0), 1 - np.prod(1 - p * p))) < 1e-9
        assert {text[s["start"] : s["end"]] for s in spans[0]} == {" ".join(t.decode() for t, _ in g) for high, g in itertools.groupby(zip(tokens, p), key=lambda x: x[1] >= 0.5) if high}


def test_toxic_spans_and_windows():
    r = random.Random(2)
    plain = lambda: " ".join(r.choice(["you", "go", "nice", "day", "is", "it", "my", "dear", "friend", "now"]) for _ in range(8))
    rows = [f"{plain()} moron {plain()}".encode() if i % 2 == 0 else plain().encode() for i in range(80)]
    field = toxicity_crf.train(rows, [1, 0] * 40)
    scores, spans = toxicity_crf.Tagger(field).scored(["é you moron. go".encode(), b"", b"nice day"])
    assert scores[0] > 0.5 > scores[2] and scores[1] == 0 and spans[0] == [{"start": 6, "end": 12}] and spans[1] == []
    tagger, e = toxicity_crf.Tagger(field), np.random.default_rng(0).normal(-2, 3, 3000)
    tagger.known = {str(k).encode(): e[k] for k in range(3000)}
    cut = tagger.marginals([b" ".join(str(k).encode() for k in range(3000))])[0]
    whole = toxicity_crf.forward_backward(np.exp(e)[:, None], tagger.a, np.ones((3000, 1), bool))[0][:, 0]
    assert abs(cut - whole).max() < 1e-8


def test_windows_of_sticky_fields_are_exact():
    """Transitions under which a token tells what stands thousands of tokens away."""
    field = toxicity_crf.Field({b"wsure": 9.0}, 0.0, np.array([[4.0, -6.0], [-6.0, 4.0]]))
    lengths = (1, 511, 512, 513, 1024, 1025, 5001)
    texts = [b" ".join([b"sure"] + [b"x"] * (n - 1)) for n in lengths] + [b" ".join([b"x"] * 3000 + [b"sure"] + [b"x"] * 2000), b""]
    tagger = toxicity_crf.Tagger(field)
    for text, got in zip(texts, tagger.marginals(texts)):
        e = np.array([field.emission(t) for t in text.split()])
        if len(e):
            whole = toxicity_crf.forward_backward(np.exp(e)[:, None], tagger.a, np.ones((len(e), 1), bool))[0][:, 0]
            assert abs(got - whole).max() < 1e-9
    r = np.random.default_rng(3)
    for a in (field.transitions, np.array([[0.0, 1.0], [-2.0, 0.5]])):
        tagger = toxicity_crf.Tagger(toxicity_crf.Field({}, 0.0, a))
        e = r.normal(0, 2, 4000)
        tagger.known = {str(k).encode(): e[k] for k in range(4000)}
        own = [r.choice(4000, n) for n in (3, 700, 512, 1536, 2000)]
        for at, got in zip(own, tagger.marginals([b" ".join(str(k).encode() for k in ks) for ks in own])):
            whole = toxicity_crf.forward_backward(np.exp(e[at])[:, None], tagger.a, np.ones((len(at), 1), bool))[0][:, 0]
            assert abs(got - whole).max() < 1e-9


def test_forward_backward_is_brute_force():
    r = np.random.default_rng(1)
    odds, a = np.exp(r.normal(0, 1, 6)), np.exp(r.normal(0, 1, (2, 2)))
    weights = {tags: np.prod([odds[i] if t else 1 for i, t in enumerate(tags)]) * np.prod([a[x, y] for x, y in zip(tags, tags[1:])]) for tags in itertools.product((0, 1), repeat=6)}
    z = sum(weights.values())
    got = toxicity_crf.forward_backward(odds[:, None], a, np.ones((6, 1), bool))[0][:, 0]
    assert np.allclose(got, [sum(w for t, w in weights.items() if t[i]) / z for i in range(6)])


def test_classifiers_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(4, 1, 0), (None, None, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        for module in (quality_cnn, toxicity_crf):
            assert module.classify(docs(spark, ODD), labels).count() == len(ODD)
            assert module.kept(docs(spark, ODD), labels).columns == docs(spark, ODD).columns
            assert module.classify(docs(spark, []), labels).collect() == []
    assert quality_cnn.classify(docs(spark, ODD), none).select("score").distinct().collect()[0][0] == 0.5


# vectors


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit("x")).withColumn("rank", F.lit(1))


def test_ann_recall_and_scores(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 32)).astype(np.float32)
    x[:900] = x[0] + 0.01 * r.normal(size=(900, 32))  # a third in one place
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 32), (5002, [float("nan")] * 32), (5003, [1.0]), (5004, [None] * 32), (5005, [])]
    got = ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()
    y = x.astype(np.float64)
    hits, want = 0, 0
    for q in range(0, 3000, 20):
        s = y @ y[q]
        s[q] = -np.inf
        own = sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])
        assert [g["rank"] for g in own] == list(range(1, 21))
        assert all(abs(g["score"] - s[g["vec_id"]]) < 1e-9 for g in own) and [g["score"] for g in own] == sorted((g["score"] for g in own), reverse=True)
        hits += sum(g["score"] >= np.sort(s)[-20] - 1e-9 for g in own)
        want += 20
    assert hits / want >= 0.9


def test_ann_repeated_queries_and_groups(spark):
    """Query rows that share an id are asked once; lists are dealt to many groups of few vectors."""
    r = np.random.default_rng(4)
    x = r.normal(size=(1500, 16)).astype(np.float32)
    x[:600] = x[0]  # one list longer than a group
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, x[20].tolist()), (40, x[41].tolist())] * 2
    own, y = {q: x[q].astype(np.float64) for q in range(0, 1500, 20)}, x.astype(np.float64)
    own[40] = np.array(min(x[40].tolist(), x[41].tolist()))
    for shard in (64, 16_384):
        got = ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, probe_share=1.0, shard=shard).collect()
        assert len(got) == 20 * 75
        hits = 0
        for q, v in own.items():
            s = np.concatenate([y, y[[20, 41, 20, 41]]]) @ v
            ids = np.array([i for i, _ in rows])
            s[ids == q] = -np.inf
            best = ids[np.lexsort((ids, -s))[:20]].tolist()
            found = [g["vec_id"] for g in sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])]
            hits += sum((Counter(best) & Counter(found)).values())
        assert hits >= 0.97 * 20 * 75


def test_ann_few_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (3, [0.5, 0.5]), (2, [0.5, -0.5]), (1, [0.5, 1.0]), (20, [0.0, 1.0])]
    got = [(g["rank"], g["vec_id"]) for g in ann.search(vectors(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 3), (4, 20)]
    assert ann.search(vectors(spark, []), F.col("vec_id") == 0).collect() == []


# the pipeline


def test_pipeline_stages_keep_columns(spark, prose, tmp_path):
    import corpus_pipeline

    rows, labels = labelled(prose, 120)
    clean = [(1000 + i, prose(60), "en", "s%d" % (i % 3), 1) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(rows + clean + [clean[0][:1] + clean[0][1:]] + ODD[:5], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == d.columns
        out.write.parquet(f"{tmp_path}/{name}")
        d = spark.read.parquet(f"{tmp_path}/{name}")
    assert d.where("not decoded_same").count() == 0 and d.count() > 0
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []


def same_rows(df, sql, tables):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name, table in tables.items():
        con.register("_" + name, table.toArrow())
        con.execute(f"create table {name} as select * from _{name}")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    want = sorted(repr([plain(v) for v in row]) for row in cur.fetchall())
    assert sorted(repr([plain(r[c]) for c in names]) for r in df.collect()) == want


@pytest.mark.parametrize("data", [ODD, []])
def test_sql_on_odd_rows(spark, data):
    d = docs(spark, data, clash=False)
    tables = {"documents": d}
    same_rows(mixing.mix(d), oracle.mixing(), tables)
    same_rows(quality_rules.judge(d, count_by="texts"), oracle.quality(), tables)
    same_rows(licenses.scan(d), oracle.license_scan(), tables)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables here")
def test_sql_on_the_test_tables(spark):
    from corpusloom.llm import queries

    data = "/root/testdata/sf0.001"
    tables = {t: spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "pages", "labels", "benchmark")}
    for name, sql in queries.oracle_sql().items():
        same_rows(queries.queries()[name](spark, data), sql, tables)


def test_sql_of_urls(spark):
    urls = [None, "", "x://", "http://a.co.uk/en/1", "http://b.co.uk/en/2", "http://new.co.uk:80/p", "http://me@Deep.New.co.uk./p", "http://1.2.3.4/en/3", "http://9.2.3.4/q", "http://c.org/es/4", "http://z.c.org/q", "http://a.co.uk/en/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for rows in ([(1, 0, 0), (2, 1, 0), (3, 0, 1), (4, 1, 0), (None, 0, 0), (2, None, None)], []):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        same_rows(url_filter.judge(pages, labels), oracle.url_judge(), {"pages": pages, "labels": labels})


def test_a_join_leaves_only_what_its_result_reads(spark):
    from corpusloom.llm import common

    rows = [(i, " ".join(f"w{(i // 40) * 1000 + k}" for k in range(60)) + f" end{i}", "en", "a", 1) for i in range(120)] + [(500 + i, f"alone{i} text{i} of{i} its{i} own{i}", "en", "a", 1) for i in range(10)]
    mark = common.scratch_mark()
    found = jaccard_join.classes(docs(spark, rows), n=3, percent=90)
    left = {path.rsplit("/", 1)[1] for _, path in common._scratch[mark:]}
    assert left == {"join-classed", "edges"} and len(common._scratch) - mark == 2
    got = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert all(got[i] == i // 40 * 40 for i in range(120)) and all(got[500 + i] == 500 + i for i in range(10))


def test_unrelated_long_texts_are_told_apart_before_they_move(spark, monkeypatch):
    """Long texts that share a passage are alike by size and profile; only the near copies among them link."""
    r, rows = random.Random(8), []
    for k in range(0, 12, 2):
        passage = [f"p{r.randrange(10**6)}" for _ in range(300)]
        rows += [(k + x, " ".join([*passage, *(f"w{r.randrange(10**6)}" for _ in range(5700))]), "en", "a", 1) for x in (0, 1)]
    rows.append((20, rows[0][1].rsplit(" ", 40)[0], "en", "a", 1))
    moved = []
    texts = jaccard_join._Join.texts

    def counted(self, ids):
        moved.extend(x["doc_id"] for x in ids.collect())
        return texts(self, ids)

    monkeypatch.setattr(jaccard_join._Join, "texts", counted)
    got = {x["doc_id"]: x["component_id"] for x in jaccard_join.classes(docs(spark, rows), 3, 90).collect()}
    assert got == {**{k: k for k in range(12)}, 20: 0}
    assert set(moved) == {0, 20}


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_parities_never_exceed_the_difference(spark, percent):
    r, rows = np.random.default_rng(1), []
    for n in (1, 2, 40, 700, 5000):
        for m in (n, n + 1, int(n / 0.9), 2 * n, 5 * n):
            for share in (0.0, 0.7, 0.95, 1.0):
                pool = r.integers(0, 2**64 - 1, n + m, np.uint64)
                a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[: int(share * n)], pool[n : n + m - int(share * n)]]))
                both = len(np.intersect1d(a, b))
                link = 100 * both >= percent * (len(a) + len(b) - both)
                rows.append((len(a), len(b), jaccard_join.parities(a, percent).tolist(), jaccard_join.parities(b, percent).tolist(), bool(link), share == 0 and m <= 2 * n and n >= 700))
    d = spark.createDataFrame(rows, "n_a long, n_b long, bits_a array<long>, bits_b array<long>, link boolean, apart boolean").withColumn("fits", jaccard_join._parities_fit("a", "b", percent))
    got = d.select("link", "apart", "fits").collect()
    assert all(x["fits"] for x in got if x["link"]) and not any(x["fits"] for x in got if x["apart"])


def test_members_without_one_of_their_size_leave_a_region(spark):
    rows = [(1, 10, 100), (1, 11, 95), (1, 12, 40), (2, 13, 50), (2, 14, 46), (2, 15, 44), (2, 16, 44), (3, 17, 9)]
    got = jaccard_join.sized(spark.createDataFrame(rows, "region long, doc_id long, n long").withColumn("held", F.hash("region")), 90).collect()
    assert sorted(x["doc_id"] for x in got) == [10, 11, 13, 14, 15, 16]


def test_counts_of_the_sketch_take_as_few_bytes_as_they_need():
    for top, size in ((0, 1), (255, 1), (256, 2), (70_000, 4), (1 << 40, 8)):
        counts = np.zeros(jaccard_join.SKETCH_ROW, np.int64)
        counts[7] = top
        row = jaccard_join._packed(counts)
        assert len(row) == size * jaccard_join.SKETCH_ROW and (jaccard_join._unpacked(row) == counts).all()
