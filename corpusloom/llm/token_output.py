"""Token-id output: documents are encoded, range-partitioned by id, and written as pages of
Simple-8b words.

A page is one self-contained binary record of about PAGE_IDS ids: header, ids and lengths of its
documents, offsets of its blocks, words. Pages are rows of a Parquet table, so any store that Spark
writes to will do, task retries and lost executors included. A shard is what one task wrote, in
ascending document order; a page knows how many ids its shard holds before it, so that only one number
for each shard is added up to give every document's place in the whole sequence.

The ids are those of the tokenizers library at its defaults. Words between single spaces and line feeds are
encoded by it once for each worker and kept in bounded tables. A text with other white space, or with one of the
tokenizer's added tokens, is encoded as a whole.

Defined results: a null or empty text gives just the end id; a null id comes first; repeated rows are
all written; rows of one id stand in an order of their texts' hashes; an empty table gives no pages; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import BATCH_BYTES, ready_workers, scratch_path
from corpusloom.llm.simple8b import BLOCK, pack, unpack

END_ID = 0
PAGE_IDS = 1 << 20
KEPT_WORDS = 800_000
_HEAD = struct.Struct("<4sHHIIQ")  # magic, version, block size, documents, blocks, ids
MAGIC, VERSION = b"TID8", 1

_encoders: dict[str, "WordEncoder"] = {}


#: All that some definition of white space holds, but for space and line feed; those of ASCII first.
OTHER_SPACE = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"


class WordEncoder:
    """Ids of texts, by way of a table of words.

    Texts are cut before single spaces and on both sides of single line feeds, where a byte-level tokenizer cuts whatever stands
    there: into words that follow a space, and words that a line feed begins (so does, for the time being, each text). All
    texts of a batch are cut by Arrow's functions and each distinct word is looked up once. The library encodes all words of a batch that
    are new as one text, whose ids fall apart into those of its words: a word's first id, and no other, begins with the
    space; a line feed has an id of its own."""

    def __init__(self, path: str):
        import json
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            stages = json.load(f)
        pre = stages["pre_tokenizer"] or {}
        byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]
        self.by_words = byte_level and not any(stages[x] for x in ("normalizer", "truncation", "padding"))
        kept = ["  ", "\n\n", " \n", "\n ", *OTHER_SPACE, *(t["content"] for t in stages["added_tokens"])]
        self.kept_whole = "|".join(re.escape(x) for x in kept)
        if self.by_words:
            space, self.feed = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ")[0][0], self.numbers("\n")[0]
            vocabulary = self.tokenizer.get_vocab()
            self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
            self.begins[[i for token, i in vocabulary.items() if token[:1] == space]] = True
            self.forget()

    def numbers(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")  # ids only, no offsets

    def forget(self) -> None:
        """Begin with the words at which a text may end."""
        self.places = {"": 0, "\n": 1}
        ends = [self.numbers(" "), self.numbers("\n")]
        self.held, self.sizes = np.concatenate(ends), np.array([len(e) for e in ends])

    def learn(self, words: list[str]) -> None:
        spaced, lines = [w for w in words if w[0] != "\n"], [w for w in words if w[0] == "\n"]
        held, sizes = [self.held], [self.sizes]
        for own, text in ((spaced, " " + " ".join(spaced)), (lines, "".join(lines))):
            if own:
                ids = self.numbers(text)
                at = np.flatnonzero(self.begins[ids] if own is spaced else ids == self.feed)
                self.places.update(zip(own, range(len(self.places), len(self.places) + len(own))))
                held.append(ids)
                sizes.append(np.diff(np.append(at, len(ids))))
        self.held, self.sizes = np.concatenate(held), np.concatenate(sizes)
        if len(self.sizes) != len(self.places):
            raise ValueError("words and ids do not match")

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        whole = pc.match_substring_regex(texts, self.kept_whole) if self.by_words else pa.repeat(pa.scalar(True), len(texts))
        plain = np.flatnonzero(~whole.to_numpy(zero_copy_only=False))
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        for k in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            out[k] = self.numbers(texts[k].as_py())
        if not len(plain):
            return out
        spaced = pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n")
        parts = pc.split_pattern(pc.binary_join_element_wise("\n", spaced, ""), " ")
        words = parts.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False)
        if len(self.places) > KEPT_WORDS:
            self.forget()
        place = np.array([self.places.get(w, -1) for w in distinct.tolist()])
        new = np.flatnonzero(place < 0)
        if len(new):
            unknown = distinct[new].tolist()
            self.learn(unknown)
            place[new] = [self.places[w] for w in unknown]
        begins, size = (np.cumsum(self.sizes) - self.sizes)[place], self.sizes[place]
        at = words.indices.to_numpy()
        count = size[at]
        ends = np.cumsum(count)
        ids = self.held[np.repeat(begins[at] - (ends - count), count) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends])[parts.offsets.to_numpy()]
        for k, a, b in zip(plain.tolist(), bounds.tolist(), bounds[1:].tolist()):
            out[k] = ids[a + 1 : b]  # without the line feed in front
        return out


def encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_page(doc_ids: list[int | None], parts: list[np.ndarray]) -> bytes:
    ids = np.concatenate(parts).astype(np.uint64)
    words, offsets = pack(ids)
    own = np.array([-1 if i is None else i for i in doc_ids], "<i8")
    known = np.array([i is not None for i in doc_ids], np.uint8)
    lengths = np.array([len(p) for p in parts], "<u4")
    head = _HEAD.pack(MAGIC, VERSION, BLOCK, len(parts), len(offsets) - 1, len(ids))
    return b"".join([head, own.tobytes(), lengths.tobytes(), known.tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def read_page(page: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their lengths and all ids of a page."""
    magic, version, block, n_docs, n_blocks, n = _HEAD.unpack_from(page)
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError("not a page of token ids")
    at = _HEAD.size
    own = np.frombuffer(page, "<i8", n_docs, at)
    lengths = np.frombuffer(page, "<u4", n_docs, at := at + 8 * n_docs)
    known = np.frombuffer(page, np.uint8, n_docs, at := at + 4 * n_docs)
    offsets = np.frombuffer(page, "<u4", n_blocks + 1, at := at + n_docs)
    words = np.frombuffer(page, "<u8", -1, at + 4 * (n_blocks + 1))
    return [i if k else None for i, k in zip(own.tolist(), known.tolist())], lengths, unpack(words, offsets, n, block)


PAGES = "shard int, page int, before long, n_ids long, n_docs long, data binary"
_PAGES = pa.schema([("shard", pa.int32()), ("page", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("data", pa.binary())])


def encode_pages(docs: DataFrame, tokenizer: str, end_id: int = END_ID, page_ids: int = PAGE_IDS) -> DataFrame:
    """Pages of all documents in ascending order of doc_id."""
    ready_workers(docs.sparkSession, 2 * BATCH_BYTES)  # more words of a batch are the same
    end = np.array([end_id], "<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, page, before = TaskContext.get().partitionId(), 0, 0
        owners: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def close():
            nonlocal page, before, owners, parts, held
            row = [[shard], [page], [before], [held], [len(parts)], [write_page(owners, parts)]]
            page, before, owners, parts, held = page + 1, before + held, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _PAGES)], schema=_PAGES)

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(tokenizer).encode(batch.column("text"))):
                owners.append(doc_id)
                parts.append(np.append(ids, end))
                held += len(ids) + 1
                if held >= page_ids:
                    yield close()
        if parts:
            yield close()

    text = F.coalesce("text", F.lit(""))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    # with the hash, rows that share an id (or have none) are no single range
    return ordered.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").mapInArrow(write, PAGES)


def write_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    encode_pages(docs, tokenizer, end_id).write.option("compression", "zstd").parquet(path)


_ROWS = "doc_id long, shard int, place long, n_tokens long, ids_crc32 long"
_OUT = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    pages = spark.read.schema(PAGES).parquet(path)
    ready_workers(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before, page in zip(*(batch.column(c) for c in ("shard", "before", "data"))):
                owners, lengths, ids = read_page(page.as_py())
                data = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owners, pa.int64()), pa.array(np.full(len(owners), shard.as_py(), np.int32)), pa.array(starts + before.as_py()), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())],
                    schema=_OUT,
                )

    # one row for each writing task: far below any limit of a broadcast or a single task
    order = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = pages.groupBy("shard").agg(F.sum("n_ids").alias("_ids")).select(F.col("shard").alias("_shard"), F.coalesce(F.sum("_ids").over(order), F.lit(0)).alias("_before"))
    docs = pages.select("shard", "before", "data").mapInArrow(read, _ROWS)
    return docs.join(shards, docs["shard"] == shards["_shard"]).select("doc_id", (F.col("place") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write docs to files in the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "token-ids")
    write_files(docs, tokenizer, path, end_id)
    return read_files(docs.sparkSession, path)
