"""Benchmark decontamination by winnowing.

Words are hashed, K consecutive ones make a gram, and of every SPAN - K + 1 consecutive grams the least hash is kept (of ties the
last): a shared run of SPAN words holds the same such window on both sides, so that it shares a kept gram. An item of m < SPAN
words is one window of its own and has one gram of all its m words; documents are looked through for grams of the lengths that occur.

1. Fingerprints of the items: a distinct table, and bits of their hashes (2 MB at most, whatever the input).
2. Documents, in one pass: kept grams whose bit is set, each with the words around it (SPAN - K on either side). All else stays where it is.
3. Both are joined on the hash. A candidate extends to the windows of SPAN words (or m) that contain it, and these are joined
   with the items' distinct windows, word for word: hashes decide nothing. A window finds one row at most, so that
   phrases that many items and many documents share are not multiplied.
4. Hit words of a document are those of the union of its windows. Windows of the same items are a class and documents of the
   same classes a profile, so that items are listed once for each profile and not for each document.

Keys of these joins may be hot (a passage in a third of all documents): they are plain equi-joins of two shuffled sides,
which adaptive execution splits, and every aggregate combines before it shuffles. Lists are held for one profile's items and
one document's windows only.

Defined results: null texts have no words; a document or item without words takes part in nothing; equal rows have equal
results, rows that share an id but not the text have each their own; a null doc_id stays null; items that share an id
are one item with the windows of all; those without an id are one item, written as an empty string; without items nothing is
contaminated; an empty table gives an empty result; texts may be of any length; further columns are ignored (clean() keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import ready_workers, stored
from corpusloom.llm.shingles import gram_hashes, word_hashes

SPAN, K = 10, 5
#: Bits of the fingerprints' filter; grams that are looked at side by side.
FILTER_BITS, BLOCK = 1 << 24, 1 << 20
#: A-Z become a-z; bytes that are in no word become spaces. All bytes beyond ASCII are in words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


def kept_grams(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of each window of consecutive grams, of ties the last."""
    found = []
    for begin in range(0, len(h) - window + 1, BLOCK):
        part = np.lib.stride_tricks.sliding_window_view(h[begin : begin + BLOCK + window - 1], window)
        found.append(np.unique(begin + np.arange(len(part)) + window - 1 - part[:, ::-1].argmin(axis=1)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def grams(h: np.ndarray, size: int, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are kept for windows of size words; h: hashes of words."""
    g = gram_hashes(h, min(k, span) if size == span else size)
    at = kept_grams(g, span - k + 1) if size == span else np.arange(len(g))
    return at, g[at]


def _fingerprint(ids: Column) -> list[Column]:
    """A set's size and 128 bits that combine before they are shuffled."""
    return [F.count("*").alias("c"), F.bit_xor(F.xxhash64(ids, F.lit(1))).alias("x"), F.bit_xor(F.xxhash64(ids, F.lit(2))).alias("y")]


def _set() -> Column:
    return F.concat_ws(":", "c", "x", "y")


def item_windows(items: DataFrame, span: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (text, class, size), and the items of each class. A class is a set of items."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                own = words(text)
                size = min(span, len(own))
                if not size:
                    continue
                for begin in range(0, len(own) - size + 1, BLOCK):
                    found = [b" ".join(own[i : i + size]) for i in range(begin, min(begin + BLOCK, len(own) - size + 1))]
                    yield pa.record_batch([pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary()).view(pa.string()), pa.array([size] * len(found), pa.int32())], ["item", "window", "size"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = stored(named.mapInArrow(of, "item string, window string, size int").distinct(), "item-windows")
    windows = pairs.groupBy("window", "size").agg(*_fingerprint(F.col("item"))).select("window", "size", _set().alias("class"))
    first = windows.groupBy("class").agg(F.min("window").alias("window"))
    return windows, first.join(pairs, "window").select("class", "item")


def fingerprints(items: DataFrame, span: int, k: int) -> DataFrame:
    """Distinct size and hash of the items' kept grams."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                own = words(text)
                if own:
                    size = min(span, len(own))
                    found = np.unique(grams(word_hashes(own), size, span, k)[1])
                    yield pa.record_batch([pa.array([size] * len(found), pa.int32()), pa.array(found.view(np.int64))], ["size", "hash"])

    return items.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(of, "size int, hash long").distinct()


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) & (FILTER_BITS - 1)


def filter_bits(prints: DataFrame) -> np.ndarray:
    """Bits of all fingerprints: FILTER_BITS / 8 bytes however many there are."""
    bit = F.shiftrightunsigned("hash", 40).bitwiseAND(F.lit(FILTER_BITS - 1)) + 1  # buckets of 32768 begin at 1
    found = prints.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for row in found.collect():
        out[row.number - 1] = np.frombuffer(bytes(row.bits), np.uint8)
    return out.ravel()


def candidates(docs: DataFrame, prints: DataFrame, span: int, k: int) -> DataFrame:
    """A row for each row of docs: key (of id and text), doc_id, n_words, and the kept grams whose bit is set with the words around."""
    spark = docs.sparkSession
    sizes = sorted(r.size for r in prints.select("size").distinct().collect())  # span at most
    bits = spark.sparkContext.broadcast(filter_bits(prints))  # of a fixed size
    gram = pa.struct([("size", pa.int32()), ("hash", pa.int64()), ("begin", pa.int64()), ("around", pa.string())])

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for batch in batches:
            keys, counts, rows = [], [], []
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                own, found = words(text), []
                h = word_hashes(own) if sizes else np.zeros(0, np.uint64)
                for size in sizes:
                    reach = span - k if size == span else 0
                    at, hashes = grams(h, size, span, k)
                    bit = _bit(hashes)
                    set_ = (held[bit >> 3] >> (bit & 7)) & 1 == 1
                    for p, value in zip(at[set_].tolist(), hashes[set_].view(np.int64).tolist()):
                        begin = max(0, p - reach)
                        found.append({"size": size, "hash": value, "begin": begin, "around": b" ".join(own[begin : p + size]).decode("utf-8", "replace")})
                keys.append(hashlib.blake2b(f"{name}|".encode() + text, digest_size=16).digest())
                counts.append(len(own))
                rows.append(found)
            yield pa.record_batch([pa.array(keys, pa.binary()), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(rows, pa.list_(gram))], ["key", "doc_id", "n_words", "found"])

    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(rows.mapInArrow(of, f"key binary, doc_id {kind}, n_words long, found array<struct<size:int,hash:long,begin:long,around:string>>"), "candidates")


def hits(marked: DataFrame, prints: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows of documents that are windows of items: key, begin, end (in words), class."""
    found = marked.select("key", F.explode("found").alias("g")).select("key", "g.*").join(prints, ["size", "hash"], "left_semi")
    around = F.split("around", " ")
    every = F.transform(F.sequence(F.lit(0), F.size(around) - F.col("size")), lambda i: F.struct((F.col("begin") + i).alias("begin"), F.array_join(F.slice(around, i + 1, F.col("size")), " ").alias("window")))
    extended = found.where(F.size(around) >= F.col("size")).select("key", "size", F.explode(every).alias("w")).select("key", "size", "w.*").distinct()
    return stored(extended.join(windows, ["window", "size"]).select("key", "begin", (F.col("begin") + F.col("size")).alias("end"), "class"), "hits")


def spans(found: DataFrame) -> DataFrame:
    """Hit runs of words of each document: key, begin, end, without overlaps."""
    order = W.partitionBy("key").orderBy("begin", "end")
    begins = F.coalesce(F.col("begin") > F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    runs = found.select("key", "begin", "end", begins.cast("int").alias("first")).withColumn("run", F.sum("first").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("key", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("run")


def item_lists(found: DataFrame, members: DataFrame) -> DataFrame:
    """key, n_items, items (sorted as strings, joined by commas)."""
    own = found.select("key", "class").distinct()
    profiles = own.groupBy("key").agg(*_fingerprint(F.col("class"))).select("key", _set().alias("profile"))
    first = profiles.groupBy("profile").agg(F.min("key").alias("key"))
    listed = first.join(own, "key").join(members, "class").select("profile", "item").distinct().groupBy("profile").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return profiles.join(listed.select("profile", F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items")), "profile").drop("profile")


def find(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What documents share with items: a row for each document (key, doc_id, n_words), its hits and the items of classes."""
    if not 0 < k <= span:
        raise ValueError("a gram has a word at least, and no more than a span")
    ready_workers(docs.sparkSession)
    windows, members = item_windows(items, span, k)
    prints = stored(fingerprints(items, span, k), "fingerprints")
    marked = candidates(docs, prints, span, k)
    return marked, hits(marked, prints, windows), members


def judge(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs."""
    marked, found, members = find(docs, items, span, k)
    hit = spans(found).groupBy("key").agg(F.sum(F.col("end") - F.col("begin")).alias("n_hit"))
    rows = marked.select("key", "doc_id", "n_words").join(hit.join(item_lists(found, members), "key"), "key", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("doc_id", "n_words", count("n_hit"), count("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """The rows of docs that share nothing with an item."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    bad = _contaminated(rows, items, span, k)
    return rows.join(bad, F.md5(F.to_json(F.struct("doc_id", "text"))) == F.col("bad"), "left_anti").select("row.*")


def _contaminated(rows: DataFrame, items: DataFrame, span: int, k: int) -> DataFrame:
    named = rows.select(F.md5(F.to_json(F.struct("doc_id", "text"))).alias("doc_id"), "text")
    marked, found, _ = find(named, items, span, k)
    return marked.join(found.select("key").distinct(), "key", "left_semi").select(F.col("doc_id").alias("bad")).distinct()
