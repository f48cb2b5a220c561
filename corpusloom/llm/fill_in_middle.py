"""Fill-in-the-middle by bit-parallel cuts on big integers.

A text's UTF-8 bytes are mapped to a class mask by bytes.translate: bit i of a big integer tells whether byte i is of the class
(bytes that continue a code point, or bytes of words). A shift and a few boolean operations give the bits where a unit ends,
bit_count counts the units, and the k-th unit's end is selected by halving: the count of the lower half tells which half holds it.
All of it is linear in the text, in C, without decoding it.

Units are code points, or words (a word with the white space after it; leading white space belongs to the first). Each
document's two cuts, its form and order come from a hash of its id, so that any run or retry gives the same output:
digits 1-8 and 9-16 of the sha256 of `seed:id` choose two of the n + 1 borders between units, the next eight whether the text stays plain, the
eight after these which order it gets (psm: prefix, suffix, middle; spm: suffix, prefix, middle).

Each row is worked out alone; nothing is shuffled, and a batch holds whole texts.

Defined results: a null text is an empty one; an empty text and one that holds a sentinel stay plain; a null id hashes as
an empty one; rows that repeat an id are cut by the same hash, each by its own length; bytes that are no UTF-8 are units as they come and are kept;
texts may be of any length; an empty table gives an empty result; further columns are carried along in `row`.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ready_workers

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of documents that are cut, and of these in the order suffix, prefix, middle.
CUT_PERCENT, SPM_PERCENT = 90, 20
UNITS = ("code point", "word")

_CONTINUES = bytes(b"01"[0x80 <= b < 0xC0] for b in range(256))
_IN_WORD = bytes(b"10"[b in b" \t\n\v\f\r"] for b in range(256))


def mask(text: bytes, of_class: bytes) -> int:
    """Bit i is set if byte i is of the class."""
    return int(text[::-1].translate(of_class), 2) if text else 0


def unit_ends(text: bytes, unit: str = "code point") -> int:
    """Bit i is set if a unit ends with byte i."""
    if not text:
        return 0
    every = (1 << len(text)) - 1
    if unit == "code point":
        return every & ~(mask(text, _CONTINUES) >> 1)  # no byte continues it
    word = mask(text, _IN_WORD)
    starts = word & ~(word << 1)
    return (starts & (starts - 1)) >> 1 | 1 << (len(text) - 1)  # before each word but the first, and at the end


def select(bits: int, k: int) -> int:
    """Place of the k-th set bit, counted from 1 and from the lowest."""
    at, size = 0, bits.bit_length()
    while size > 1:
        half = size >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if k <= below:
            bits, size = low, half
        else:
            bits, at, size, k = bits >> half, at + half, size - half, k - below
    return at


def cut(text: bytes, key: str, unit: str = "code point") -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, units of prefix and middle (None if plain), output."""
    ends = unit_ends(text, unit)
    n = ends.bit_count()
    digest = hashlib.sha256(key.encode()).hexdigest()
    a, b, plain, order = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not n or plain % 100 >= CUT_PERCENT or any(m in text for m in marks):
        return n, "plain", None, None, text
    first, second = sorted((a % (n + 1), b % (n + 1)))
    i, j = (select(ends, k) + 1 if k else 0 for k in (first, second))
    prefix, middle, suffix = marks[0] + text[:i], marks[2] + text[i:j], marks[1] + text[j:]
    if order % 100 < SPM_PERCENT:
        return n, "spm", first, second - first, suffix + prefix + middle
    return n, "psm", first, second - first, prefix + suffix + middle


def transform(docs: DataFrame, text: str = "text", id_column: str = "doc_id", seed: int = 1, unit: str = "code point") -> DataFrame:
    """row (all columns of docs), n, form, prefix_units, middle_units, output."""
    if unit not in UNITS:
        raise ValueError(f"a unit is one of {UNITS}")
    ready_workers(docs.sparkSession)
    kinds = [("n", pa.int64()), ("form", pa.string()), ("prefix_units", pa.int64()), ("middle_units", pa.int64())]

    @F.arrow_udf("n long, form string, prefix_units long, middle_units long, output string")
    def of(texts: pa.Array, ids: pa.Array) -> pa.Array:
        found = [cut(t or b"", f"{seed}:{'' if i is None else i}", unit) for t, i in zip(texts.cast(pa.binary()).to_pylist(), ids.to_pylist())]
        columns = [pa.array([f[k] for f in found], kind) for k, (_, kind) in enumerate(kinds)]
        columns.append(pa.array([f[4] for f in found], pa.binary()).view(pa.string()))
        return pa.StructArray.from_arrays(columns, [name for name, _ in kinds] + ["output"])

    done = docs.select(F.struct(*docs.columns).alias("row"), of(F.col(text), F.col(id_column)).alias("fim"))
    return done.select("row", "fim.*")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. A cut text holds no sentinel, and none can arise where two parts meet, since no
    sentinel begins as another one ends."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in (PREFIX, SUFFIX, MIDDLE)), -1)
    part = lambda i: F.get(parts, F.lit(i))
    cut_text = F.when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))
    return F.when(form == "plain", output).otherwise(cut_text)


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and digests of the output and of the text restored from it."""
    made = transform(docs.select("doc_id", "text"))
    return made.select(
        "row.doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
