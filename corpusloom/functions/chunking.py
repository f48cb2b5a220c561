"""Chunks of a page for embedding."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corpusloom.functions.text import collapse, once

SIZE, OVERLAP = 700, 120


def _checked(size: int, overlap: int) -> None:
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the chunk")


def fixed_windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows over the text with collapsed white space; the last one reaches its end."""
    _checked(size, overlap)
    step = size - overlap
    last = lambda clean: F.greatest(F.lit(0), F.ceil((F.length(clean) - size) / step)).cast("int")
    pieces = lambda clean: F.transform(F.sequence(F.lit(0), last(clean)), lambda i: F.trim(F.substr(clean, i * step + 1, F.lit(size))))
    return once(collapse(text), lambda clean: F.when(clean == "", F.array().cast("array<string>")).otherwise(F.filter(pieces(clean), lambda p: p != "")))


def structural(content: Column, units: Column) -> Column:
    """Whether a page's records cover it well enough to be its chunks."""
    page = F.greatest(F.length(F.trim(content)), F.lit(1))
    covered, n = F.length(F.array_join(units, "\n\n")), F.size(units)
    return (n >= 4) | (covered >= 0.32 * page) | ((n >= 2) & (covered >= 0.18 * page)) | ((n == 1) & (covered >= 0.55 * page))


def split_long(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Windows of at most size characters, each beginning overlap characters before the end of the one before. A window that is
    not the last ends behind its last line break, or before its last blank, where that leaves a third of it."""
    _checked(size, overlap)
    text = text.strip()
    windows, begin = [], 0
    while len(text) - begin > size:
        breaks = (text.rfind("\n", begin, begin + size) + 1, text.rfind(" ", begin, begin + size))
        least = (begin + size // 3 + 1, begin + size // 3)
        end = next((at for at, low in zip(breaks, least) if at >= low), begin + size)
        windows.append((begin, end))
        begin = max(begin + 1, end - overlap)
    if begin < len(text):
        windows.append((begin, len(text)))
    return [piece for a, b in windows if (piece := text[a:b].strip())]


def pack_paragraphs(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Paragraphs put together up to the size; longer ones are split."""
    _checked(size, overlap)
    packs: list[list[str]] = []
    room = -1  # of the last pack; none may be added to a long paragraph
    for paragraph in map(str.strip, re.split(r"\n\s*\n+", text.strip())):
        need = len(paragraph) + 2
        if not paragraph:
            continue
        if need <= room:
            packs[-1].append(paragraph)
            room -= need
        else:
            packs.append([paragraph])
            room = size - len(paragraph)
    whole = ["\n\n".join(pack) for pack in packs]
    return [piece for pack in whole for piece in (split_long(pack, size, overlap) if len(pack) > size else [pack])]


@F.pandas_udf(ArrayType(StringType()))
def _packed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: pack_paragraphs(t or ""))


@F.pandas_udf(ArrayType(StringType()))
def _split_units(units: pd.Series) -> pd.Series:
    return units.map(lambda us: [p for u in (us if us is not None else []) for p in split_long(str(u))])


def page_chunks(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, title, content, embedding_units. page_id, chunk_index, content, source_url, page_title.

    Records are the chunks of a page that they cover, paragraphs those of any other; an index counts on where a
    chunk's vector fails later. Greedy packing has no expression, so that it runs on Arrow batches."""
    units = F.filter(F.transform(F.coalesce("embedding_units", F.array().cast("array<string>")), lambda u: F.trim(u)), lambda u: u != "")
    rows = pages.withColumn("_units", units).where(F.trim(F.coalesce("content", F.lit(""))) != "")
    by_record = (F.size("_units") > 0) & structural(F.col("content"), F.col("_units"))
    chunks = F.when(by_record, _split_units("_units")).otherwise(_packed("content"))
    return rows.select("page_id", F.posexplode(chunks).alias("chunk_index", "content"), F.col("url").alias("source_url"), F.col("title").alias("page_title"))
