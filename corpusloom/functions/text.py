"""Text scalars as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters and what they fold to, one for one, so that offsets stay valid.
FOLD_FROM = "ıİşŞğĞüÜöÖçÇâÂîÎ"
FOLD_TO = "iissgguuooccaaii"
TURKISH_LETTERS = "çğıöşüÇĞİÖŞÜ"

# Function words that signal Turkish, and words that are no keywords.
TURKISH_WORDS = (" ve ", " için ", " ile ", " olarak ", " veya ", " değil ", " bu ", " şu ", " bir ")
KEYWORD_STOP = tuple(
    """what when where which who how why the and for with about from that this have does did you your
    are was were please dont not tell can could would should university universite universitesi
    know lie more some any very just like into than then them they their there here hakkında nedir
    nelerdir nasıl hangi şey""".split()
)

#: Characters of a message that reach a language model, and of one that carries its context on top.
MESSAGE_CHARS, CONTEXT_SLACK = 900, 500
TITLES = r"^(?:(?:dr|doç|doc|prof|yrd|asst|assoc|öğr|assistant|associate)\.?\s*){1,6}"


def once(value: Column, f) -> Column:
    """f(value), with the value worked out once however often f names it, also for each element of an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def fold(c: Column) -> Column:
    """Lower case without Turkish letters; translated first, since lower() may lengthen them."""
    return F.lower(F.translate(c, FOLD_FROM, FOLD_TO))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """No built-in normalises Unicode; Arrow batches, one library call each."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def contains_folded(text: Column, term: str | Column) -> Column:
    return F.contains(fold(text), fold(F.lit(term) if isinstance(term, str) else term))


def snippet(text: Column, phrase: Column, n: int) -> Column:
    """A window of n characters around the first folded hit of a phrase, else around its longest word of three
    letters or more that occurs, else the first n characters."""
    text, phrase = F.coalesce(text, F.lit("")), F.trim(F.coalesce(phrase, F.lit("")))
    low = fold(text)
    size = F.least(F.lit(n), F.length(text))
    words = F.filter(F.split(phrase, r"\s+"), lambda w: F.length(w) >= 3)
    by_length = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    hits = F.filter(F.concat(F.array(phrase), F.transform(by_length, lambda x: x["w"])), lambda w: F.contains(low, fold(w)))
    hit = F.get(hits, F.lit(0))
    at = F.instr(low, fold(hit)) - 1
    centre = at + F.floor(F.greatest(F.length(hit), F.lit(1)) / 2)
    start = F.greatest(F.lit(0), F.least(centre - F.floor(size / 2), F.length(text) - size))
    usable = (F.length(phrase) >= 2) & hit.isNotNull()
    return F.substring(text, F.when(usable, start.cast("int")).otherwise(0) + 1, size)


def trimmed(text: Column, n: int = MESSAGE_CHARS) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n - 1), F.lit("…")))


def trimmed_last_turn(text: Column, bubble: int = 14_000) -> Column:
    """A turn with context keeps bubble + 500 characters, any other is trimmed as a message."""
    long = F.length(text) > bubble + CONTEXT_SLACK
    kept = F.when(long, F.concat(F.substring(text, 1, bubble + CONTEXT_SLACK - 1), F.lit("…"))).otherwise(text)
    return F.when(F.contains(text, F.lit("===CONTEXT===")), kept).otherwise(trimmed(text))


def sanitized_reply(text: Column, source: str = "Based on the website, ") -> Column:
    """A model's reply without prompt markers and runs of blanks."""
    ends = r"^\s+|\s+$"
    t = F.regexp_replace(F.coalesce(text, F.lit("")), ends, "")
    for lead in ("according\\s+to", "based\\s+on"):
        t = F.regexp_replace(t, rf"(?i){lead}\s*,?\s*={{3}}\s*CONTEXT\s*={{3}}\s*[, ]*", source)
    for marker in ("===CONTEXT===", "===QUESTION===", "===END_QUESTION==="):
        t = F.replace(t, F.lit(marker), F.lit(""))
    t = F.regexp_replace(t, r"(?i)^according\s+to\s*,\s*", source)
    t = F.regexp_replace(t, "[ \t]{2,}", " ")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), ends, "")


def session_title(message: Column) -> Column:
    """The first 197 characters; an ellipsis only for messages of more than 200."""
    t = F.trim(message)
    return F.concat(F.substring(t, 1, 197), F.when(F.length(t) > 200, F.lit("…")).otherwise(F.lit("")))


def slug_label(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def without_titles(name: Column) -> Column:
    return F.trim(F.regexp_replace(collapse(name), "(?i)" + TITLES, ""))


def words(text: Column, least: int = 4) -> Column:
    return F.regexp_extract_all(F.lower(F.translate(text, "İ", "i")), F.lit(f"[a-zğüşıöç]{{{least},}}"), F.lit(0))


def keywords(text: Column, most: int = 5) -> Column:
    """The first words of four letters or more that are no stop words, in order, each once."""
    found = F.filter(words(text), lambda w: ~w.isin(*KEYWORD_STOP))
    first = F.filter(F.transform(found, lambda w, i: F.when(F.array_position(found, w) == i + 1, w)), lambda w: w.isNotNull())
    return F.slice(first, 1, most)


def overlap(text: Column, terms: Column) -> Column:
    """How many terms occur in a text (as substrings)."""
    return once(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.size(F.filter(terms, lambda t: F.contains(low, t)))).cast("long")


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of each word, with two blanks before and one after it."""
    ws = F.array_distinct(F.filter(F.split(F.regexp_replace(fold(text), "[^a-z0-9]+", " "), " "), lambda w: w != ""))
    return F.array_distinct(
        F.flatten(F.transform(ws, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))
    )


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared share of two trigram sets; 0 for two empty ones."""
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(0.0))


def times(text: Column, term: Column) -> Column:
    """Occurrences of a term, not overlapping."""
    return (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)


def rank_any(content: Column, title: Column, terms: Column) -> Column:
    """Full-text rank of a disjunction of terms: up to four hits in the content count, a hit in the title 0.4."""
    points = lambda low, w: F.least(times(low["c"], w), F.lit(4.0)) / 4 + F.when(F.contains(low["t"], w), F.lit(0.4)).otherwise(F.lit(0.0))
    total = once(F.struct(F.lower(content).alias("c"), F.lower(title).alias("t")), lambda low: F.aggregate(terms, F.lit(0.0), lambda s, w: s + points(low, w)))
    return F.when(F.size(terms) > 0, total / F.size(terms)).otherwise(F.lit(0.0))


def uuid_or_null(c: Column) -> Column:
    return F.when(c.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"), F.lower(c))


def short_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def english_only(c: Column) -> Column:
    t = F.coalesce(c, F.lit(""))
    return ~t.rlike(f"[{TURKISH_LETTERS}]") & t.rlike("[A-Za-z]")


def probably_turkish(c: Column, chars: int = 80, hits: int = 2, strong: bool = True) -> Column:
    """At least two different function words in a text of 80 characters; else, in the strong mode, 30 words with
    four function words and a share of 0.035 of Turkish letters; in the weak one a share of 0.02."""
    t = F.trim(F.coalesce(c, F.lit("")))
    low = F.concat(F.lit(" "), F.lower(t), F.lit(" "))
    found = sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in TURKISH_WORDS), F.lit(0))
    letters = F.regexp_count(t, F.lit(f"[A-Za-z{TURKISH_LETTERS}]"))
    share = F.when(letters > 0, F.regexp_count(t, F.lit(f"[{TURKISH_LETTERS}]")) / letters).otherwise(F.lit(0.0))
    enough = (F.regexp_count(t, F.lit(r"(?U)\w+")) >= 30) & (found >= 4) & (share >= 0.035)
    return (F.length(t) >= chars) & ((found >= hits) | (enough if strong else share >= 0.02))


def semester(text: Column) -> Column:
    """A semester of 1 to 8 that a text names, in words, as an ordinal or as a number before or after."""
    low = collapse(F.regexp_replace(fold(text), r"[._:/\\-]+", " "))
    # Ordinals of semesters.
    ordinals = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth")
    turkish = ("birinci", "ikinci", "ucuncu", "dorduncu", "besinci", "altinci", "yedinci", "sekizinci")
    named = [F.when(low.rlike(rf"{t}\s+donem"), i) for i, t in enumerate(turkish, 1)] + [F.when(low.rlike(rf"\b{e}\s+semester\b"), i) for i, e in enumerate(ordinals, 1)]
    before = F.regexp_extract(low, r"\b(\d{1,2})\s*(?:st|nd|rd|th)?\s*semester\b", 1)
    after = F.regexp_extract(low, r"\bsemester\s*(\d{1,2})\b", 1)
    value = F.when(before != "", before).when(after != "", after).cast("int")
    return F.coalesce(*named, F.when(value.between(1, 8), value)).cast("int")


def ects_of_row(row: Column) -> Column:
    """Credits in a flattened row of a course table: the number after the status, else the last short number;
    workload triples such as 3+0+0 do not count."""
    r = collapse(F.regexp_replace(row, r"\b\d+\s*\+\s*\d+\s*\+\s*\d+\b", " "))
    after = F.regexp_extract(r, r"(?i)\b(?:compulsory|elective)\b\s+(\d{1,2})\b", 1)
    short = F.regexp_extract_all(r, F.lit(r"\b(\d{1,2})\b"), F.lit(1))
    return F.when(after != "", after).when(F.size(short) > 0, F.element_at(short, -1)).cast("int")
