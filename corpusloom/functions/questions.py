"""What a question asks for: names of persons and courses, credits in tables, composed queries."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from corpusloom.functions import rules

_TITLE = re.compile(r"^(?:(?:dr|doç|doc|prof|yrd|asst|assoc|öğr|assistant|associate)\.?\s+)+", re.I)
_ROLE = re.compile(r"\b(head|chair|dean|director|bolum|bölüm|baskan|başkan|müdür|mudur|dekan)\b", re.I)
_ASKS = (
    re.compile(r"^\s*([\w\s.'’-]+?)\s+kimdir\b", re.I),
    re.compile(r"^\s*kimdir\s+([\w\s.'’-]+?)\s*[?.!]?\s*$", re.I),
    re.compile(r"^\s*([\w\s.'’-]+?)\s+kim\s*[?.!]?\s*$", re.I),
    re.compile(r"\bwho(?:'s|\s+is)\s+(.+?)(?:\s*[?.!]|$)", re.I),
)
_NO_NAME = {"the", "a", "an", "our", "this", "that", "what", "which"}
_WORKLOAD, _STATUS = re.compile(r"\b\d+\s*\+\s*\d+\s*\+\s*\d+\b"), re.compile(r"\b(?:compulsory|elective)\b[\s:|]*(\d{1,2})\b", re.I)
_OF_COURSE = re.compile(r"\b(?:ects|akts|credits?)\b(?:\s+(?:value|credits?|number))?\s+(?:of|for)\s+(?:the\s+)?(.+?)(?:\s+(?:course|lesson|class))?\s*[?.!]*$", re.I)


def person_of(question: str | None) -> str | None:
    """The person a question asks about, without titles, at most four words; null for roles and other questions."""
    text = unicodedata.normalize("NFKC", " ".join((question or "").split()))
    for ask in _ASKS:
        if m := ask.search(text):
            words = _TITLE.sub("", m.group(1).strip(" ?.!")).split()[:4]
            name = " ".join(words)
            plain = not words or words[0].lower() in _NO_NAME or len(name) < 5 or len(name) > 120 or (len(words) == 1 and len(name) < 8)
            return None if plain or (_ROLE.search(name) and len(words) < 2) else name
    return None


def course_of(question: str | None) -> str | None:
    """The course whose credits a question asks for."""
    m = _OF_COURSE.search(" ".join((question or "").split()))
    return m.group(1).strip().lower() if m else None


# A number next to the label, that is no workload (3+0+0) and no total: behind it, before it.
_BEHIND = r"(?<!total )\b(?:ects|akts)\b[^0-9]{0,%d}(\d{1,2})(?!\s*\+)\b"
_AHEAD = r"(?<![\d+])\b(\d{1,2})(?!\s*\+)\b[^a-z0-9]{0,%d}\b(?:ects|akts)\b"


def _labelled(text: str, gap: int) -> int | None:
    for form in (_BEHIND, _AHEAD):
        if m := re.search(form % gap, text, re.I):
            return int(m.group(1))
    return None


def credits_near(text: str | None, course: str | None, before: int = 900, after: int = 1800) -> int | None:
    """Credits next to a course's name (or the longest of its words that is there), within a window around it: in its row (three
    lines) the number after the status, else one behind or before the label ECTS; else the first label within 260 characters of
    the name; else any in the window."""
    name = (course or "").strip().lower()
    if not text or len(name) < 3:
        return None
    low = text.lower()
    words = sorted((w for w in name.split() if len(w) >= 4), key=len, reverse=True)[:2]
    at = next((i for i in map(low.find, (name, *words)) if i >= 0), -1)
    if at < 0:
        return None
    window = text[max(0, at - before) : at + after]
    lines = [line for line in map(str.strip, window.splitlines()) if line]
    first = next((i for i, line in enumerate(lines) if name in line.lower()), None)
    row = " ".join(lines if first is None else lines[first : first + 3])
    if first is not None and (m := re.search(r"\b(?:compulsory|elective)\b\s+(\d{1,2})\b", _WORKLOAD.sub(" ", row), re.I)):
        return int(m.group(1))
    found = _labelled(row, 12)
    if found is None and (m := re.search(re.escape(name) + r"[\s\S]{0,260}?" + _BEHIND % 20, window, re.I)):
        found = int(m.group(1))
    return _labelled(window, 20) if found is None else found


def course_row(text: str | None, course: str | None) -> tuple[str, int] | None:
    """The row of a course in a course table, and its credits: the line that names the course (or two of its words), wrapped once at
    most, with workload and status; never a total. In a table without lines the row is looked for behind the course's name."""
    name = " ".join((course or "").lower().split())
    if not text or len(name) < 3:
        return None
    wanted = {w for w in re.findall(r"[a-z]{3,}", name)} - {"for", "of", "and"}
    lines = [line.strip() for line in text.splitlines() if line.strip()]
    for line, following in zip(lines, [*lines[1:], ""]):
        low = line.lower()
        if name not in low and sum(w in low for w in wanted) < min(2, max(1, len(wanted))):
            continue
        for row in (line, f"{line} {following}".strip()):
            m = _STATUS.search(row)
            if m and _WORKLOAD.search(row) and "total ects" not in row.lower():
                return row, int(m.group(1))
    flat = r"\s+".join(map(re.escape, name.split())) + r"[\s\S]{0,140}?\b\d+\+\d+\+\d+\b[\s\S]{0,60}?\b(?:compulsory|elective)\b[\s:|]{0,8}(\d{1,2})"
    if (m := re.search(flat, text, re.I)) and "total ects" not in m.group(0).lower():
        return m.group(0)[:500], int(m.group(1))
    return None


@F.pandas_udf(StructType([StructField("row", StringType()), StructField("credits", IntegerType())]))
def course_rows(texts: pd.Series, courses: pd.Series) -> pd.DataFrame:
    found = [course_row(t, c) or (None, None) for t, c in zip(texts, courses)]
    return pd.DataFrame({"row": [r for r, _ in found], "credits": pd.array([n for _, n in found], dtype="Int32")})


def direct_answer(question: Column, context: Column) -> Column:
    """What a context's block about a course's credits says, where the question asks for them: course, value, status, row; else null."""
    part = lambda name, rest: F.trim(F.regexp_extract(F.coalesce(context, F.lit("")), rf"(?i){name}:\s*({rest})", 1))
    course, value = F.regexp_replace(part("Course anchor", r"[^\n]+"), r"^[ .]+|[ .]+$", ""), part("ECTS value", r"[0-9]{1,2}|NOT FOUND IN EXCERPT")
    status = F.when(F.upper(value) == "NOT FOUND IN EXCERPT", "not_found").otherwise("ok")
    row = F.substring(part(r"Unit row \(if available\)", r"[^\n]+"), 1, 500)
    asks = F.contains(F.lower(F.coalesce(question, F.lit(""))), F.lit("ects"))
    return F.when(asks & (course != "") & (value != ""), F.struct(course.alias("course"), value.alias("value"), status.alias("status"), row.alias("row")))


def department_anchors(question: Column, most: int = 10) -> Column:
    """Names around which a snippet about a department is cut: those of its path, and the label of the path, longest first."""
    segment = rules.path_segment(question)
    out = F.array().cast("array<string>")
    for path, names in rules.PATHS:
        known = {n for n in names if len(n) >= 4} | {" ".join(w.capitalize() for w in path.split("-"))}
        once = {n.lower(): n for n in sorted(known)}
        out = F.when(segment == path, F.array(*map(F.lit, sorted(once.values(), key=lambda n: (-len(n), n))[:most]))).otherwise(out)
    return out


# Headings of pages about fees.
SCHOLARSHIP_ANCHORS = ("Scholarship", "Scholarships", "Tuition Fees and Scholarships", "Burs", "Burslar", "Ücret ve Burs", "Öğrenim Ücretleri ve Burslar")
PAYMENT_ANCHORS = ("Payment", "Ödeme", "Taksit", "Payment Plan")


def fee_anchors(question: Column) -> Column:
    """Headings around which a snippet about fees is cut."""
    some = lambda cond, terms: F.when(cond, F.array(*map(F.lit, terms))).otherwise(F.array().cast("array<string>"))
    fee = rules.intent(question, "fee")
    return F.concat(some(fee & rules.intent(question, "scholarship"), SCHOLARSHIP_ANCHORS), some(fee & rules.has(question, r"\bpayment|odeme|installment|taksit\b"), PAYMENT_ANCHORS))


#: More ways to search for what a question asks for, by intent; the text is a parameter of the site.
VARIANTS = {
    "roster": "academic staff list of the department, faculty members, professors",
    "leadership": "deans and rector of the university, faculty management",
    "international": "international student admission, application, required documents",
    "wide_fee": "tuition fees of all programs, fee schedule, price list",
}


def query_variants(composed_: Column, name: Column, variants: dict[str, str] | None = None) -> Column:
    """The composed question first, then ways to search for a person it names, then a line for each intent that holds; each once,
    whatever the case of its letters."""
    lines = [F.when(rules.intent(composed_, n), F.lit(line)) for n, line in (VARIANTS if variants is None else variants).items()]
    every = F.filter(F.concat(F.array(composed_), F.coalesce(person_variants(name), F.array().cast("array<string>")), F.array(*lines)), lambda v: v.isNotNull() & (F.trim(v) != ""))
    low = F.transform(every, lambda v: F.lower(v))
    return F.filter(every, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)


@F.pandas_udf(StringType())
def person(questions: pd.Series) -> pd.Series:
    return questions.map(person_of)


@F.pandas_udf(StringType())
def course(questions: pd.Series) -> pd.Series:
    return questions.map(course_of)


@F.pandas_udf(IntegerType())
def credits(texts: pd.Series, courses: pd.Series) -> pd.Series:
    return pd.Series([credits_near(t, c) for t, c in zip(texts, courses)], dtype="Int32")


def composed(current: Column, prior: Column, site: rules.Site = rules.Site()) -> Column:
    """The text to search for: the last two earlier questions, the current one, the site's name where nothing names
    it, and at most one line for the first intent that holds."""
    said = F.concat(prior, F.array(F.trim(F.coalesce(current, F.lit("")))))
    merged = F.array_join(F.filter(F.slice(said, F.greatest(F.size(said) - 2, F.lit(1)), F.lit(3)), lambda t: F.trim(t) != ""), "\n")
    named = F.when(rules.has(merged, site.names), merged).otherwise(F.concat(merged, F.lit(f"\n{site.name}")))
    i = lambda n: rules.intent(merged, n)
    # What is added to a question of each intent.
    line = (
        F.when(i("location"), "campus address contact communication and transportation")
        .when(i("catalogue"), "course catalogue curriculum program structure ECTS courses")
        .when(i("requirements"), "international students application requirements diploma exam scores")
        .when(i("international"), "international students admission application how to apply deadlines")
        .when(i("wide_fee"), "tuition fees of all programs academic year fee schedule")
        .when(i("fee"), "tuition fee scholarship payment of the department")
        .when(i("roster"), "department academic staff list faculty members professors")
        .when(i("leadership"), "faculty deans rector leadership management board")
        .when(rules.intent(current, "stem"), "faculty of engineering departments")
        .when(rules.intent(current, "department"), "faculties departments schools programs")
    )
    return F.when(merged == "", F.lit("")).otherwise(F.concat_ws("\n", named, line))


def person_variants(name: Column, most: int = 3) -> Column:
    """More ways to search for a person."""
    # What pages about a person also say.
    tails = ("head of department message from head faculty staff", "department chair message faculty", "bolum baskan department chair associate professor", "academic staff contact")
    made = F.array(*[F.concat(name, F.lit(" " + t)) for t in tails[:most]])
    return F.when(F.length(name) >= 4, made).otherwise(F.array().cast("array<string>"))
