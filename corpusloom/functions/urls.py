"""URL scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of addresses that carry no lasting content.
BLOCKED = ("/news", "/archive", "/events", "/event", "/haber", "/duyuru", "/blog")


def blocked(url: Column, more: tuple[str, ...] = ()) -> Column:
    low = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    out = F.lit(False)
    for part in (*BLOCKED, *(m.strip().lower() for m in more if m.strip())):
        out = out | F.contains(low, F.lit(part))
    return out


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def host(url: Column) -> Column:
    """Lower-cased host without port and leading www."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(h, r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)


def english_path(p: Column) -> Column:
    return F.coalesce(p, F.lit("")).rlike(r"(?i)^/en(/.*)?$")


def same_site(url: Column, hosts: tuple[str, ...]) -> Column:
    h = host(url)
    return F.reduce(F.array(*map(F.lit, hosts)), F.lit(False), lambda a, x: a | (h == x) | F.endswith(h, F.concat(F.lit("."), x)))


def normalized(url: Column, hosts: tuple[str, ...] | None = None, english: bool = False) -> Column:
    """http(s) address without fragment and www., with https where no scheme is given; empty if it is no such
    address, of another site or, where only English is wanted, of another language."""
    u = F.trim(F.coalesce(url, F.lit("")))
    u = without_fragment(F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), u).otherwise(F.concat(F.lit("https://"), u)))
    whole = F.concat(F.lower(F.regexp_extract(u, "^([A-Za-z]+)://", 1)), F.lit("://"), host(u), path(u), query(u))
    fits = u.rlike("(?i)^https?://") & (host(u) != "")
    if hosts:
        fits = fits & same_site(u, hosts)
    if english:
        fits = fits & english_path(path(u))
    return F.when(fits, whole).otherwise(F.lit(""))


def joined(base: Column, link: Column) -> Column:
    """A link resolved against the page it stands on: absolute, scheme-relative, rooted, query-only or relative."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    page = F.concat(root, F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    folder = F.concat(root, F.regexp_extract(F.concat(path(base), F.lit("")), "^(.*/)", 1))
    folder = F.when(folder == root, F.concat(root, F.lit("/"))).otherwise(folder)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .when(F.startswith(link, F.lit("?")), F.concat(page, link))
        .when((link == "") | F.startswith(link, F.lit("#")), base)
        .otherwise(F.concat(folder, link))
    )


def parameter(url: Column, name: str) -> Column:
    """Value of a query parameter, whatever the case of its name; null if absent."""
    v = F.regexp_extract(url, rf"(?i)[?&]{name}=([^&#]*)", 1)
    return F.when(url.rlike(rf"(?i)[?&]{name}="), v)


def preferred_language(url: Column, language: str) -> Column:
    """False only for addresses that ask for another language."""
    asked = F.lower(parameter(url, "lang"))
    return asked.isNull() | (asked == "") | (asked == language)


def unit_tabs(url: Column, pages: tuple[str, ...], unit: str = "curSunit") -> Column:
    """Addresses of the tabs of a shell page that names a numeric unit; empty for other pages."""
    root = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    value = parameter(url, unit)
    tabs = F.array(*[F.concat(root, F.lit(p + "?" + unit + "="), value) for p in pages])
    return F.when(value.rlike("^[0-9]+$"), tabs).otherwise(F.array().cast("array<string>"))


# Names of the tabs of a programme, the misspelt one too.
PROGRAMME_TABS = (
    "progAbout", "progGoalsObjectives", "progProfile", "progOfficials", "progDegree", "progAdmissionReq", "progAccessFurtherStudies", "progAccessFurhterStudies", "progGraduationReq",
    "progRecogPriorLearning", "progQualifyReqReg", "progOccupationalProf", "progLearnOutcomes", "progCourses", "progCourseMatrix", "progTYYCMatrix", "progAcademicStaff", "progContact",
)


def programme_tabs(url: Column, folder: str, language: str = "en", detail: str = "showpac", unit: str = "curSunit", names: tuple[str, ...] = PROGRAMME_TABS) -> Column:
    """Addresses of all tabs of a programme, of the address of its start page, which names a numeric unit; empty for other pages."""
    root = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    value = F.trim(parameter(url, unit))
    tabs = F.transform(F.array(*map(F.lit, names)), lambda n: F.concat(root, F.lit(folder), n, F.lit(f".aspx?lang={language}&{unit}="), value))
    return F.when(F.contains(F.lower(url), F.lit(detail)) & value.rlike("^[0-9]+$"), tabs).otherwise(F.array().cast("array<string>"))


def catalogue_url(link: Column, base: Column, host_: str, marker: str, detail: str = "showpac") -> Column:
    """A link resolved against its page, without fragment, if it leads to the catalogue: this host, and the marker in the path or the
    detail's name anywhere in the address; else empty."""
    link = F.trim(F.coalesce(link, F.lit("")))
    usable = (link != "") & ~F.startswith(link, F.lit("#")) & ~F.startswith(F.lower(link), F.lit("javascript:"))
    url = without_fragment(joined(base, link))
    inside = F.contains(F.lower(path(url)), F.lit(marker)) | F.contains(F.lower(url), F.lit(detail))
    return F.when(usable & url.rlike("(?i)^https?://") & (host(url) == host_) & inside, url).otherwise(F.lit(""))


def mined(html: Column, base: Column, host_: str, marker: str, detail: str = "showpac", kind: str = "aspx", chooser: str = "unitSelection") -> Column:
    """Catalogue addresses that stand anywhere in a page's source, also in scripts: (url, is_detail), each once. Words that hold
    the detail's name, whole addresses of pages of the kind, names of such pages with a query (behind quotes, brackets or an equals
    sign too) and words that name the page where units are chosen, resolved against the catalogue's folder; the start page is none."""
    folder = F.lit(f"https://{host_}{marker}")
    clean = F.replace(F.coalesce(html, F.lit("")), F.lit("&amp;"), F.lit("&"))
    words = lambda text, pattern: F.regexp_extract_all(text, F.lit(rf"(?i)({pattern})"), F.lit(1))
    any_ = r"[^\s\"'<>]*"
    details = F.filter(words(clean, any_ + detail + any_), lambda w: (F.length(w) >= 8) & ~w.rlike("(?i)^javascript"))
    whole = words(clean, rf"https?://{any_}\.{kind}{any_}")
    rest = F.regexp_replace(clean, rf"(?i)https?://{any_}", " ")
    names = words(rest, rf"(?<![A-Za-z0-9_./-])/*(?:[A-Za-z0-9_.-]+/)*[A-Za-z][A-Za-z0-9_-]*\.{kind}\?[^\s\"'<>)]+")
    pages = F.filter(F.concat(whole, names, words(rest, rf"[^\s\"'<>(=]*{chooser}\.{kind}{any_}")), lambda w: ~w.rlike(rf"(?i)(^|/)program\.{kind}") & ~F.contains(F.lower(w), F.lit(detail)))
    found = lambda ws, is_detail: F.transform(ws, lambda w: F.struct(catalogue_url(w, folder, host_, marker, detail).alias("url"), F.lit(is_detail).alias("is_detail")))
    return F.array_distinct(F.filter(F.concat(found(details, True), found(pages, False)), lambda x: x["url"] != ""))


def skipped_label(label: Column, parts: tuple[str, ...]) -> Column:
    """Whether a menu entry holds one of the words that lead nowhere."""
    low = F.lower(F.coalesce(label, F.lit("")))
    return F.exists(F.array(*[F.lit(p.lower()) for p in parts]), lambda p: F.contains(low, p))


def client_ip(peer: Column, forwarded: Column, trusted: tuple[str, ...]) -> Column:
    """First forwarded address if the peer is a trusted proxy (by its first two octets), else the peer."""
    first = F.trim(F.substring_index(F.coalesce(forwarded, F.lit("")), ",", 1))
    is_proxy = F.substring_index(peer, ".", 2).isin(*trusted)
    return F.when(is_proxy & (first != ""), first).otherwise(peer)
