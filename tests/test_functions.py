"""Column functions on fixed pairs of input and output."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import chunking, html, questions, rules, text, urls


def one(spark, column, **values):
    """Value of an expression over one row of strings."""
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def of(spark, f, value):
    return one(spark, f(F.col("v")), v=value)


def test_fixed_windows(spark):
    f = chunking.fixed_windows
    assert of(spark, f, "") == of(spark, f, None) == of(spark, f, "  \n ") == []
    assert of(spark, f, "a" * 700) == ["a" * 700]
    assert of(spark, f, "hello   world\n\nfoo   bar") == ["hello world foo bar"]
    assert [len(c) for c in of(spark, f, "a" * 1281)] == [700, 700, 121]
    with pytest.raises(ValueError):
        chunking.fixed_windows(F.lit("x"), 10, 10)


def test_greedy_splitters():
    assert chunking.split_long("short") == ["short"] and chunking.split_long("  ") == []
    long = " ".join(["word"] * 400)
    assert all(len(c) <= 700 for c in chunking.split_long(long)) and "".join(chunking.split_long(long)).count("word") >= 400
    assert len(chunking.split_long("x" * 60, 20, 15)) < 60  # a large overlap still moves on
    assert chunking.pack_paragraphs("a\n\nb\n \nc") == ["a\n\nb\n\nc"]
    assert [len(c) for c in chunking.pack_paragraphs("a" * 400 + "\n\n" + "b" * 400)] == [400, 400]


def test_page_chunks(spark):
    rows = spark.createDataFrame(
        [(1, "u1", "t", "text " * 20, ["unit one here", "unit two here", "unit three", "unit four"]), (2, "u2", "t", "p " * 1200, ["tiny unit"]), (3, "u3", "t", "  ", None)],
        "page_id long, url string, title string, content string, embedding_units array<string>",
    )
    got = chunking.page_chunks(rows).collect()
    assert [(r["page_id"], r["chunk_index"]) for r in got if r["page_id"] == 1] == [(1, 0), (1, 1), (1, 2), (1, 3)]
    assert len([r for r in got if r["page_id"] == 2]) > 1 and not [r for r in got if r["page_id"] == 3]


@pytest.mark.parametrize(
    "url, english, want",
    [
        ("https://www.example.edu/en", True, "https://example.edu/en"), ("https://example.edu/en/a#section", True, "https://example.edu/en/a"), ("https://example.edu/tr/a", True, ""),
        ("ftp://example.edu/en", False, ""), ("example.edu/en/a", True, "https://example.edu/en/a"), ("https://example.edu/en?a=1", True, "https://example.edu/en?a=1"), ("https://other.org/en", False, ""), (None, False, ""),
    ],
)
def test_normalized_urls(spark, url, english, want):
    assert one(spark, urls.normalized(F.col("v"), ("example.edu",), english), v=url) == want


@pytest.mark.parametrize("path, want", [("/en", True), ("/en/about", True), ("/en/", True), ("/EN/about", True), ("/", False), ("/energy", False)])
def test_english_path(spark, path, want):
    assert of(spark, urls.english_path, path) is want


@pytest.mark.parametrize("link, want", [("https://o.org/x", "https://o.org/x"), ("/a", "https://h.org/a"), ("b", "https://h.org/p/b"), ("?q=1", "https://h.org/p/c?q=1"), ("//x.org/y", "https://x.org/y"), ("a?x=1&amp;y=2", "https://h.org/p/a?x=1&y=2"), ("#top", "https://h.org/p/c")])
def test_joined_urls(spark, link, want):
    assert one(spark, urls.joined(F.lit("https://h.org/p/c"), F.col("v")), v=link) == want


def test_unit_tabs(spark):
    assert of(spark, lambda u: urls.unit_tabs(u, ("/c.aspx",)), "https://h.org/shell?cursunit=6166") == ["https://h.org/c.aspx?curSunit=6166"]
    assert of(spark, lambda u: urls.unit_tabs(u, ("/c.aspx",)), "https://h.org/other") == []
    tabs = of(spark, lambda u: urls.programme_tabs(u, "/cat/"), "https://h.org/cat/index.aspx?lang=tr&curOp=showPac&curUnit=09&CURSUNIT=6166")
    assert len(tabs) == len(set(tabs)) == 18 and "https://h.org/cat/progCourses.aspx?lang=en&curSunit=6166" in tabs and tabs[-1].startswith("https://h.org/cat/progContact.aspx?")
    for other in ("https://h.org/cat/index.aspx?curSunit=6166", "https://h.org/cat/index.aspx?curOp=showPac&curSunit=x1", "https://h.org/cat/index.aspx?curOp=showPac", ""):
        assert of(spark, lambda u: urls.programme_tabs(u, "/cat/"), other) == []


def test_html_records():
    page = "<table><tr><th>h</th></tr><tr><td>Ann</td><td>Dean</td></tr><tr><td>Bob</td></tr></table><ul><li>first item</li><li>second item</li></ul><dl><dt>Term</dt><dd>one</dd><dd>two</dd></dl>"
    assert html.units_of(page) == ["Ann\nDean", "Bob", "first item", "second item", "Term\none\ntwo"]
    assert html.units_of("<ul><li>a item</li><li>A  item</li></ul>") == ["a item"] and html.units_of(None) == []
    assert html.units_of("<table><tr><td><ul><li>inside a table</li></ul></td></tr></table>") == ["inside a table"]
    # rows stop at the limit, a list that has begun is read to its end
    assert len(html.units_of("<table>" + "".join(f"<tr><td>item {i}</td></tr>" for i in range(400)) + "</table>")) == 320


def test_html_records_of_careless_pages():
    """End tags left out, stray ones, elements as deep as a page likes."""
    assert html.units_of("<ul><li>alpha<li>beta<li>gamma</ul>") == ["alpha", "beta", "gamma"]
    assert html.units_of("<table><tr><th>head<tr><td>one<td>two<tr><td>three</table>") == ["one\ntwo", "three"]
    assert html.units_of("<dl><dt>term<dd>meaning<dd>more<dt>other<dd>sense</dl>") == ["term\nmeaning\nmore", "other\nsense"]
    assert html.units_of("<ul><li>one <ul><li>inner<li>inner two</ul><li>last</ul></p></div>") == ["one\ninner\ninner two", "last", "inner", "inner two"]
    assert html.units_of("<p>x" * 3000 + "<ul><li>item one</ul>") == ["item one"]
    assert html.units_of("<div>" * 20_000 + "<ul><li>item one</ul>") == ["item one"]
    assert html.units_of("<table><tr><td>" * 1500 + "deep cell") != []
    many = "<ul>" + "".join(f"<li>item {i}</li>" for i in range(400)) + "</ul>"
    assert len(html.units_of(many)) == 400 and len(html.units_of(many + "<ul><li>another list</li></ul>")) == 400
    assert html.units_of("<table><tr><td><ul><li>in a table</li></ul></td></tr></table>") == ["in a table"]


def test_html_text(spark):
    page = "<html><head><title> Test &amp; Page </title><style>p{}</style></head><body><nav>menu</nav><main><p>Hello</p><script>x()</script><p>World</p></main></body></html>"
    assert of(spark, html.title, page) == "Test & Page" and of(spark, html.text, page) == "Hello\nWorld" and of(spark, html.text, "") == ""


@pytest.mark.parametrize("q, want", [("4. semester", 4), ("4th semester", 4), ("semester 5", 5), ("first semester", 1), ("4..Semester", 4), ("semester-4", 4), ("semester 9", None), ("3. dönem", None), ("üçüncü dönem", 3), ("", None)])
def test_semesters(spark, q, want):
    assert of(spark, text.semester, q) == want


def test_credits(spark):
    assert of(spark, text.ects_of_row, "CSE 220 Web Programming 3+0+0 Compulsory 6 Face To Face") == 6
    assert of(spark, text.ects_of_row, "no numbers") is None
    table = "CSE 220 Web Programming 3+0+0 Compulsory 6 Face To Face\nCSE 221 Networks 3+0+0 Compulsory 5\nTotal ECTS 30"
    assert questions.credits_near(table, "web programming") == 6 and questions.credits_near(table, "chemistry") is None
    assert questions.credits_near("Web Programming\n\n\n\nTotal ECTS 30", "web programming") is None
    near = questions.credits_near
    assert near("Algebra 6 ECTS", "algebra") == 6 and near("Algebra 3+0+0 5 (ECTS)", "algebra") == 5 and near("Algebra 3+0+4 ECTS", "algebra") is None
    assert near("Algebra " + "x " * 100 + "\n\n" + "y\n" * 4 + "ECTS: 7", "algebra") == 7 and near("ECTS - 4\n" * 1 + "a\nb\nc\nAlgebra", "algebra") == 4
    assert near("Introduction to Algebra ECTS 8", "linear algebra") == 8 and near("ECTS 3+0 then", "ects") is None and near("", "a") is None and near(None, None) is None
    assert near("Algebra " + "x" * 3000 + " ECTS 5", "algebra") is None


def test_addresses_are_found_wherever_they_stand(spark):
    base, root = "https://courses.example.edu/catalogue/index.aspx?lang=en", "https://courses.example.edu/catalogue/"
    mined = lambda source: {r["url"].removeprefix(root): r["is_detail"] for r in of(spark, lambda h: urls.mined(h, F.lit(base), "courses.example.edu", "/catalogue/"), source)}
    assert mined("foo progCourses.aspx?lang=en&amp;curSunit=62 bar progAbout.aspx?curSunit=6") == {"progCourses.aspx?lang=en&curSunit=62": False, "progAbout.aspx?curSunit=6": False}
    assert mined("x https://courses.example.edu/catalogue/progCourses.aspx?u=9 https://courses.example.edu/catalogue/OtherTool.aspx") == {"progCourses.aspx?u=9": False, "OtherTool.aspx": False}
    assert mined("program.aspx?x=1 https://courses.example.edu/catalogue/program.aspx?x=1 https://other.org/catalogue/x.aspx?b=2 /elsewhere/x.aspx?a=1") == {}
    assert mined("<a href=facNewType.aspx?u=1>x</a> onclick=go(dynConPage.aspx?u=2) '/catalogue/unitSelection.aspx' unitSelection.aspx?type=lis") == {"facNewType.aspx?u=1": False, "dynConPage.aspx?u=2": False, "unitSelection.aspx": False, "unitSelection.aspx?type=lis": False}
    assert mined("go('index.aspx?curOp=showPac&amp;u=1') //courses.example.edu/catalogue/index.aspx?curOp=SHOWPAC&u=2 showPac javascript:showPac(1)") == {"index.aspx?curOp=showPac&u=1": True, "index.aspx?curOp=SHOWPAC&u=2": True}
    assert mined("") == {} and mined(None) == {}
    assert questions.course_of("What is the semester and ECTS of Web Programming?") == "web programming"


@pytest.mark.parametrize("q, want", [("Who is Ahmet Bulut?", "Ahmet Bulut"), ("Ahmet Bulut kimdir", "Ahmet Bulut"), ("who is the dean", None), ("Prof. Dr. Ayse Kaya kim?", "Ayse Kaya"), ("what is this", None), (None, None)])
def test_persons(q, want):
    assert questions.person_of(q) == want


def test_snippets(spark):
    long = "x" * 1200 + " Ahmet Bulut " + "y" * 400
    s = one(spark, text.snippet(F.col("t"), F.lit("Ahmet Bulut"), 400), t=long)
    assert len(s) == 400 and "Ahmet Bulut" in s
    assert one(spark, text.snippet(F.col("t"), F.lit("nothing here"), 400), t=long) == long[:400]
    assert one(spark, text.snippet(F.col("t"), F.lit("Zıraksıma"), 40), t="a" * 100 + " Ziraksima " + "b" * 100).strip().count("Ziraksima") == 1
    assert one(spark, text.snippet(F.col("t"), F.lit(""), 4), t=None) == ""


def test_names_in_contents(spark):
    inside = lambda c, n: one(spark, rules.name_in(F.col("c"), F.col("n")), c=c, n=n)
    assert inside("Bulut, Ahmet (chair)", "Ahmet Bulut") and inside("ZIRAKSIMA x", "Zıraksıma") and not inside("Ahmet", "Ahmet Bulut") and not inside("", "x y")
    allowed = lambda u, c: one(spark, rules.identity_allowed(F.col("u"), F.lit("t"), F.col("c"), F.lit("Ahmet Bulut")), u=u, c=c)
    assert not allowed("https://e.edu/commissions", "Ahmet Bulut") and allowed("https://e.edu/academic-staff", "nobody") and allowed("https://e.edu/x", "Ahmet Bulut") and not allowed("https://e.edu/x", "nobody")


@pytest.mark.parametrize("q, want", [("computer engineering", "computer-engineering"), ("bilgisayar mühendisliği", "computer-engineering"), ("health sciences", "faculty-of-health-sciences"), ("tıp fakültesi", "faculty-of-medicine"), ("campus location", None), ("", None), (None, None)])
def test_entities(spark, q, want):
    assert of(spark, rules.entity, q) == want


@pytest.mark.parametrize("q, want", [("electrical", "electrical"), ("software yazılım", "software"), ("medicine tuition fee", "faculty-of-medicine"), ("biomedical engineering", "biomedical"), ("medicine techniques fee", None)])
def test_path_segments(spark, q, want):
    assert of(spark, rules.path_segment, q) == want


@pytest.mark.parametrize("name, yes, no", [("fee", "ücret ne kadar", "hello"), ("location", "where is the campus", "who is it"), ("roster", "list the professors", "fees"), ("leadership", "rektör kim", "teachers"), ("stem", "yazılım", "nursing"), ("international", "can international students apply", "international student tuition how much"), ("requirements", "international application requirements sat", "fees"), ("undergraduate_only", "foreign students admission", "foreign students phd admission"), ("wide_fee", "all fees", "computer engineering fee")])
def test_intents(spark, name, yes, no):
    assert of(spark, lambda q: rules.intent(q, name), yes) and not of(spark, lambda q: rules.intent(q, name), no)


@pytest.mark.parametrize("q, want", [("hello!", "small_talk"), ("merhaba nasılsın", "small_talk"), ("hello where is the campus", "retrieve"), ("bitcoin price", "off_topic"), ("movie club of the university", "retrieve"), ("", "retrieve")])
def test_gates(spark, q, want):
    assert of(spark, rules.gate, q) == want


def test_keywords(spark):
    assert of(spark, text.keywords, "computer engineering tuition fees") == ["computer", "engineering", "tuition", "fees"]
    assert of(spark, text.keywords, "I am at XYZ now") == [] and of(spark, text.keywords, "fees fees what fees") == ["fees"]


def test_trimming_and_titles(spark):
    assert len(of(spark, lambda c: text.trimmed(c, 100), "a" * 200)) == 100 and of(spark, lambda c: text.trimmed(c, 100), "a" * 200)[-1] == "…"
    marked = "===CONTEXT===" + "a" * 500
    assert of(spark, lambda c: text.trimmed_last_turn(c, 100), marked) == marked and len(of(spark, lambda c: text.trimmed_last_turn(c, 100), marked + "b" * 200)) == 600
    assert of(spark, text.session_title, "a" * 199) == "a" * 197 and of(spark, text.session_title, "a" * 201) == "a" * 197 + "…"
    assert of(spark, text.without_titles, "Prof. Dr.  Ayse Kaya") == "Ayse Kaya"
    assert of(spark, text.sanitized_reply, " a===CONTEXT===b\n\n\n\nc  d ") == "ab\n\nc d" and of(spark, text.sanitized_reply, None) == ""
    good = "123E4567-e89b-12d3-a456-426614174000"
    assert of(spark, text.uuid_or_null, good) == good.lower() and of(spark, text.uuid_or_null, "garbage") is None


def test_turkish(spark):
    yes = "Bu okul için bir program ve ders listesi ile ilgili olarak hazırlanan metin değil mi acaba burada"
    assert of(spark, text.probably_turkish, yes) and not of(spark, text.probably_turkish, "Bu ve bir") and not of(spark, text.probably_turkish, "plain english text " * 10)


def test_nfkc(spark):
    assert of(spark, text.nfkc, "ﬁ①") == "fi1"
