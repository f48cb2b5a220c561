"""HTML: title, links and text by expressions; records of a page by the standard parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

TITLE_CHARS, TEXT_CHARS, UNIT_CHARS, MOST_UNITS = 500, 20_000, 1500, 320
# The entities that are decoded in expressions.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def decoded(c: Column) -> Column:
    for entity, letter in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(letter))
    return c


def title(html: Column) -> Column:
    return F.substring(F.trim(decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))), 1, TITLE_CHARS)


def stripped(html: Column) -> Column:
    """Without scripts, styles, noscript and drawings."""
    for tag in ("script", "style", "noscript", "svg"):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    return html


def main_part(html: Column) -> Column:
    """Inner HTML of main, else article, else body, else all of it."""
    parts = [F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>", 1) for tag in ("main", "article", "body")]
    out = html
    for p in reversed(parts):
        out = F.when(p != "", p).otherwise(out)
    return out


def text(html: Column) -> Column:
    """Lines of text of the main part, at most TEXT_CHARS."""
    t = decoded(F.regexp_replace(main_part(stripped(html)), r"(?s)<[^>]*>", "\n"))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\r]*\n[ \t\r]*", "\n"), "\n{2,}", "\n")
    return F.substring(F.regexp_replace(t, r"^[ \t\r\n]+|[ \t\r\n]+$", ""), 1, TEXT_CHARS)


def links(html: Column) -> Column:
    """href values of anchors, in order, but for mail, telephone and script ones."""
    found = F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return F.filter(found, lambda x: ~x.rlike(r"(?i)^\s*(mailto:|tel:|javascript:)"))


#: Elements whose start ends open ones, and the elements beyond which it does not look for them.
_ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    **{part: ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}) for part in ("thead", "tbody", "tfoot")},
}
_BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


class _Node:
    __slots__ = ("tag", "parent", "table", "first", "last", "end", "has_cell")

    def __init__(self, tag: str, parent: int, table: int, first: int):
        self.tag, self.parent, self.table, self.first = tag, parent, table, first
        self.last = self.end = self.has_cell = 0


class _Page(HTMLParser):
    """The elements of a page in the order in which they begin, each with the range of pieces of text in it. Nothing is nested,
    so that a page may be as deep as it likes; end tags that authors leave out are put in."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes, self.texts, self.open, self.count = [], [], [], {}
        self.feed(html)
        self.close()
        self.close_from(0)

    def close_from(self, depth: int) -> None:
        for k in self.open[depth:]:
            node = self.nodes[k]
            node.last, node.end = len(self.texts), len(self.nodes)
            self.count[node.tag] -= 1
        del self.open[depth:]

    def end_open(self, tags: set[str], scope: set[str]) -> None:
        """Close the outermost open element of these that stands within the scope."""
        if not any(self.count.get(t) for t in tags):
            return
        found = None
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.nodes[self.open[depth]].tag
            if tag in scope:
                break
            if tag in tags:
                found = depth
        if found is not None:
            self.close_from(found)

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self.end_open({"p"}, {"table", "td", "th", "li", "dd", "body"})
        if tag in _ENDS:
            self.end_open(*_ENDS[tag])
        parent = self.open[-1] if self.open else -1
        table = -1 if parent < 0 else parent if self.nodes[parent].tag == "table" else self.nodes[parent].table
        self.nodes.append(_Node(tag, parent, table, len(self.texts)))
        if tag == "td":
            row = next((k for k in reversed(self.open) if self.nodes[k].tag == "tr"), None) if self.count.get("tr") else None
            if row is not None:
                self.nodes[row].has_cell = 1
        if tag in _VOID:
            self.nodes[-1].last, self.nodes[-1].end = len(self.texts), len(self.nodes)
        else:
            self.open.append(len(self.nodes) - 1)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_endtag(self, tag):
        if self.count.get(tag):
            depth = next(d for d in range(len(self.open) - 1, -1, -1) if self.nodes[self.open[d]].tag == tag)
            self.close_from(depth)

    def handle_data(self, data):
        if data := data.strip():
            self.texts.append(data)

    def text(self, node: _Node) -> str:
        return "\n".join(self.texts[node.first : node.last])


def units_of(html: str | None) -> list[str]:
    """Records of a page: table rows with cells, direct list items outside tables, and terms with their definitions: each once,
    at least three characters, at most UNIT_CHARS. Once there are MOST_UNITS no further row or list is begun."""
    page = _Page(re.sub(r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>", "", html or ""))
    nodes = page.nodes
    root = next((n for tag in ("main", "article", "body") for n in nodes if n.tag == tag), None)
    own = range(len(nodes)) if root is None else range(nodes.index(root) + 1, root.end)
    seen: dict[str, str] = {}

    def add(text: str) -> None:
        unit = re.sub(r"\n{3,}", "\n\n", text.strip())[:UNIT_CHARS].rstrip()
        if len(unit) >= 3:
            seen.setdefault(re.sub(r"\s+", " ", unit).strip().lower(), unit)

    parts: dict[int, list[_Node]] = {}  # rows by their table, items and terms by their list
    for k in own:
        node = nodes[k]
        if node.tag == "tr" and node.table >= 0 and node.has_cell:
            parts.setdefault(node.table, []).append(node)
        elif node.tag in ("li", "dt", "dd"):
            parts.setdefault(node.parent, []).append(node)

    def containers(*tags: str):
        for k in own:
            if nodes[k].tag in tags and k in parts:
                if len(seen) >= MOST_UNITS:
                    return
                yield k

    for k in containers("table"):
        for row in parts[k]:
            if row.tag == "tr" and len(seen) < MOST_UNITS:
                add(page.text(row))
    for k in containers("ul", "ol"):
        for item in parts[k]:
            if item.tag == "li" and item.table < 0:
                add(page.text(item))
    for k in containers("dl"):
        group: list[str] = []
        for part in parts[k]:
            if part.tag == "dt":
                add("\n".join(x for x in group if x))
                group = [page.text(part)]
            elif part.tag == "dd" and group:
                group.append(page.text(part))
        add("\n".join(x for x in group if x))
    return list(seen.values())


@F.pandas_udf(ArrayType(StringType()))
def units(html: pd.Series) -> pd.Series:
    return html.map(units_of)


def pages_from(raw: DataFrame) -> DataFrame:
    """raw: page_id, url, html. page_id, url, title, content, embedding_units."""
    return raw.select("page_id", "url", title(F.col("html")).alias("title"), text(F.col("html")).alias("content"), units(F.col("html")).alias("embedding_units"))
