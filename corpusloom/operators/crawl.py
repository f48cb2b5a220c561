"""The link graph of stored pages: breadth-first levels by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.functions import html, urls
from corpusloom.operators.order import placed


def page_links(pages: DataFrame) -> DataFrame:
    """url, place, link (resolved, without fragment) of every page."""
    rows = pages.select("url", F.posexplode(html.links(F.col("html"))).alias("place", "href"))
    return rows.select("url", "place", urls.without_fragment(urls.joined(F.col("url"), F.col("href"))).alias("link"))


def allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """rules: host, prefix (disallowed). Pages whose path no rule of their host forbids; a host without rules allows
    all. The rules of a site are a small table; whether to broadcast it is left to its size."""
    rows = pages.withColumn("_host", urls.host(F.col("url"))).withColumn("_path", urls.path(F.col("url")))
    banned = rows.join(rules, (rows["_host"] == rules["host"]) & F.startswith(rows["_path"], rules["prefix"]), "left_anti")
    return banned.drop("_host", "_path")


def is_page(content_type) -> F.Column:
    low = F.lower(F.coalesce(content_type, F.lit("")))
    return F.contains(low, F.lit("text/html")) | F.contains(low, F.lit("application/xhtml"))


def reached(links: DataFrame, seeds: DataFrame, depth: int, most_pages: int = 0) -> DataFrame:
    """links: url, link. url and level (least number of links from a seed) up to a depth; with most_pages the first
    of them by level and address (0: all). Each level is written out, so that plans stay short."""
    seen = seeds.select("url").distinct().withColumn("level", F.lit(0)).checkpoint()
    frontier = seen
    for level in range(1, depth + 1):
        new = links.join(frontier.select("url"), "url", "left_semi").select(F.col("link").alias("url")).distinct()
        frontier = new.join(seen.select("url"), "url", "left_anti").withColumn("level", F.lit(level)).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen.orderBy("level", "url").limit(most_pages) if most_pages else seen


def fetchable(answers: DataFrame, rules: DataFrame) -> DataFrame:
    """answers: url, ok, content_type (what a fetch of an address brought). url and page: whether a crawl gets a page of it, that is
    no rule of the host forbids it, the fetch succeeds and what comes is HTML."""
    got = answers.where(F.coalesce("ok", F.lit(False)) & is_page(F.col("content_type")))
    return allowed(got, rules).select("url").distinct().withColumn("page", F.lit(True))


def visited(links: DataFrame, seeds: DataFrame, fetches: DataFrame, depth: int, most: int = 0) -> DataFrame:
    """A crawl in the order of a queue: links: url, place (on its page), link; seeds: url, place; fetches: url, page (others bring
    none). url, level, place (in which it is visited, from 1), page, up to a depth and until `most` pages are there (0: no end);
    addresses that bring no page are visited too, but neither count nor lead on.

    A level is visited in the order of the pages and places that name its addresses first. Where the budget ends is looked up in the
    running number of its pages, which comes from ranges; of each level the driver sees the number of rows and pages only."""
    found = seeds.select("url", F.struct(F.lit(0).cast("long").alias("of"), F.col("place").cast("long").alias("at")).alias("first"))
    seen, start, left = None, 0, most
    for level in range(depth + 1):
        new = found.groupBy("url").agg(F.min("first").alias("first"))
        if seen is not None:
            new = new.join(seen.select("url"), "url", "left_anti")
        rows = new.join(fetches, "url", "left").select("url", F.coalesce("page", F.lit(False)).alias("page"), "first.of", "first.at")
        rows = placed(rows, F.col("of"), F.col("at"), F.col("url")).drop("of", "at")
        if most:
            last = placed(rows.where("page"), F.col("place"), to="nth").where(F.col("nth") == left).select("place").first()
            rows = rows.where(F.col("place") <= last["place"]) if last else rows
        rows = rows.select("url", F.lit(level).alias("level"), (F.col("place") + start).alias("place"), "page")
        count, pages = rows.agg(F.count("*"), F.count_if("page")).first()
        seen = rows if seen is None else seen.union(rows)
        start, left = start + count, left - pages
        if not pages or (most and left <= 0):
            break
        found = links.join(rows.where("page").select("url", F.col("place").alias("of")), "url").select(F.col("link").alias("url"), F.struct("of", F.col("place").cast("long").alias("at")).alias("first"))
    return seen


def merged_details(pages: DataFrame, most: int = 12, chars: int = 8000) -> DataFrame:
    """pages: shell, url, body. The bodies of a shell's detail pages in order of their addresses, each cut."""
    order = W.partitionBy("shell").orderBy("url")
    kept = pages.dropDuplicates(["shell", "url"]).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    parts = F.array_sort(F.collect_list(F.struct("url", F.substring("body", 1, chars).alias("body"))))
    return kept.groupBy("shell").agg(F.array_join(F.transform(parts, lambda p: p["body"]), "\n\n").alias("merged"))
