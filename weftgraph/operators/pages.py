"""The graph of stored pages: links, domains, reach in crawl order, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import resolve_url
from ..staging import stage


def domain_allowed(url: Column, allow: list[str], block: list[str]) -> Column:
    """The url's host is, or lies under, an allowed domain and no blocked one; an empty allow list is open."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")

    def among(domains: list[str]) -> Column:
        found = F.lit(False)
        for d in domains:
            found = found | (host == d.lower()) | host.endswith("." + d.lower())
        return found

    return F.coalesce(~among(block) & (among(allow) if allow else F.lit(True)), F.lit(False))


def page_acceptable(content_type: Column, size: Column, kinds: list[str], most: int) -> Column:
    """The response's type holds one of the allowed words and it is not too large."""
    return F.exists(F.array(*map(F.lit, kinds)), lambda k: F.lower(content_type).contains(k)) & (size <= most)


def hrefs(html: Column) -> Column:
    """Links of a page in order, without anchors, scripts and mail addresses."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return F.filter(F.transform(found, lambda h: F.trim(h)), lambda h: ~h.rlike(r"(?i)^(#|javascript:|mailto:|$)"))


def extract_links(pages: DataFrame) -> DataFrame:
    """(url, pos, href, link): every link of the stored pages, made absolute."""
    rows = pages.select("url", F.posexplode(hrefs(F.col("html"))).alias("pos", "href"))
    return rows.withColumn("link", resolve_url("url", "href"))


def crawl_order(links: DataFrame, seeds: DataFrame, allow: list[str], block: list[str], most: int) -> DataFrame:
    """(url, rank, level) of pages in first-in-first-out order from seeds (url, rank), ``most`` at most.

    Each level joins the frontier to the links and leaves out what has been seen; a level's order is (parent's rank,
    place of the link). Levels are written tables; they go on until no new page is found or ``most`` are.
    """
    seen = stage(
        (
            seeds.where(domain_allowed(F.col("url"), allow, block))
            .groupBy("url")
            .agg(F.min("rank").cast("long").alias("rank"))
            .orderBy("rank")
            .limit(most)
            .withColumn("level", F.lit(0))
        ),
        "seen",
    )
    frontier, count = seen, seen.count()
    edges = links.where(domain_allowed(F.col("link"), allow, block)).select("url", "pos", "link")
    level = 0
    while count < most:
        level += 1
        found = frontier.select("url", "rank").join(edges, "url").groupBy(F.col("link").alias("url")).agg(F.min(F.struct("rank", "pos")).alias("via"))
        new = found.join(seen.select("url"), "url", "left_anti").orderBy("via", "url").limit(most - count)
        ranked = new.select(
            "url", (F.row_number().over(Window.orderBy("via", "url")) + count).cast("long").alias("rank"), F.lit(level).alias("level"),
        )
        frontier = stage(ranked, "frontier")
        fresh = frontier.count()
        if not fresh:
            break
        seen, count = seen.unionByName(frontier), count + fresh
    return seen


def remaining(urls: DataFrame, done: DataFrame) -> DataFrame:
    """Urls that are not processed yet, once each."""
    return urls.select("url").distinct().join(done.select("url"), "url", "left_anti")


def fresh_pages(pages: DataFrame, max_age_s: int, now: Column) -> DataFrame:
    """Pages no older than ``max_age_s`` at a given moment; 0 means that none expires."""
    if max_age_s == 0:
        return pages
    return pages.where(now.cast("timestamp").cast("long") - F.col("fetched_at").cast("timestamp").cast("long") <= max_age_s)
