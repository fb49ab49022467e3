"""Crawling over a table of fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import web


def crawl_log(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """url, ok, reason, title, chars, links of each page: policy, robots, prose, in this order."""
    rows = web.extracted(pages).withColumn("normal", web.normalized_url(F.col("url")))
    reason = web.target_reason(F.col("url"))
    if rules is not None:
        rows = rows.join(web.robots_allowed(rows.select("url").distinct(), rules), "url", "left")
        reason = F.coalesce(reason, F.when(~F.coalesce("allowed", F.lit(True)), F.lit("blocked by robots.txt")))
    reason = F.coalesce(reason, F.when((F.trim("title") == "") & (F.trim("body") == ""), F.lit("no prose")))
    return rows.select("url", "normal", reason.isNull().alias("ok"), F.coalesce(reason, F.lit("")).alias("reason"), "title", F.length("body").cast("long").alias("chars"), "links")


def breadth_first(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(url, depth) reached from seeds (url) over edges (src, dst) within so many steps; each url once, at its least depth.

    One join of the frontier with the edges and one anti-join with what was seen a step; the number of steps is the
    depth asked for.
    """
    seen = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    frontier = seen.select("url")
    for step in range(1, depth + 1):
        frontier = edges.join(frontier, edges["src"] == frontier["url"], "left_semi").select(F.col("dst").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(step)))
    return seen


def schedule(urls: DataFrame, min_interval: float) -> DataFrame:
    """(url, host, at): seconds at which each url (url, seq, delay) may be fetched, so that a host is left alone for its delay."""
    host = F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]*)", 1)
    before = Window.partitionBy("host").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return urls.withColumn("host", host).withColumn("at", F.coalesce(F.sum(F.greatest(F.lit(min_interval), F.coalesce("delay", F.lit(0.0)))).over(before), F.lit(0.0))).select("url", "host", "at")
