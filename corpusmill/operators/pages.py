"""Counts and checks of HTML pages by their tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TAG = r"<([a-zA-Z][a-zA-Z0-9]*)"


def tags(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(TAG), 1), F.lower)


def census(pages: DataFrame, html: str = "html") -> DataFrame:
    """For each page its elements, and how many of them are inputs, buttons, links, images and headings."""
    t = pages.select("page_id", tags(F.col(html)).alias("t"))
    n = lambda *names: F.size(F.filter("t", lambda x: x.isin(*names)))
    return t.select("page_id", F.size("t").alias("total"), n("input", "select", "textarea").alias("inputs"), n("button").alias("buttons"), n("a").alias("links"), n("img").alias("images"), n("h1", "h2", "h3", "h4", "h5", "h6").alias("headings"))


def top_tags(pages: DataFrame, html: str = "html", n: int = 15) -> DataFrame:
    """The most frequent tags of each page."""
    counts = pages.select("page_id", F.explode(tags(F.col(html))).alias("tag")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("n"), "tag"))).where(F.col("rank") <= n)


def presence(pages: DataFrame, html: str = "html") -> DataFrame:
    """Whether a page has a menu, main part, footer and search, and how many headings, buttons, links, images and forms."""
    has = lambda p: F.coalesce(F.col(html).rlike("(?i)" + p), F.lit(False))
    n = lambda p: F.coalesce(F.regexp_count(F.col(html), F.lit("(?i)" + p)), F.lit(0))
    return pages.select(
        "page_id",
        has(r"<nav\b|role=.navigation").alias("has_nav"),
        has(r"<(main|article)\b|role=.main").alias("has_main"),
        has(r"<footer\b").alias("has_footer"),
        has(r"type=.search|role=.search").alias("has_search"),
        n(r"<h[1-6]\b").alias("headings"),
        n(r"<button\b").alias("buttons"),
        n(r"<a\s").alias("links"),
        n(r"<img\b").alias("images"),
        n(r"<form\b").alias("forms"),
    )
