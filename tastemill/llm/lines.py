"""Line dedup by how many pages of a site hold a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.llm.frames import BROADCAST_ROWS
from tastemill.session import stored

#: A line on more than this share of its host's pages is boilerplate, if it is on at least so many pages.
RATIO, LEAST_PAGES = 0.3, 3
SALTS = 16

#: Patterns that turn markup into lines. Each opening reads on to its end or, if it has none, to the end of
#: the page (comments, scripts, styles) or to the next "<" (tags, which then are no tags): no part of a page is read twice.
HIDDEN = r"(?is)<!--(?:.*?-->|.*)|<(script|style)\b[^<>]*>(?:.*?</(script|style)>|.*)"
BLOCK = (
    r"(?i)</?(p|div|li|ul|ol|h[1-6]|tr|td|th|table|br|nav|article|section|header|footer|title|head|body|html|pre"
    r"|blockquote|main|aside)\b[^<>]*>"
)
TAG = r"<[^<>]*>"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    """Host of an address in lower case, without user and port; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 2)), F.lit(""))


def lines_of(html: Column) -> Column:
    """Lines of a page's text in order: block tags end lines, blanks are squeezed, empty lines go. Null gives none."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), TAG, "")
    # Single blanks, which are nearly all of them, match nothing here.
    text = F.regexp_replace(text, r"[\x20\x09\x0D]{2,}|[\x09\x0D]", " ")
    text = F.btrim(F.regexp_replace(text, r"[\x20]?[\x0A][\x0A\x20]*", "\n"), F.lit("\n "))
    return F.filter(F.split(text, "\n"), lambda x: x != "")


def line_dedup(
    pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html",
    ratio: float = RATIO, least: int = LEAST_PAGES,
) -> DataFrame:
    """(id, host, lines, kept): each page's lines and those that stay. One row per row of `pages`.

    A line goes from all pages of a host if more than `ratio` of the host's pages hold it, and `least` pages at least
    (so a host of one page keeps its text). A page counts a line once. Pages without a host keep all lines; pages
    without text have none. A comment, script or style that is not closed hides the rest of its page. Rows that are alike in all three columns are pages of their own in the counts.

    Lines are counted as hashes by (host, line), which spreads a large host; only the few keys above the
    ratio meet the pages again, salted unless they are counted to be few.
    """
    page = F.xxhash64(F.coalesce(F.col(id).cast("string"), F.lit("\0null")), url, html)
    split = pages.select(
        F.col(id).alias("id"), page.alias("page"), host_of(F.col(url)).alias("host"), lines_of(F.col(html)).alias("lines")
    )
    marks = F.when(F.col("host").isNotNull(), F.transform("lines", lambda x: F.xxhash64("host", x)))
    split = stored(split.withColumn("marks", marks))
    totals = split.filter("host is not null").groupBy("host").agg(F.count("*").alias("pages"))
    seen = split.select("host", F.explode(F.array_distinct("marks")).alias("mark"))
    counts = stored(seen.groupBy("host", "mark").agg(F.count("*").alias("n")).filter(F.col("n") >= least))
    # A large host's lines are dealt over several tasks.
    salt = F.explode(F.array(*(F.lit(i).cast("bigint") for i in range(SALTS)))).alias("salt")
    dealt = counts.withColumn("salt", F.pmod(F.xxhash64("mark"), F.lit(SALTS)))
    boiler = dealt.join(totals.select("host", "pages", salt), ["host", "salt"])
    boiler = stored(boiler.filter(F.col("n") > ratio * F.col("pages")).select("mark").distinct())
    held = split.select("page", F.explode(F.array_distinct("marks")).alias("mark"))
    if boiler.count() <= BROADCAST_ROWS:
        held = held.join(F.broadcast(boiler), "mark")
    else:
        held = held.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)))
        held = held.join(boiler.select("mark", salt), ["mark", "salt"])
    gone = held.groupBy("page").agg(F.collect_set("mark").alias("gone"))
    met = split.join(gone, "page", "left")
    both = F.arrays_zip(F.col("lines").alias("line"), F.col("marks").alias("mark"))
    left = F.filter(both, lambda x: ~F.array_contains(F.col("gone"), x["mark"]))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(left, lambda x: x["line"]))
    return met.select("id", "host", "lines", kept.alias("kept"))
