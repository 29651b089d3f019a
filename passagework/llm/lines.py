"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.urls import host_of

#: What is not shown, and where a line of a page ends.
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BREAK = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>|\n"
TAG = r"<[^>]*>"
EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def lines_of(html: Column) -> Column:
    """A page's visible lines: text between block tags and line ends, without other tags and outer white space, none empty."""
    shown = F.split(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " "), BREAK)
    return F.filter(F.transform(shown, lambda x: F.regexp_replace(F.regexp_replace(x, TAG, ""), EDGES, "")), lambda x: x != "")


def drop_boilerplate(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", *, ratio: float = 0.2,
                     least_pages: int = 5, salts: int = 32) -> DataFrame:
    """One row per page: page_id, host, n_lines, n_dropped, kept (the remaining lines, an array).

    A line goes if over `ratio` of its host's pages hold it and the host has `least_pages` pages. Lines are known by
    their MD5 digest. Each page counts a line once, with map-side combine. A host can have no more lines above the ratio
    than its pages have lines on average, divided by the ratio, so they fit one row a host; that row is
    copied for `salts` shares of the host's pages, so a host with a third of all pages is spread.

    Null html has no lines; null urls and urls without `://` share the empty host; null ids and rows that repeat an id
    are pages of their own. An empty table gives no rows.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), lines_of(F.col(html)).alias("lines"))
    totals = pages.groupBy(host_of(F.col(url)).alias("host")).agg(F.count("*").alias("pages")).filter(F.col("pages") >= least_pages)
    counts = (
        rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.unhex(F.md5(x))))).alias("digest"))
        .groupBy("host", "digest").agg(F.count("*").alias("n")).filter("n > 1")
    )
    often = (
        counts.join(totals, "host").filter(F.col("n") / F.col("pages") > ratio)
        .groupBy("host").agg(F.collect_list("digest").alias("often"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "lines"), F.lit(salts)).cast("int"))
    joined = salted.join(often, ["host", "salt"], "left")
    kept = F.when(F.col("often").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("often"), F.unhex(F.md5(x)))))
    return joined.select("page_id", "host", F.size("lines").alias("n_lines"), kept.alias("kept")).select(
        "page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), "kept")
