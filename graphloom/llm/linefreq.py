"""Line de-duplication by site-relative frequency: a line is boilerplate if a large share of its site's pages have it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import written

#: Elements that end a line, as a pattern of their tags.
BLOCK_TAG = r"(?i)</?(p|div|li|ul|ol|nav|h[1-6]|br|tr|td|th|table|article|section|header|footer|aside|main|title|head|body|html|blockquote|pre|hr|form|dl|dt|dd)([\x20/][^>]*)?>"
HIDDEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
ANY_TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def host_of(url: Column) -> Column:
    """The lower-case authority of a URL; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def lines_of(html: Column) -> Column:
    """The visible lines of a page, trimmed, without empty ones."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK_TAG, "\n"), ANY_TAG, "")
    return F.filter(F.transform(F.split(text, "[\r\n]+"), lambda x: F.regexp_replace(x, "^[\t ]+|[\t ]+$", "")), lambda x: x != "")


def drop_site_boilerplate(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = 0.2, least_pages: int = 3) -> DataFrame:
    """One row per row of ``pages``: id, host, n_lines, n_dropped and the kept ``text``.

    A line goes if the pages of its host that have it number at least ``least_pages`` and more than ``ratio`` of the host's
    pages.  Counts are over all pages: each page counts a line once, partial counts are summed before the shuffle, and a
    host or line of any size is spread over tasks.  Null URLs and those without a host share the host ''; null or empty
    pages have no line; ids may repeat or be null, since rows are told apart by their content: a page is identified by id,
    host and text, and repeats of one page count once each.  Other columns are not read.
    """
    base = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), lines_of(F.col(html_col)).alias("_lines"))
    base = written(base, "lines")  # pages are taken apart once
    hosts = base.groupBy("host").agg(F.count(F.lit(1)).alias("_pages"))
    keys = base.select("_id", "host", F.explode(F.array_distinct(F.transform("_lines", lambda x: F.xxhash64(x)))).alias("_line"))
    counts = keys.groupBy("host", "_line").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_pages)
    common = counts.join(hosts, "host").where(F.col("_n") > ratio * F.col("_pages")).select("host", "_line")
    # The distinct lines of a page are bounded by the page, so its common lines may meet in one row.
    marks = keys.select("_id", "host", "_line").distinct().join(common, ["host", "_line"]).groupBy("_id", "host").agg(F.collect_set("_line").alias("_common"))
    joined = base.join(marks.withColumnRenamed("_id", "_mid").withColumnRenamed("host", "_mhost"), F.col("_id").eqNullSafe(F.col("_mid")) & (F.col("host") == F.col("_mhost")), "left")
    drop = F.coalesce(F.col("_common"), F.array().cast("array<bigint>"))
    kept = F.filter("_lines", lambda x: ~F.array_contains(drop, F.xxhash64(x)))
    out = joined.select("_id", "host", F.size("_lines").cast("long").alias("n_lines"), kept.alias("_kept"))
    return out.select(F.col("_id").alias(id_col), "host", "n_lines", (F.col("n_lines") - F.size("_kept")).alias("n_dropped"), F.array_join("_kept", "\n").alias("text"))
