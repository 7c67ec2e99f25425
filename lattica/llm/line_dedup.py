"""Line dedup by site-relative frequency, in DataFrame functions only.

A line (without spaces, tabs and carriage returns at its ends) is boilerplate of a site if at least
``MIN_PAGES`` pages of the site hold it, and more than ``RATIO`` of all its pages. Such lines are dropped
from every page of the site; lines without characters stay.

Each page gives its distinct line hashes, so a page counts once for a line and what is shuffled are
hashes, pre-aggregated in each task by (site, line): a line or site that a third of all pages share
moves once per task. A site has fewer than (mean distinct lines per page) / RATIO boilerplate lines, so
they travel as one array per site. The arrays are written first and measured: up to ``BROADCAST_LINES``
lines of all sites they are broadcast and no text is shuffled. Beyond that, those of sites with more than one
in a thousand pages (fewer than a thousand sites) are still broadcast, and only the pages of the other
sites are joined by site, none of which weighs more than that in a task. A page's lines meet its site's
array as sets, so the cost is the sum of both, not the product.

Defined cases: a null text counts as one empty line. A null site is a site of its own. Repeated rows
are pages of their own. Other columns pass through; new ones are n_lines and n_dropped (replaced if the
table has them). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import free_name, materialize, spread_join

MIN_PAGES, RATIO = 3, 0.05
#: Boilerplate lines of all sites, 8 bytes each, that are broadcast.
BROADCAST_LINES = 1 << 21


def _key(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def _site(host: Column) -> Column:
    """The site as text that a null site has as well."""
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit("none"))


def boilerplate(pages: DataFrame, host: str, text: str = "text", min_pages: int = MIN_PAGES, ratio: float = RATIO) -> DataFrame:
    """(site, lines, pages): the hashes of each site's boilerplate lines, and how many pages it has."""
    p = pages.select(_site(F.col(host)).alias("site"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keys = F.filter(F.transform(F.split("text", "\n"), _key), lambda k: k != "")
    each = p.select("site", F.explode(F.array_distinct(F.transform(keys, lambda k: F.xxhash64(k)))).alias("line"))
    counts = each.groupBy("site", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    sites = p.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    common = counts.join(sites, "site").where(F.col("n") > ratio * F.col("pages"))
    return common.groupBy("site").agg(F.collect_set("line").alias("lines"), F.first("pages").alias("pages"))


def drop_boilerplate(pages: DataFrame, host: str, text: str = "text", min_pages: int = MIN_PAGES, ratio: float = RATIO, most: int = BROADCAST_LINES) -> DataFrame:
    """``pages`` with their boilerplate lines dropped from ``text``, and n_lines, n_dropped."""
    site, lines, own, bad, size = (free_name(pages.columns, x) for x in ("_site", "_lines", "_own", "_bad", "_pages"))
    found = materialize(boilerplate(pages, host, text, min_pages, ratio).select(F.col("site").alias(site), F.col("lines").alias(lines), F.col("pages").alias(size)))
    placed = pages.withColumn(site, _site(F.col(host)))
    if (found.agg(F.sum(F.size(lines))).first()[0] or 0) <= most:
        joined = placed.join(F.broadcast(found), site, "left")
    else:
        joined = spread_join(placed, found, site, size, pages.count(), "left")
    joined = joined.withColumn(own, F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n"))
    hashes = F.transform(own, lambda x: F.xxhash64(_key(x)))
    joined = joined.withColumn(bad, F.when(F.col(lines).isNotNull(), F.array_intersect(hashes, lines)))
    kept = F.when(F.coalesce(F.size(bad), F.lit(0)) == 0, F.col(own)).otherwise(F.filter(own, lambda x: (_key(x) == "") | ~F.array_contains(F.col(bad), F.xxhash64(_key(x)))))
    out = joined.withColumn("n_lines", F.size(own).cast("long")).withColumn(own, kept).withColumns({"n_dropped": F.col("n_lines") - F.size(own), text: F.array_join(own, "\n")})
    return out.select(*[F.col(f"`{c}`") for c in pages.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
