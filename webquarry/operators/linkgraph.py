"""The graph of stored pages and their links, walked breadth first.

Links are taken from each page once. A round joins the addresses that the last round has found
with the links by address, drops what is known already, and keeps the rest: the tables that are
joined get smaller from round to round, and nothing but their being empty reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.functions import urls as U
from webquarry.lineage import cut
from webquarry.operators import crawl

DEPTH = 2


def reachable(pages: DataFrame, seeds: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Addresses within ``depth`` links of the ``seeds`` (url): url, depth, found_on, priority, stored.

    The links of a page (url, html) are those of ``crawl.links``. An address has its lowest depth;
    ``found_on`` is the least address of that depth's pages that link to it (null for seeds), and
    ``stored`` tells whether the address is among the pages. Addresses stored several times have
    the links of all copies; null addresses are left out. Cycles end, as known addresses aren't
    visited again.
    """
    edges = cut(crawl.links(pages.where("url IS NOT NULL")).select("url", "link"))
    new = cut(seeds.where("url IS NOT NULL").select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("found_on")).distinct())
    known = new
    for k in range(1, depth + 1):
        found = new.select("url").join(edges, "url").groupBy("link").agg(F.min("url").alias("found_on"))
        found = found.select(F.col("link").alias("url"), F.lit(k).alias("depth"), "found_on")
        new = cut(found.join(known.select("url"), "url", "left_anti"))
        if new.isEmpty():
            break
        known = known.union(new)
    stored = pages.where("url IS NOT NULL").select("url").distinct().withColumn("stored", F.lit(True))
    return known.join(stored, "url", "left").select("url", "depth", "found_on", U.link_priority(F.col("url")).alias("priority"), F.coalesce("stored", F.lit(False)).alias("stored"))


def visited_pages(pages: DataFrame, seeds: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The stored pages that a walk from the ``seeds`` reads, with ``depth``: those found at ``depth`` included."""
    found = reachable(pages, seeds, depth).where("stored").select("url", "depth")
    return pages.join(found, "url")
