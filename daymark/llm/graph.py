"""Connected components of a graph given as a table of links, by alternating large and small stars.

Every round is a group minimum (combined before the shuffle) and a join on the node.  The minima are written first, so
both sides of the join are plain shuffles that Spark can split where one node holds a large share of the links.  Rounds
end when the links no longer change; they then form one star per component around its least node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymark.session import settle


def _lowest(links: DataFrame) -> DataFrame:
    return settle(links.groupBy("a").agg(F.min("b").alias("low")))


def _large(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least node of its neighbourhood."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _lowest(both)
    joined = both.where("b > a").join(low, "a")
    return settle(joined.select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct())


def _small(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them (links have a > b)."""
    joined = links.join(_lowest(links), "a")
    moved = joined.where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return settle(moved.unionByName(joined.select("a", F.col("low").alias("b"))).distinct())


def _mark(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (columns a, b of one orderable type) that is not itself the least.

    The root is the least node of the component.  NULL nodes and links of a node to itself are left out; an empty table
    gives an empty result.
    """
    links = settle(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = _mark(links)
    while mark[0]:
        links = _small(_large(links))
        before, mark = mark, _mark(links)
        if before == mark:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
