"""Connected components of a link table by alternating large and small stars.

Each round replaces the links by links to the smallest known neighbour, first
towards larger nodes (large star), then towards smaller ones (small star), until
the link table no longer changes; it is then one star per component. All
work is grouping and joining on node ids: a node with very many links is
pre-aggregated before its shuffle and its join partition can be split. Every
round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docscope.llm.common import stash


def _fingerprint(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(links: DataFrame) -> DataFrame:
    """``links``: (a, b) node ids (long), any order, repeats allowed. Returns
    (node, root): ``root`` is the smallest node of its component; nodes without
    links do not occur, and neither do the roots themselves."""
    stars = stash(links.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-links")
    before = _fingerprint(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("n"), F.least("u", "m").alias("m"))
        # every larger neighbour of u is linked to u's smallest neighbour
        large = (stars.join(least, F.col("v") == F.col("n")).select("u", F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(smallest.select(F.col("u").alias("n"), "m"), F.col("u") == F.col("n"))
                 .filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        stars = stash(small.unionByName(smallest.select("u", F.col("m").alias("v")))
                      .filter("u <> v").distinct(), "cc-stars")
        after = _fingerprint(stars)
        if after == before:
            break
        before = after
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
