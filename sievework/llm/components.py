"""Connected components of a table of links, by stars that contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.work import settle

#: Links that one task takes; every step runs in as many tasks as its links need, not in as many as shuffles have.
LINKS = 50_000


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); a component is named by its smallest node.

    Large and small stars in turn (Kiveris and others, Connected Components in
    MapReduce and Beyond, 2014): every node's larger neighbours are linked to
    its smallest neighbour, then its smaller ones, until nothing changes.  Each
    step is an aggregation and a join, so a node with many links is reduced
    before the shuffle.  Most steps handle far fewer rows than the tables the
    links come from, so their tasks follow the number of links.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while True:
        tasks = 1 + before[0] // LINKS
        edges = edges.coalesce(tasks)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").coalesce(tasks).distinct())
        edges = settle(small.coalesce(tasks))
        # Stable when the sum over links no longer changes: every step only moves ends to smaller nodes.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct().coalesce(tasks)


def stars(parts: DataFrame) -> DataFrame:
    """Links (a, b) with the components that were found: every node with the smallest one of its component."""
    return parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
