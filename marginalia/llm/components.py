"""Connected components of an edge table, as Spark joins in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import cut


def _round(links: DataFrame) -> DataFrame:
    """A large-star and a small-star step over ``lo < hi``."""
    both = links.unionByName(links.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))).toDF("u", "v")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.filter("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    # every node points to smaller ones now; it and they move to the smallest
    smallest = large.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = large.join(smallest, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(smallest.select("hi", F.col("m").alias("lo"))).distinct().select("lo", "hi")


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges`` (a, b: long).

    Large-star and small-star steps in turn: stars of any size shrink towards their
    smallest node without a node gathering its neighbours. Each round's edges are
    written to the shared folder, so a lost executor costs one round at most. With
    ``rounds`` the search stops there: nodes of one label are connected, but a component
    may still have several labels.
    """
    links = edges.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    links, before, k = cut(links), None, 0
    while rounds is None or k < rounds:
        links = cut(_round(links))
        k += 1
        if rounds is None:
            mark = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("lo", "hi"))).first()
            if mark == before:
                break
            before = mark
    # a node may point to several in an unfinished search
    down = links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
    tops = links.select(F.col("lo").alias("node")).distinct().join(down, "node", "left_anti")
    return down.unionByName(tops.withColumn("component", F.col("node")))
