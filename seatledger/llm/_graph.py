"""Connected components by alternating large-star and small-star steps
(Kiveris et al., Connected Components in MapReduce and Beyond, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge and is not itself a root.

    ``edges`` has long columns a, b; direction and repeats do not matter. A
    root is the smallest node of its component. Minima are partial
    aggregates, and the joins are plain ones that AQE can split, so a node
    with very many neighbours is no single task. Each round is a staged
    table; rounds go on until one leaves the edges as they were.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stage(pairs.distinct(), "edges")
    seen = None
    while True:
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if sign == seen or not sign[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = sign
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        now = stage(small.where("a <> b").distinct(), "edges")
