"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import checkpointed

def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for every node of edges(a, b) that isn't its own root.

    Each round hooks every node's larger neighbours to its smallest one, then every
    node's smaller neighbours. Minima are aggregated before rows meet, and the joins
    back to a node are sort-merge joins whose large keys Spark splits, so a hub needs
    no task of its own. Every round is checkpointed. Self loops and repeated edges are
    allowed.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    now, seen = checkpointed(now), None
    while True:  # ends: every round but the last makes some root smaller
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (mark["n"], mark["h"]) == seen or not mark["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = (mark["n"], mark["h"])
        # Large star: u's larger neighbours hook to the smallest of u and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = now.select(F.col("v").alias("k"), F.col("u").alias("far")).join(least, "k").select(F.col("far").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours hook to the smallest neighbour.
        least = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        near = large.select(F.col("u").alias("k"), F.col("v").alias("near")).join(least, "k").where("near <> m").select(F.col("near").alias("u"), F.col("m").alias("v"))
        now = checkpointed(near.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
