"""Connected components by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node: ``edges(a, b)`` -> ``(node, root)``.

    Alternates large-star and small-star steps (Kiveris and others, 2014); each
    round is a pre-aggregated minimum and a join, its rows never outnumber the
    edges, and lineage is cut by a checkpoint.  Ends when no edge changes; any
    number of rounds is allowed for by starting again after ``most_rounds``.
    Nodes without an edge do not appear; no edges give no rows.
    """
    edges = common.checkpoint(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = common.checkpoint(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == before:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    return components(edges, most_rounds)
