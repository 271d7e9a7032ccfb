"""Connected components of a table of edges, by alternating large and small stars.

Every round is two aggregations and two joins on nodes; nothing is gathered by node, so a node with
any number of edges is split like any other join key. Rounds grow with the logarithm of a component's
diameter; they go on until only stars are left, as each round that changes an edge lowers the node it
leads to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import rekeyed, remove, store


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b): one row (node, root) per node with an edge; root is the smallest node."""
    spark = edges.sparkSession
    first = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path = store(first, "edges")
    now = spark.read.schema(first.schema).parquet(path)
    settled = False
    while not settled:
        # Large star: larger neighbours move to the smallest node around.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        upper = both.where(F.col("b") > F.col("a")).join(least.select(rekeyed("a").alias("_a"), "m"), F.col("a") == F.col("_a"))
        large = upper.select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: a node and its smaller neighbours move to the smallest of them.
        large = large.where(F.col("a") != F.col("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        lower = large.join(root.select(rekeyed("a").alias("_a"), "m"), F.col("a") == F.col("_a"))
        small = lower.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        before, path = path, store(small.unionByName(root.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = spark.read.schema(first.schema).parquet(path)
        remove(spark, before)
        # Stars are what no round changes: no node has two roots, no root has one.
        ends = after.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(after.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        unsettled = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where((F.col("up") > 1) | (F.col("up") + F.col("down") > 1))
        now = after
        settled = not unsettled.limit(1).count()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
