"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.store import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "w")
    return both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
    joined = down.join(least, F.col("u") == F.col("w"))
    return joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (u, v); a component is named by its least node.

    Every round points nodes at smaller neighbours until each points at the least of its
    component; the rounds grow with the logarithm of the longest path. Minima are combined
    before they are shuffled, and each round's edges are a table, so that nothing is
    collected and lineage stays short. The result is a stored table.
    """
    edges = stored(edges.where("u <> v").select("u", "v").distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before, last = now, edges
        edges = stored(_small_star(_large_star(edges)).where("u <> v").distinct(), "edges")
        discard(last)
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out = stored(labels, "labels")
    discard(edges)
    return out
