"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_size, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every node tells its larger neighbours of the smallest node it sees. Small star: its smaller ones, and itself."""
    if large:
        rows = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        rows = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
    total = edges.count() * (2 if large else 1)
    told = join_by_size(rows, lowest, ["u"], "n", total)
    if large:
        out = told.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = told.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, label) for every node of ``edges`` (two long columns), label the smallest node reachable.

    Every round is written to the shared folder. A node with many links is
    aggregated before its exchange and joined by size, so neither stars nor
    chains gather in a task; the number of rounds grows with the logarithm of a
    component's diameter. Null ends and loops are ignored.
    """
    a, b = edges.columns
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges, last = materialise(edges, "links"), None
    for _ in range(most_rounds):
        edges = materialise(_star(materialise(_star(edges, True), "large_star"), False), "small_star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
