"""Connected components of a graph of any size, by alternating large and small stars.

Each round joins every node with its smallest neighbour; both star steps keep the
components and after a number of rounds that grows with the logarithm of a component's
width only stars around the smallest node are left. Nothing is collected: a round's
edges are a table in the shared folder, so a lost executor costs the present round at
most, and a node with very many neighbours is met by a join that may be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prescriva.llm import shared


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (two long columns) that isn't its component's smallest node.

    Loops and repeated edges are fine; no edges give no rows.
    """
    spark = edges.sparkSession
    a, b = edges.columns
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    now, before, path = shared.written(now, "edges"), None, []
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, old = seen, now
        now = shared.written(_small_star(_large_star(now).distinct()).distinct(), "edges")
        path.append(old.inputFiles()[0].rsplit("/", 1)[0])
        shared.remove_dir(spark, path[-1])
