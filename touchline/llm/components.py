"""Connected components by alternating large-star and small-star steps.

Every step is one aggregation and one join on the edge table, which never leaves the cluster; a
node with very many edges is reduced to a minimum before the shuffle, and its join is one that
adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.shared import stash


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("m"))
    return both.join(least, F.col("u") == F.col("at")).filter("v > u").select(F.col("v").alias("u"), F.least("at", "m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("m"))
    moved = down.join(least, F.col("u") == F.col("at")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("at").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) -> (node, component); the component is its smallest node, which has no row of its own."""
    edges = stash(edges.filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == mark or not row["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = row["n"], row["h"]
        edges = stash(_small(_large(edges)), "edges")
