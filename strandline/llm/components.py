"""Connected components of a graph given as edges, by alternating stars; every step is a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From edges (u, v) of longs: (node, component), the component being its smallest node. Nodes without edges are absent.

    Each round hangs every node's larger neighbours on its smallest neighbour, then the smaller ones; the edges end as
    stars, and edges that come as stars need no round. Rounds grow with the logarithm of the longest path. No node's
    neighbours are ever gathered in a row."""
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "cc")
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so both sides of the join are plain shuffles, which Spark may split where a node has very many edges
        near = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") < F.col("u")).alias("below"), F.count_if(F.col("v") > F.col("u")).alias("above")), "cc-least")
        # in stars a node has one smaller neighbour and no larger one, or no smaller one
        if near.where("below > 1 OR (below > 0 AND above > 0)").isEmpty():
            break
        large = both.join(near.select("u", F.least("u", "m").alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = written(small, "cc")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
