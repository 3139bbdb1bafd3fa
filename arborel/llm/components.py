"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborel.llm.common import dealt, stored


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): each node of the edges (a, b) with the smallest node that it reaches.

    Every round writes its edges to the shared folder, so lineage stays short and a lost executor costs one round.
    Nothing is collected but the number of edges that are not yet part of a star. Null ends and loops are left out.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = stored(e)
    for _ in range(most_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = dealt(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = dealt(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = stored(moved.where("u <> v").distinct())
        # a forest of stars: no node with two parents, and no parent that has one
        again = e.groupBy("u").count().where("count > 1").select("u").union(e.select("v").distinct().join(e.select(F.col("u").alias("v")), "v", "left_semi").select(F.col("v").alias("u")))
        if again.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
