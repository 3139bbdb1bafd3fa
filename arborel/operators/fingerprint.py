"""Structural fingerprints: hashed counts of node types and of parent and child types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborel.functions.vectors import DIM, feature_index, feature_sign


def features(nodes: DataFrame, id_col: str) -> DataFrame:
    """(id, feature, n): types, and parent>child types. Nodes carry their parent's type, so none are joined."""
    pair = F.when(F.col("parent").isNotNull(), F.concat("parent_type", F.lit(">"), "type"))
    both = nodes.select(id_col, F.explode(F.array_compact(F.array("type", pair))).alias("feature"))
    return both.groupBy(id_col, "feature").agg(F.count("*").alias("n"))


def components(counted: DataFrame, id_col: str) -> DataFrame:
    """[F3-F5] (id, idx, value): the entries of the unit vector that are not zero."""
    hashed = counted.select(id_col, feature_index(F.col("feature")).alias("idx"), (feature_sign(F.col("feature")) * (1 + F.log("n"))).alias("v"))
    summed = hashed.groupBy(id_col, "idx").agg(F.sum("v").alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(id_col)))
    return summed.withColumn("norm", norm).where("v <> 0 and norm > 0").select(id_col, "idx", (F.col("v") / F.col("norm")).alias("value"))


def vectors(entries: DataFrame, id_col: str) -> DataFrame:
    """[F5, F8] (id, fingerprint array<float>) of DIM entries."""
    maps = entries.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)).cast("float"))
    return maps.select(id_col, dense.alias("fingerprint"))


def example_text(good: Column, bad: Column) -> Column:
    """What an entry's fingerprint is made from: its good example, or else its bad one; null without either."""
    return F.coalesce(F.nullif(good, F.lit("")), F.nullif(bad, F.lit("")))
