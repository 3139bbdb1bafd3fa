"""Trees as a relation of interval-encoded nodes, made from markup and from lines of text.

A node has pre, its number in document order, and last, the largest number in its subtree: b lies in a if b.pre is
between a.pre and a.last, and is its child if b.parent is a.pre.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TAG = r"<(/?[a-zA-Z][a-zA-Z0-9]*)[^>]*>"
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def markup_nodes(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """[P4] (id, pre, last, parent, depth, type, parent_type) of every element; parent is null at the top.

    An element ends where the count of open ones falls back to what it was before it, or with the page. The parent is the
    element that was opened last one level up. All comes from window sums within a page, so pages are shuffled once.
    """
    tags = pages.select(id_col, F.posexplode(F.regexp_extract_all(html_col, F.lit(TAG), F.lit(1))).alias("pos", "tag"))
    name = F.lower(F.ltrim("tag", F.lit("/")))
    step = F.when(F.col("tag").startswith("/"), -1).when(name.isin(*VOID), 0).otherwise(1)
    tags = tags.select(id_col, "pos", name.alias("type"), step.alias("step"))
    tags = tags.where("not (step = -1 and type in ('%s'))" % "','".join(VOID))
    sofar = Window.partitionBy(id_col).orderBy("pos")
    tags = tags.withColumn("open", F.sum("step").over(sofar)).withColumn("pre", F.sum((F.col("step") >= 0).cast("int")).over(sofar))
    tags = tags.withColumn("depth", F.col("open") - F.greatest("step", F.lit(0)))
    level = Window.partitionBy(id_col, "depth").orderBy("pos")
    every = F.max("pre").over(Window.partitionBy(id_col))
    tags = tags.withColumn("last", F.when(F.col("step") == 0, F.col("pre")).otherwise(F.coalesce(F.lead("pre").over(level), every)))
    # an element stands at its own level, and those that are opened also one further down, for their children
    own = F.struct(F.col("depth").alias("level"), F.lit(None).cast("struct<pre:bigint,type:string>").alias("up"))
    below = F.struct((F.col("depth") + 1).alias("level"), F.struct("pre", "type").cast("struct<pre:bigint,type:string>").alias("up"))
    both = tags.where("step >= 0").withColumn("at", F.explode(F.when(F.col("step") == 1, F.array(own, below)).otherwise(F.array(own))))
    before = Window.partitionBy(id_col, "at.level").orderBy("pos")
    both = both.withColumn("up", F.last("at.up", ignorenulls=True).over(before)).where("at.up is null")
    whole = lambda c: F.col(c).cast("int")
    return both.select(id_col, whole("pre").alias("pre"), whole("last").alias("last"), whole("up.pre").alias("parent"), whole("depth").alias("depth"), "type", F.col("up.type").alias("parent_type"))


def line_nodes(docs: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """(keep, start_line, text) of every line, from 1; a null text has none."""
    lines = docs.select(*keep, F.posexplode(F.split(text_col, "\n", -1)).alias("n", "text"))
    return lines.select(*keep, (F.col("n") + 1).alias("start_line"), "text")


def units(nodes: DataFrame, id_col: str, kinds: tuple[str, ...], depth: int, least: int) -> DataFrame:
    """[C1] The elements of the given kinds at a depth that hold at least so many nodes."""
    size = F.col("last") - F.col("pre") + 1
    return nodes.where((F.col("depth") == depth) & F.col("type").isin(*kinds) & (size >= least)).select(id_col, "pre", "type", size.alias("nodes"))


def unit_shapes(nodes: DataFrame, units: DataFrame, id_col: str) -> DataFrame:
    """[C2] units with shape, the types of all elements in a unit in document order, and name, the type of its first
    heading or else its own. A node lies in the last unit that begins before it, as units of one depth never overlap."""
    of = nodes.join(units.select(id_col, "pre", F.col("nodes").alias("_size")), [id_col, "pre"], "left")
    start = F.last(F.when(F.col("_size").isNotNull(), F.struct("pre", "_size", "type")), ignorenulls=True).over(Window.partitionBy(id_col).orderBy("pre"))
    of = of.withColumn("_unit", start).where(F.col("pre") < F.col("_unit.pre") + F.col("_unit._size"))
    row = F.struct("pre", "type")
    per = of.groupBy(id_col, F.col("_unit.pre").alias("pre"), F.col("_unit.type").alias("type"), F.col("_unit._size").alias("nodes")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    heading = F.get(F.filter("rows", lambda r: r["type"].rlike("^h[1-6]$")), F.lit(0))["type"]
    return per.select(id_col, "pre", "type", "nodes", F.array_join(F.col("rows.type"), " ").alias("shape"), F.coalesce(heading, F.col("type")).alias("name"))
