"""Analyses of a tree by what is used where: sums over elements, attributes and values within each tree.

Nodes are those of markup_tree. An element's attributes are its members; its type is what declares them. What proves
nothing gives no finding. Each analyzer gives (id, pre, message, type, text), at the first element of the type that it is about, or at
the element. It reads the nodes once and groups them within trees only, so nodes that are dealt by tree stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A value that is written out, and not put together elsewhere.
LITERAL = r"^[^{}$]*\z"


def _attrs() -> Column:
    return F.coalesce("attrs", F.create_map().cast("map<string,string>"))


def _types(nodes: DataFrame, id_col: str, **sums: Column) -> DataFrame:
    """(id, type, pre, text, sums) of each type of element: where its first one stands, and sums over its elements."""
    per = nodes.groupBy(id_col, "type").agg(F.min(F.struct("pre", "text")).alias("_first"), *(c.alias(k) for k, c in sums.items()))
    return per.select(id_col, "type", "_first.pre", "_first.text", *sums)


def _every(sets: Column) -> Column:
    """What all of the sets have in common."""
    return F.aggregate(sets, F.get(sets, F.lit(0)), F.array_intersect)


def _listed(names: Column, sep: str = ", ") -> Column:
    return F.array_join(F.sort_array(names), sep)


def _said(found: DataFrame, id_col: str, message: Column) -> DataFrame:
    return found.select(id_col, "pre", message.alias("message"), "type", "text")


def exclusive_members(nodes: DataFrame, id_col: str) -> DataFrame:
    """[A1] Types of element with two optional attributes at least (some of their elements have them, some don't) that come in
    groups which never meet: two distinct sets of them are used at least, and no attribute is in two of them."""
    per = _types(nodes, id_col, all=F.collect_set(F.sort_array(F.map_keys(_attrs()))))
    # types whose elements all have the same attributes have no optional ones
    per = per.where(F.size("all") >= 2)
    # optional is what not all elements have
    per = per.withColumn("every", _every(F.col("all"))).withColumn("of", F.array_distinct(F.filter(F.transform("all", lambda s: F.array_except(s, "every")), lambda s: F.size(s) > 0)))
    # the sets are disjoint if each name is in one of them
    names = F.flatten("of")
    found = per.where((F.size("of") >= 2) & (F.size(names) == F.size(F.array_distinct(names))))
    groups = F.array_join(F.transform(F.array_sort("of"), lambda s: F.concat(F.lit("{"), F.array_join(s, ", "), F.lit("}"))), " / ")
    return _said(found, id_col, F.concat("type", F.lit(" is used with "), groups))


def exclusive_flags(nodes: DataFrame, id_col: str) -> DataFrame:
    """[A3] Types of element with two flags at least (attributes that are true or false somewhere) of which two are each
    set alone somewhere and never two at once. A flag with any other value proves nothing."""
    names = lambda keep: F.sort_array(F.map_keys(F.map_filter(_attrs(), lambda _, v: keep(v))))
    flag = lambda v: v.isin("true", "false")
    per = _types(nodes, id_col, set=F.collect_set(names(lambda v: v == "true")), flags=F.collect_set(names(flag)), others=F.collect_set(names(lambda v: ~flag(v))))
    per = per.withColumn("flags", F.array_distinct(F.flatten("flags"))).withColumn("open", F.arrays_overlap(F.flatten("others"), "flags"))
    alone = F.array_distinct(F.flatten("set"))
    found = per.where((F.size("flags") >= 2) & ~F.col("open") & F.forall("set", lambda s: F.size(s) <= 1) & (F.size(alone) >= 2))
    return _said(found, id_col, F.concat("type", F.lit(" is never set to two of "), _listed(alone)))


def closed_domains(nodes: DataFrame, id_col: str) -> DataFrame:
    """[A4] Attributes that all elements of a type have, two elements at least, with a value written out, of two distinct ones
    at least. An attribute of that name on another type of element shows that others use it too: no finding.

    A name and its value are one text: texts are told apart by hashes, structs only by comparing each with each."""
    name, value = lambda p: F.substring_index(p, "=", 1), lambda p: F.substring(p, F.instr(p, "=") + 1, F.length(p))
    # a name holds no =; a value that is null is not written out
    pairs = F.transform(F.map_entries(_attrs()), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("{"))))
    per = _types(nodes, id_col, all=F.collect_list(pairs), n=F.count("*"))
    per = per.withColumn("pairs", F.array_distinct(F.flatten("all"))).withColumn("names", F.transform("pairs", name))
    # the names of each type, side by side: one that is there twice is shared
    used = F.flatten(F.collect_list(F.array_distinct("names")).over(Window.partitionBy(id_col)))
    per = per.withColumn("used", used).where("n >= 2").withColumn("every", _every(F.transform("all", lambda e: F.transform(e, name))))
    # of the names that all have those with several values, which no other type has
    several = F.filter("every", lambda x: (F.size(F.array_remove("names", x)) <= F.size("names") - 2) & (F.size(F.array_remove("used", x)) == F.size("used") - 1))
    values = lambda x: F.sort_array(F.transform(F.filter("pairs", lambda p: p.startswith(F.concat(x, F.lit("=")))), value))
    said = F.filter(F.transform(several, lambda x: F.struct(x.alias("name"), values(x).alias("values"))), lambda d: F.forall(d["values"], lambda v: v.rlike(LITERAL)))
    # told apart before they become rows; outer, as Spark asks first whether other explodes have rows, and works it all out twice
    found = per.select(id_col, "type", "pre", "text", F.explode_outer(said).alias("_d")).where("_d is not null").select("*", "_d.*")
    return _said(found, id_col, F.concat("type", F.lit("."), "name", F.lit(" is one of "), F.array_join("values", " | ")))


def unchanged_values(nodes: DataFrame, id_col: str) -> DataFrame:
    """[A6] Elements with an id and a value that no other element changes: none sets the id again, and none of type set or
    unset names it, wherever in the tree."""
    a, row = lambda c: F.col("attrs")[c], F.struct("pre", "type", "text", F.col("attrs")["value"].alias("value"))
    own = F.when(a("id").isNotNull(), F.struct(a("id").alias("name"), row.alias("own")))
    changed = F.when(F.col("type").isin("set", "unset") & a("ref").isNotNull(), F.struct(a("ref").alias("name"), F.lit(None).cast("struct<pre:int,type:string,text:string,value:string>").alias("own")))
    of = nodes.select(id_col, F.explode(F.array_compact(F.array(own, changed))).alias("x")).select(id_col, "x.name", "x.own")
    # a name that one element has and none changes
    per = of.groupBy(id_col, "name").agg(F.count("*").alias("n"), F.max("own").alias("own")).where("n = 1 and own is not null").select(id_col, "name", "own.*")
    return _said(per.where(F.col("value").rlike(LITERAL)), id_col, F.concat("name", F.lit(" is always "), "value"))


def known_values(nodes: DataFrame, id_col: str) -> DataFrame:
    """[A7] Values written out where a name is known for them, by a chain of three references: a list (type list, with id)
    holds items with a name and a value, of which the first of a value counts; a kind (type kind, with id) is of a list;
    an element with an attribute kind is of that kind, and its attribute value should be the item's name. A kind that is
    defined twice with different lists, and a list that is, prove nothing.

    Each reference is a window over what has the key and what refers to it, within a tree."""
    a = lambda c: F.col("attrs")[c]
    role = F.when((F.col("type") == "list") & a("id").isNotNull(), "list")
    role = role.when((F.col("type") == "item") & a("name").isNotNull() & a("value").isNotNull(), "item")
    role = role.when((F.col("type") == "kind") & a("id").isNotNull() & a("of").isNotNull(), "kind")
    role = role.when(~F.col("type").isin("list", "item", "kind") & a("kind").isNotNull() & a("value").isNotNull(), "use")
    of = nodes.select(id_col, "pre", "type", "text", "parent", role.alias("role"), a("id").alias("own"), a("name").alias("name"), a("value").alias("value"), a("of").alias("of"), a("kind").alias("by")).where("role is not null")
    is_ = lambda r, c: F.when(F.col("role") == r, F.col(c))
    over = lambda *keys: Window.partitionBy(id_col, *keys)
    of = of.withColumn("kind", F.coalesce(is_("kind", "own"), is_("use", "by")))
    low, high = (f(is_("kind", "of")).over(over("kind")) for f in (F.min, F.max))
    of = of.withColumn("list", F.coalesce(is_("list", "own"), F.when((F.col("role") == "use") & (low == high), low)))
    lists, at = F.count(is_("list", "pre")).over(over("list")), F.min(is_("list", "pre")).over(over("list"))
    of = of.withColumn("list_pre", F.coalesce(is_("item", "parent"), F.when((F.col("role") == "use") & F.col("list").isNotNull() & (lists == 1), at)))
    first = F.min_by(is_("item", "name"), is_("item", "pre")).over(over("list_pre", "value"))
    of = of.where("role in ('item', 'use') and list_pre is not null").withColumn("name", first)
    return _said(of.where("role = 'use' and name is not null"), id_col, F.concat("value", F.lit(" is "), "list", F.lit("."), "name"))
