"""Patterns over trees, matched by joins of the node relation with itself.

A pattern is a node of some types with conditions on it and patterns of its children. Each child is an equi-join on the
tree and the parent's number; what must not be there is an anti-join; alternatives are a union. So a pattern of n nodes is
n - 1 joins in one plan, which Spark orders and deals out, and there is no pass over a tree in Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a node of a match is made of.
NODE = ("pre", "last", "type", "attrs", "text")


@dataclass(frozen=True)
class Condition:
    """A condition on a node's text, or on an attribute: eq, any_of, match (a search), their opposites, or has."""

    kind: str
    value: object = None
    attribute: str | None = None

    def __post_init__(self):
        if self.kind not in ("eq", "not_eq", "any_of", "not_any_of", "match", "not_match", "has", "has_not"):
            raise ValueError(f"unknown condition {self.kind}")
        if self.kind.endswith("match"):
            re.compile(self.value)
        if self.kind.startswith("has") and not self.attribute:
            raise ValueError(f"{self.kind} needs an attribute")

    def column(self) -> Column:
        of = F.col("text") if self.attribute is None else F.col("attrs")[self.attribute]
        if self.kind in ("has", "has_not"):
            return of.isNotNull() if self.kind == "has" else of.isNull()
        kind = self.kind.removeprefix("not_")
        holds = of == self.value if kind == "eq" else of.isin(*self.value) if kind == "any_of" else of.rlike(self.value)
        # of an attribute that is not there nothing holds, nor does its opposite
        return F.coalesce(holds if kind == self.kind else ~holds, F.lit(False))


@dataclass(frozen=True)
class Node:
    """types: any if empty. children: in this order among the node's children, others may stand between; anchored ones
    follow the one before at once, or are the first child. without: patterns that no child fits. capture: a name."""

    types: tuple[str, ...] = ()
    children: tuple[Node | Either, ...] = ()
    tests: tuple[Condition, ...] = ()
    without: tuple[Node | Either, ...] = ()
    capture: str | None = None
    anchored: bool = False


@dataclass(frozen=True)
class Either:
    """One of several patterns."""

    of: tuple[Node, ...]
    anchored: bool = False


Pattern = Node | Either


def types_of(pattern: Pattern) -> set[str]:
    """All types that a pattern names."""
    if isinstance(pattern, Either):
        return set().union(*map(types_of, pattern.of))
    return set(pattern.types).union(*map(types_of, (*pattern.children, *pattern.without)))


def captures_of(pattern: Pattern) -> list[str]:
    """The names of its captures, in order."""
    if isinstance(pattern, Either):
        names = [n for p in pattern.of for n in captures_of(p)]
    else:
        names = [*([pattern.capture] if pattern.capture else []), *(n for p in pattern.children for n in captures_of(p))]
    return list(dict.fromkeys(names))


def matches(nodes: DataFrame, id_col: str, pattern: Pattern) -> DataFrame:
    """[R1, R2] (id, pre, last and a column for each capture) of every match: pre and last are those of the pattern's own
    node, a capture is a struct of its node, null where an alternative without it fits. Each way to choose children is a
    match. Nodes: (id, pre, last, parent, ord, type, attrs, text)."""
    names = captures_of(pattern)
    if len({*names, id_col, "pre", "last"}) < len(names) + 3:
        raise ValueError("a capture has the name of a column")
    return _matched(nodes, id_col, pattern, count()).select(id_col, "pre", "last", *names)


def _matched(nodes: DataFrame, id_col: str, p: Pattern, numbers: count) -> DataFrame:
    """Matches with parent and ord of their node."""
    names = captures_of(p)
    if isinstance(p, Either):
        parts = [_matched(nodes, id_col, q, numbers) for q in p.of]
        empty = F.lit(None).cast("struct<pre:int,last:int,type:string,attrs:map<string,string>,text:string>")
        return reduce(DataFrame.unionByName, [d.select(id_col, "pre", "last", "parent", "ord", *(F.col(n) if n in d.columns else empty.alias(n) for n in names)) for d in parts])
    of = nodes.where(reduce(lambda a, b: a & b, (t.column() for t in p.tests), F.col("type").isin(*p.types) if p.types else F.lit(True)))
    own = [F.struct(*NODE).alias(p.capture)] if p.capture else []
    of = of.select(id_col, "pre", "last", "parent", "ord", *own)
    for q in p.without:
        bad = _matched(nodes, id_col, q, numbers).where(F.col("ord") == 0 if q.anchored else F.lit(True)).select(F.col(id_col).alias("_id"), F.col("parent").alias("_up"))
        of = of.join(bad, (F.col(id_col) == F.col("_id")) & (F.col("pre") == F.col("_up")), "left_anti")
    before = None
    for q in p.children:
        n = next(numbers)
        child = _matched(nodes, id_col, q, numbers)
        child = child.where(F.col("parent").isNotNull()).select(F.col(id_col).alias("_id"), F.col("parent").alias("_up"), F.col("ord").alias(f"_at{n}"), *captures_of(q))
        place = F.lit(True)
        if q.anchored:
            place = F.col(f"_at{n}") == (F.lit(0) if before is None else F.col(before) + 1)
        elif before is not None:
            place = F.col(f"_at{n}") > F.col(before)
        of = of.join(child, (F.col(id_col) == F.col("_id")) & (F.col("pre") == F.col("_up")) & place).drop("_id", "_up")
        before = f"_at{n}"
    return of.select(id_col, "pre", "last", "parent", "ord", *names)


def within(nodes: DataFrame, scopes: DataFrame, inner: DataFrame, id_col: str) -> DataFrame:
    """[R5] The scopes (id, pre, last, further columns) without an inner (id, pre) from pre to last: the next inner one of
    the tree lies beyond them, which a window finds."""
    rows = scopes.select(id_col, "pre", F.struct(*scopes.columns).alias("scope")).unionByName(inner.select(id_col, "pre").distinct(), allowMissingColumns=True)
    after = Window.partitionBy(id_col).orderBy("pre").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    found = rows.withColumn("_next", F.min(F.when(F.col("scope").isNull(), F.col("pre"))).over(after)).where("scope is not null")
    return found.where(F.coalesce(F.col("_next") > F.col("scope.last"), F.lit(True))).select("scope.*")
