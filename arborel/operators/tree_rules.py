"""Rules on trees: patterns that must not, must, or must within a scope be there, names, and analyses by name."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborel.operators import analyzers
from arborel.operators.markup import DIALECTS
from arborel.operators.nodes import VOID
from arborel.operators.patterns import Either, Pattern, captures_of, matches, within
from arborel.operators.rules import SNIPPET

TYPES = ("forbid", "require", "require_in", "naming", "analysis")
#: The analyzers by name: each gives (id, pre, message, type, text) of what it finds in the nodes.
ANALYZERS: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "exclusive-members": analyzers.exclusive_members,
    "exclusive-flags": analyzers.exclusive_flags,
    "closed-domain": analyzers.closed_domains,
    "unchanged-values": analyzers.unchanged_values,
    "known-values": analyzers.known_values,
}
# Elements of both dialects, and those that only html has.
COMMON = "a abbr address area b base blockquote body br button caption cite code col colgroup dd del dfn div dl dt em fieldset form h1 h2 h3 h4 h5 h6 head hr html i iframe img input ins kbd label legend li link map meta noscript object ol optgroup option p param pre q s samp script select small span strong style sub sup table tbody td textarea tfoot th thead title tr u ul var".split()
HTML_ONLY = "article aside audio bdi canvas data datalist details dialog embed figcaption figure footer header main mark meter nav output picture progress rp rt ruby section source summary template time track video wbr".split()


@dataclass(frozen=True)
class TreeRule:
    """A rule on trees. forbid: no match; require: one at least in each tree; require_in: one at least within each match of
    scope, anywhere from it down; naming: the text of a capture's node, or an attribute of it, fits regex wholly; analysis:
    a named analyzer finds nothing. capture: where a violation stands; without it at the match's own node."""

    id: str
    type: str
    message: str
    pattern: Pattern | None = None
    scope: Pattern | None = None
    capture: str | None = None
    regex: str | None = None
    attribute: str | None = None
    analyzer: str | None = None
    severity: str = "error"
    dialects: tuple[str, ...] = DIALECTS

    def __post_init__(self):
        """[R7, R8]"""
        if self.type not in TYPES:
            raise ValueError(f"rule {self.id}: unknown type {self.type}")
        if self.type == "analysis" and self.analyzer not in ANALYZERS:
            raise ValueError(f"rule {self.id}: unknown analyzer {self.analyzer}")
        if self.type != "analysis" and self.pattern is None:
            raise ValueError(f"rule {self.id}: {self.type} needs a pattern")
        if self.type == "require_in" and self.scope is None:
            raise ValueError(f"rule {self.id}: require_in needs a scope")
        if self.type == "naming" and not (self.capture and self.regex):
            raise ValueError(f"rule {self.id}: naming needs a capture and a regex")
        place = self.scope if self.type == "require_in" else self.pattern
        if self.capture and self.type in ("forbid", "require_in", "naming") and self.capture not in captures_of(place):
            raise ValueError(f"rule {self.id}: no capture {self.capture}")
        if self.regex:
            re.compile(self.regex)


def catalogue(spark: SparkSession) -> DataFrame:
    """(dialect, type, holds): the elements of each dialect, and whether they can have children."""
    known = {"html": [*COMMON, *HTML_ONLY], "xhtml": COMMON}
    return spark.createDataFrame([(d, t, t not in VOID) for d, of in known.items() for t in of], "dialect string, type string, holds boolean")


def _needs(p: Pattern) -> set[tuple[str, bool]]:
    """(type, whether with children) of each type that a pattern cannot do without."""
    if isinstance(p, Either):
        return set.intersection(*map(_needs, p.of)) if p.of else set()
    own = {(t, bool(p.children)) for t in p.types} if len(p.types) == 1 else set()
    return own.union(*map(_needs, p.children))


def skipped(spark: SparkSession, rules: list[TreeRule], known: DataFrame | None = None) -> DataFrame:
    """[R10] (dialect, rule_id) of the rules whose pattern or scope asks for what a dialect does not have: a type, or
    children of an element without any. known: (dialect, type, holds), else the catalogue."""
    rows = [(d, r.id, *n) for r in rules for p in (r.pattern, r.scope) if p is not None for n in sorted(_needs(p)) for d in r.dialects]
    asked = spark.createDataFrame(rows, "dialect string, rule_id string, type string, children boolean")
    known = catalogue(spark) if known is None else known
    have = known.select(F.col("dialect").alias("_d"), F.col("type").alias("_t"), "holds")
    fits = (F.col("dialect") == F.col("_d")) & (F.col("type") == F.col("_t")) & (F.col("holds") | ~F.col("children"))
    return asked.join(have, fits, "left_anti").select("dialect", "rule_id").distinct()


def violations(nodes: DataFrame, pages: DataFrame, rules: list[TreeRule], id_col: str, known: DataFrame | None = None) -> DataFrame:
    """[R3-R7, R9, R10, R12] (id, rule_id, message, severity, pre, type, snippet). Nodes are those of markup_tree, pages are
    (id, dialect); rules hold for pages of their dialects, unless these cannot hold them. pre is 0 for what is missing in
    a whole tree. An analysis gets the nodes of all pages at once and reasons within each."""
    spark = nodes.sparkSession
    none = F.lit("")
    out = [pages.where("false").select(id_col, none.alias("rule_id"), none.alias("message"), none.alias("severity"), F.lit(0).alias("pre"), none.alias("type"), none.alias("snippet"))]
    text = lambda node: F.substring(node["text"], 1, SNIPPET).alias("snippet")
    for r in rules:
        own = [F.lit(r.id).alias("rule_id"), F.lit(r.message).alias("message"), F.lit(r.severity).alias("severity")]
        at = lambda node, own=own: [id_col, *own, node["pre"].alias("pre"), node["type"].alias("type"), text(node)]
        whole = nodes.select(id_col, "pre", F.struct("pre", "type", "text").alias("_node"))
        if r.type == "analysis":
            found = ANALYZERS[r.analyzer](nodes, id_col)
            said = F.concat(F.lit(f"{r.message}: "), F.col("message")).alias("message")
            out.append(found.select(id_col, own[0], said, own[2], "pre", "type", F.substring("text", 1, SNIPPET).alias("snippet")))
            continue
        found = matches(nodes, id_col, r.pattern)
        if r.type == "require":
            out.append(pages.join(found, id_col, "left_anti").select(id_col, *own, F.lit(0).alias("pre"), none.alias("type"), none.alias("snippet")))
            continue
        if r.type == "require_in":
            found = within(nodes, matches(nodes, id_col, r.scope), found, id_col)
        if r.type == "naming":
            node = F.col(r.capture)
            name = node["text"] if r.attribute is None else node["attrs"][r.attribute]
            wrong = found.where(name.isNotNull() & ~name.rlike(rf"\A(?:{r.regex})\z"))
            got = F.concat(F.lit(f"{r.message} (got '"), name, F.lit("')")).alias("message")
            out.append(wrong.select(id_col, own[0], got, own[2], node["pre"].alias("pre"), node["type"].alias("type"), F.substring(name, 1, SNIPPET).alias("snippet")))
        elif r.capture:
            out.append(found.select(*at(F.col(r.capture))))
        else:
            out.append(found.select(id_col, "pre").join(whole, [id_col, "pre"]).select(*at(F.col("_node"))))
    holds = [(d, r.id) for r in rules for d in r.dialects]
    holds = spark.createDataFrame(holds, "dialect string, rule_id string").join(skipped(spark, rules, known), ["dialect", "rule_id"], "left_anti")
    of = reduce(DataFrame.unionByName, out)
    # rules and dialects are few
    return of.join(pages.select(id_col, "dialect"), id_col).join(F.broadcast(holds), ["dialect", "rule_id"], "left_semi").select(id_col, "rule_id", "message", "severity", "pre", "type", "snippet")


def reports(pages: DataFrame, found: DataFrame, rules: list[TreeRule], id_col: str, known: DataFrame | None = None) -> DataFrame:
    """[R10, R11, R13, R14] (id, dialect, syntax_ok, passed, checked_rules, skipped_rules, violations) of each page (id,
    dialect, syntax_ok): a page passes if it is well-formed and nothing was found, whatever the severity; rules in their
    order, violations by node and rule."""
    spark = pages.sparkSession
    lost = {(r["dialect"], r["rule_id"]) for r in skipped(spark, rules, known).collect()}  # rules and dialects are few
    ids = lambda keep: F.coalesce(*(F.when(F.col("dialect") == d, F.array(*(F.lit(r.id) for r in rules if d in r.dialects and keep((d, r.id)))).cast("array<string>")) for d in DIALECTS), F.array().cast("array<string>"))
    row = F.struct("pre", "rule_id", "message", "severity", "type", "snippet")
    per = found.groupBy(id_col).agg(F.array_sort(F.collect_list(row)).alias("violations"))
    kind = dict(per.dtypes)["violations"]
    of = pages.select(id_col, "dialect", "syntax_ok").join(per, id_col, "left").withColumn("violations", F.coalesce("violations", F.array().cast(kind)))
    passed = F.col("syntax_ok") & (F.size("violations") == 0)
    return of.select(id_col, "dialect", "syntax_ok", passed.alias("passed"), ids(lambda x: x not in lost).alias("checked_rules"), ids(lambda x: x in lost).alias("skipped_rules"), "violations")
