"""Rules over nodes: what must not match, must match, must match within a scope, and how captures must be named."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborel.functions.columns import let, running
from arborel.functions.languages import rule_languages
from arborel.functions.metadata import matches

TYPES = ("forbid", "require", "require_in", "naming")
#: Fixed value: characters of a violation's snippet.
SNIPPET = 200


@dataclass(frozen=True)
class Rule:
    """A rule on lines of text: pattern is searched in a line, naming patterns must fit its capture wholly."""

    id: str
    type: str
    pattern: str
    message: str
    language: str | None = None
    scope: str | None = None
    capture: str | None = None
    severity: str = "error"
    metadata: dict = field(default_factory=dict)
    overrides: tuple[str, ...] = ()

    def __post_init__(self):
        """[R8]"""
        if self.type not in TYPES:
            raise ValueError(f"rule {self.id}: unknown type {self.type}")
        if self.type == "require_in" and not self.scope:
            raise ValueError(f"rule {self.id}: require_in needs a scope")
        if self.type == "naming" and not self.capture:
            raise ValueError(f"rule {self.id}: naming needs a capture")
        for pattern in filter(None, (self.pattern, self.scope, self.capture)):
            try:
                re.compile(pattern)
            except re.error as e:
                raise ValueError(f"rule {self.id}: {pattern} is no pattern: {e}") from e
        if self.type == "naming":
            before_and_group(self.capture)


def before_and_group(capture: str) -> str:
    """[R6] capture with a group more, 1, around what stands before its own first group, so that the text it matches tells
    where the capture begins. The group must not be within another or an alternation, as it would not always be there."""
    at, depth, listed, escaped = None, 0, False, False
    for i, c in enumerate(capture):
        if escaped:
            escaped = False
            if c in "123456789":
                raise ValueError(f"{capture}: a capture can't refer back to its groups")
        elif c == "\\":
            escaped = True
        elif listed:
            listed = c != "]" or capture[i - 1] == "[" or capture[i - 2 : i] == "[^"
        elif c == "[":
            listed = True
        elif c == "(":
            if capture[i + 1 : i + 2] != "?" and at is None:
                if depth:
                    raise ValueError(f"{capture}: the captured group is within another")
                at = i
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and not depth:
            raise ValueError(f"{capture}: a capture can't be one of several alternatives")
    if at is None:
        raise ValueError(f"{capture}: a capture needs a group")
    flags = re.match(r"(?:\(\?[a-zA-Z]+\))*", capture).end()
    return f"{capture[:flags]}({capture[flags:at]}){capture[at:]}"


def applicable(rules: list[Rule], language: str | None = None, wanted: dict | None = None) -> list[Rule]:
    """[R15, R16] Rules of the language (or of every one) that the metadata does not rule out, without overridden ones."""
    found = [r for r in rules if language is None or r.language in (None, language)]
    for key, want in (wanted or {}).items():
        have = [r.metadata.get(key) for r in found]
        ok = [h is None or want is None or bool(set(h if isinstance(h, (list, tuple)) else [h]) & set(want if isinstance(want, (list, tuple)) else [want])) for h in have]
        found = [r for r, good in zip(found, ok, strict=True) if good]
    dropped = {o for r in found for o in r.overrides}
    return [r for r in found if r.id not in dropped]


def applicable_to(docs: DataFrame, rules: list[Rule], id_col: str, language: Column, meta: Column) -> DataFrame:
    """[R9, R15, R16] (id, rule_ids): the ids of the rules that hold for each row, in order; an override counts only
    where its own rule holds."""
    holds = {r.id: (F.lit(True) if r.language is None else F.coalesce(language == r.language, F.lit(False))) & matches(meta, r.metadata) for r in rules}
    kept = []
    for r in sorted(rules, key=lambda r: r.id):
        over = [holds[o.id] for o in rules if r.id in o.overrides]
        kept.append(F.when(reduce(lambda a, b: a & ~b, over, holds[r.id]), F.lit(r.id)))
    return docs.select(id_col, F.array_compact(F.array(*kept).cast("array<string>")).alias("rule_ids"))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(id, kind, language, title, meta, overrides) of rules as entries that a search can rank."""
    meta = lambda r: {k: [str(x) for x in (v if isinstance(v, (list, tuple)) else [v])] for k, v in r.metadata.items()}
    return spark.createDataFrame([(r.id, "rule", r.language, r.message, meta(r), list(r.overrides)) for r in rules], "id string, kind string, language string, title string, meta map<string,array<string>>, overrides array<string>")


def rules_from_hits(hits: DataFrame, entries: DataFrame, group_col: str, language: Column) -> DataFrame:
    """[R17] (group, id): the rules among the hits (group, id, further columns) of each group that hold for its language
    (a column of hits) or its base, without those that another hit of the language overrides. Spark broadcasts entries if
    they are few."""
    of = hits.withColumn("_language", language).join(entries.where("kind = 'rule'").withColumnRenamed("language", "_of"), "id")
    of = of.where(F.col("_of").isNull() | F.coalesce(F.array_contains(rule_languages(F.col("_language")), F.col("_of")), F.lit(False)))
    of = of.groupBy(group_col).agg(F.collect_set("id").alias("ids"), F.flatten(F.collect_list("overrides")).alias("over"))
    return of.select(group_col, F.explode(F.array_except("ids", "over")).alias("id"))


def chosen(rules: list[Rule], ids: list[str]) -> list[Rule]:
    """[R18] The rules of the given ids, whatever metadata and overrides say."""
    return [r for r in rules if r.id in set(ids)]


def _violation(r: Rule, line: Column, column: Column, message: Column, snippet: Column) -> Column:
    return F.struct(F.lit(r.id).alias("rule_id"), message.alias("message"), F.lit(r.severity).alias("severity"), line.cast("int").alias("start_line"), column.cast("int").alias("start_col"), F.substring(snippet, 1, SNIPPET).alias("snippet"))


def _matches(text: str, pattern: str, first: bool, before: bool = False) -> Column:
    """Array of (at, whole, got): every match of pattern in text (or the first), and the byte where it starts. With before
    the pattern has two groups: at is where the second starts, after what the first matches, and got is what it holds.
    Starts are sums of what split leaves between matches and the matches; they go by blocks, so many matches stay cheap."""
    found = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    seen = F.struct(found(0).alias("whole"), F.split(text, pattern, -1).alias("parts"), *((found(1).alias("lead"), found(2).alias("got")) if before else ()))

    def rows(x: Column) -> Column:
        # split leaves no piece before an empty match at the start
        gaps = F.when(F.size(x["parts"]) <= F.size(x["whole"]), F.concat(F.array(F.lit("")), x["parts"])).otherwise(x["parts"])
        lead = F.transform(x["lead"], lambda s: F.octet_length(s)) if before else F.transform(x["whole"], lambda _: F.lit(0))
        of = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(x["whole"])).alias("gap"), x["whole"].alias("whole"), x["got" if before else "whole"].alias("got"), lead.alias("lead"))
        return F.slice(of, 1, 1) if first else of

    size = lambda r: F.octet_length(r["gap"]) + F.octet_length(r["whole"])
    place = lambda r, start: F.struct((start + F.octet_length(r["gap"]) + r["lead"]).alias("at"), r["whole"].alias("whole"), r["got"].alias("got"))
    each = lambda of: F.when(F.size(of) > 0, F.zip_with(of, running(of, F.lit(0), size, lambda a, n: a + n), place))
    return let(seen, lambda x: let(rows(x), each))


def violations(docs: DataFrame, lines: DataFrame, rules: list[Rule], id_col: str, language_col: str, *, first: bool = False) -> DataFrame:
    """[R3-R6, R12] (id, rule_id, message, severity, start_line, start_col, snippet). Lines: (id, language, start_line,
    text). Columns are bytes from 0. Every match of a forbid rule and every capture of a naming rule counts, with first
    only the first of each line.

    All forbid and naming rules share one pass over the lines, which gives an array of violations for each line; all
    require rules one sum for each document; all scoped rules one window, in which a scope runs from its line to the line
    before the next and must hold a match. So the lines are read three times at most, however many rules there are; without
    rules nothing is found."""
    out = []
    fits = lambda r: F.lit(True) if r.language is None else F.coalesce(F.col(language_col) == r.language, F.lit(False))
    kinds = {t: [r for r in rules if r.type == t] for t in TYPES}
    text, line = F.col("text"), F.col("start_line")

    def forbidden(r: Rule) -> Column:
        hits = F.transform(_matches("text", r.pattern, first), lambda hit: _violation(r, line, hit["at"], F.lit(r.message), text))
        return F.when(fits(r) & text.rlike(r.pattern), hits)

    def misnamed(r: Rule) -> Column:
        def one(hit: Column) -> Column:
            return _violation(r, line, hit["at"], F.concat(F.lit(f"{r.message} (got '"), hit["got"], F.lit("')")), hit["got"])

        wrong = F.filter(_matches("text", before_and_group(r.capture), first, before=True), lambda hit: ~hit["got"].rlike(rf"\A(?:{r.pattern})\z"))
        return F.when(fits(r) & text.rlike(r.capture), F.transform(wrong, one))

    each = [*map(forbidden, kinds["forbid"]), *map(misnamed, kinds["naming"])]
    if each:
        out.append(lines.select(id_col, F.explode(F.flatten(F.array_compact(F.array(*each)))).alias("v")))
    if kinds["require"]:
        met = lines.groupBy(id_col).agg(*(F.max(text.rlike(r.pattern)).alias(f"_met{i}") for i, r in enumerate(kinds["require"])))
        of = docs.select(id_col, language_col).join(met, id_col, "left")
        missing = (F.when(fits(r) & ~F.coalesce(f"_met{i}", F.lit(False)), _violation(r, F.lit(1), F.lit(0), F.lit(r.message), F.lit(""))) for i, r in enumerate(kinds["require"]))
        out.append(of.select(id_col, F.explode(F.array_compact(F.array(*missing))).alias("v")))
    if kinds["require_in"]:
        at = (F.when(fits(r), F.struct(F.lit(i).alias("i"), text.rlike(r.scope).cast("int").alias("opens"), text.rlike(r.pattern).alias("met"))) for i, r in enumerate(kinds["require_in"]))
        of = lines.select(id_col, "start_line", "text", F.explode(F.array_compact(F.array(*at))).alias("r"))
        of = of.withColumn("_scope", F.sum("r.opens").over(Window.partitionBy(id_col, "r.i").orderBy("start_line"))).where("_scope > 0")
        per = of.groupBy(id_col, F.col("r.i").alias("i"), "_scope").agg(F.max("r.met").alias("met"), F.min_by("text", "start_line").alias("text"), F.min("start_line").alias("start_line")).where("not met")
        found = [_violation(r, line, F.lit(0), F.lit(r.message), text) for r in kinds["require_in"]]
        out.append(per.select(id_col, F.get(F.array(*found), F.col("i")).alias("v")))
    if not out:
        none = _violation(Rule("", "forbid", "", ""), F.lit(0), F.lit(0), F.lit(""), F.lit(""))
        out.append(docs.where(F.lit(False)).select(id_col, none.alias("v")))
    return reduce(DataFrame.unionByName, out).select(id_col, "v.*")


def report(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """[R11, R13, R14] (id, passed, n_violations, rule_ids, first_line): any violation fails, whatever its severity."""
    per = found.groupBy(id_col).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("rule_id")).alias("rules"), F.min("start_line").alias("first_line"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    ids = F.coalesce(F.array_join("rules", ","), F.lit(""))
    return docs.select(id_col).join(per, id_col, "left").select(id_col, (n == 0).alias("passed"), n.alias("n_violations"), ids.alias("rule_ids"), "first_line")


def reports(docs: DataFrame, found: DataFrame, rules: list[Rule], id_col: str, language_col: str) -> DataFrame:
    """[R9, R11, R14] (id, language, passed, checked_rules, violations): each document's report in one row, the rules of
    its language in their order and its violations by line, column and rule."""
    row = F.struct("start_line", "start_col", "rule_id", "message", "severity", "snippet")
    per = found.groupBy(id_col).agg(F.array_sort(F.collect_list(row)).alias("violations"))
    checked = F.array_compact(F.array(*(F.when(F.lit(True) if r.language is None else F.col(language_col) == r.language, F.lit(r.id)) for r in rules)).cast("array<string>"))
    kind = dict(per.dtypes)["violations"]
    of = docs.select(id_col, language_col).join(per, id_col, "left").withColumn("violations", F.coalesce("violations", F.array().cast(kind)))
    return of.select(id_col, F.col(language_col).alias("language"), (F.size("violations") == 0).alias("passed"), checked.alias("checked_rules"), "violations")


def inside(nodes: DataFrame, id_col: str, scope: str, inner: str) -> DataFrame:
    """[R5] (id, pre) of the scope nodes without an inner node anywhere below: the next inner node of the tree, which a
    window finds, lies beyond their interval."""
    after = Window.partitionBy(id_col).orderBy("pre").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    following = F.min(F.when(F.col("type") == inner, F.col("pre"))).over(after)
    of = nodes.where(F.col("type").isin(scope, inner)).withColumn("_next", following)
    return of.where((F.col("type") == scope) & F.coalesce(F.col("_next") > F.col("last"), F.lit(True))).select(id_col, "pre")


def duplicate_sets(nodes: DataFrame, id_col: str) -> DataFrame:
    """[A5] (id, members, first, n, occurrences): sets of child types that two parents at least of one tree have, by the
    set, with the parents in document order."""
    sets = nodes.where("parent is not null").groupBy(id_col, "parent").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("members"), F.count("*").alias("size")).where("size >= 2")
    per = sets.groupBy(id_col, "members").agg(F.array_sort(F.collect_list("parent")).alias("of")).where(F.size("of") >= 2)
    return per.select(id_col, "members", F.col("of")[0].alias("first"), F.size("of").cast("long").alias("n"), F.array_join("of", ",").alias("occurrences"))
