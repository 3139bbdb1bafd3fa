"""Markup as trees with what patterns and rules ask of them: order among siblings, attributes, text, and what is wrong.

Two dialects differ in how elements end: in html some never have an end (VOID) and a slash at a tag's end means nothing; in
xhtml every element has an end, by a tag of its own or by that slash. A page is well-formed under a dialect if each end
tag closes the element of its name that was opened last, and nothing stays open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborel.functions.columns import let
from arborel.operators.nodes import VOID

NAME = "</?[a-zA-Z][a-zA-Z0-9]*"
TAG = f"{NAME}[^>]*>[^<]*"
ATTRIBUTE = r"([a-zA-Z_:][a-zA-Z0-9_:.\-]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
DIALECTS = ("html", "xhtml")
#: Characters of markup that a task of by_page gets, about.
PART_CHARS = 8_000_000


def attributes(text: Column) -> Column:
    """map<string, string> of a tag's attributes with a value; of several of one name the first counts."""
    of = lambda group: F.regexp_extract_all(text, F.lit(ATTRIBUTE), F.lit(group))
    bare = lambda v: F.when(v.startswith('"') | v.startswith("'"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    both = F.struct(F.transform(of(1), F.lower).alias("k"), F.transform(of(2), bare).alias("v"))

    def first(x: Column) -> Column:
        pairs = F.filter(F.arrays_zip(x["k"].alias("k"), x["v"].alias("v")), lambda p, i: F.array_position(x["k"], p["k"]) == i + 1)
        return F.when(F.size(F.array_distinct(x["k"])) == F.size(x["k"]), F.map_from_arrays(x["k"], x["v"])).otherwise(F.map_from_entries(pairs))

    return let(both, first)


def by_page(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """pages dealt by their ids, about PART_CHARS of markup a task, so that a task's nodes fit its memory, however many
    pages there are, and all that is done within pages needs no further shuffle."""
    size = pages.agg(F.sum(F.length(html_col))).first()[0] or 0
    return pages.repartition(max(pages.sparkSession.sparkContext.defaultParallelism, -(-size // PART_CHARS)), id_col)


def _tag() -> tuple[Column, Column, Column]:
    """Name, whether it ends an element, and what follows the name, of a tag with its text in _tag."""
    name = F.regexp_extract("_tag", f"^{NAME}", 0)
    rest = F.substring("_tag", F.length(name) + 1, F.instr("_tag", ">") - F.length(name) - 1)
    return F.lower(F.ltrim(name, F.lit("</"))), F.col("_tag").startswith("</"), rest


def _tags(pages: DataFrame, id_col: str, html_col: str, dialect: Column) -> DataFrame:
    """tags with rest, what a tag holds beside its name, in place of attrs."""
    found = pages.select(id_col, dialect.alias("dialect"), F.posexplode(F.regexp_extract_all(html_col, F.lit(TAG), F.lit(0))).alias("pos", "_tag"))
    name, ends, rest = _tag()
    found = found.select(id_col, "dialect", "pos", name.alias("type"), ends.alias("ends"), rest.alias("rest"), F.substring("_tag", F.instr("_tag", ">") + 1, F.length("_tag")).alias("text"))
    void = (F.col("dialect") == "html") & F.col("type").isin(*VOID)
    alone = void | ((F.col("dialect") == "xhtml") & F.col("rest").endswith("/"))
    step = F.when(F.col("ends"), -1).when(alone, 0).otherwise(1)
    return found.where(~(void & F.col("ends"))).select(id_col, "dialect", "pos", "type", step.alias("step"), "rest", "text")


def tags(pages: DataFrame, id_col: str, html_col: str, dialect: Column) -> DataFrame:
    """(id, dialect, pos, type, step, attrs, text) of every tag that opens an element (step 1), closes one (-1) or is one
    alone (0), in the page's dialect; text is what stands between it and the next sign <."""
    return _tags(pages, id_col, html_col, dialect).select(id_col, "dialect", "pos", "type", "step", attributes(F.col("rest")).alias("attrs"), "text")


def _levels(found: DataFrame, id_col: str) -> DataFrame:
    """tags with level, how many elements are open around it: a tag that opens an element and the one that closes it are
    neighbours among those of their level that open or close."""
    opened = F.sum("step").over(Window.partitionBy(id_col).orderBy("pos"))
    return found.withColumn("level", opened - F.greatest("step", F.lit(0)))


def syntax_errors(found: DataFrame, id_col: str) -> DataFrame:
    """[P5] (id, pos, type, error) of tags (see tags): ends without a beginning of their name, and elements left open."""
    level = Window.partitionBy(id_col, "level").orderBy("pos")
    of = _levels(found.drop("attrs", "text").where("step <> 0"), id_col)
    pair = F.struct("type", "step")
    of = of.withColumn("before", F.lag(pair).over(level)).withColumn("after", F.lead(pair).over(level))
    fits = lambda other, step: F.coalesce((F.col(f"{other}.type") == F.col("type")) & (F.col(f"{other}.step") == step), F.lit(False))
    error = F.when((F.col("step") == -1) & ~fits("before", 1), "ends nothing").when((F.col("step") == 1) & ~fits("after", -1), "has no end")
    return of.withColumn("error", error).where("error is not null").select(id_col, "pos", "type", "error")


def dialect_of(pages: DataFrame, id_col: str, html_col: str, declared: Column | None = None) -> DataFrame:
    """[P5, P7] (id, dialect, syntax_ok, errors) of each page: pages with errors under html are read again as xhtml, which
    they are if that has none. declared: the dialect a page says it has, html if null or not known.

    Both readings share one pass: a tag has a step for each, and a page without tags one row without a step."""
    first = F.when(declared.isin(*DIALECTS), declared).otherwise("html") if declared is not None else F.lit("html")
    of = pages.select(id_col, first.alias("_declared"), F.posexplode_outer(F.regexp_extract_all(html_col, F.lit(TAG), F.lit(0))).alias("pos", "_tag"))
    name, ends, rest = _tag()
    # elements without an end, and ends of such, are neither opened nor closed
    step = {"html": F.when(name.isin(*VOID), None), "xhtml": F.when(~ends & rest.endswith("/"), None)}
    of = of.select(id_col, "_declared", "pos", name.alias("type"), *(s.when(ends, -1).when(~ends, 1).alias(d) for d, s in step.items()))
    sofar = Window.partitionBy(id_col).orderBy("pos")
    for d in DIALECTS:
        of = of.withColumn("_level", F.when(F.col(d).isNotNull(), F.sum(d).over(sofar) - F.greatest(d, F.lit(0))))
        level = Window.partitionBy(id_col, "_level").orderBy("pos")
        pair = F.struct("type", F.col(d).alias("step"))
        fits = lambda other, step: F.coalesce((other["type"] == F.col("type")) & (other["step"] == step), F.lit(False))  # noqa: B023, E731
        wrong = ((F.col(d) == -1) & ~fits(F.lag(pair).over(level), 1)) | ((F.col(d) == 1) & ~fits(F.lead(pair).over(level), -1))
        of = of.withColumn(f"_{d}", F.coalesce(wrong, F.lit(False))).drop("_level")
    n = of.groupBy(id_col).agg(F.first("_declared").alias("_declared"), *(F.count_if(f"_{d}").alias(f"_{d}") for d in DIALECTS))
    better = (F.col("_declared") == "html") & (F.col("_html") > 0) & (F.col("_xhtml") == 0)
    errors = F.when(better, 0).when(F.col("_declared") == "html", F.col("_html")).otherwise(F.col("_xhtml")).cast("long")
    return n.select(id_col, F.when(better, "xhtml").otherwise(F.col("_declared")).alias("dialect"), (errors == 0).alias("syntax_ok"), errors.alias("errors"))


def markup_tree(pages: DataFrame, id_col: str, html_col: str, dialect: Column | None = None) -> DataFrame:
    """[P4] (id, pre, last, parent, ord, depth, type, attrs, text) of every element in document order. ord counts the
    children of a parent from 0, text is what follows the opening tag, parent is null at the top. Pages with errors have a
    tree too: an element ends where the count of open ones falls back to what it was before it, or with the page."""
    # attributes are told apart at the end, as a map is larger than its text
    found = _levels(_tags(pages, id_col, html_col, F.lit("html") if dialect is None else dialect), id_col)
    sofar, level = Window.partitionBy(id_col).orderBy("pos"), Window.partitionBy(id_col, "level").orderBy("pos")
    found = found.withColumn("pre", F.sum((F.col("step") >= 0).cast("int")).over(sofar))
    every = F.max("pre").over(Window.partitionBy(id_col))
    # the next tag of the level is the end of an element, or what follows an element without one
    found = found.withColumn("last", F.when(F.col("step") == 0, F.col("pre")).otherwise(F.coalesce(F.lead("pre").over(level), every)))
    # an element stands at its own level, and those that are opened also one further down, for their children
    own = F.struct(F.col("level").alias("at"), F.lit(None).cast("bigint").alias("up"))
    below = F.struct((F.col("level") + 1).alias("at"), F.col("pre").alias("up"))
    both = found.where("step >= 0").withColumn("place", F.explode(F.when(F.col("step") == 1, F.array(own, below)).otherwise(F.array(own))))
    before = Window.partitionBy(id_col, "place.at").orderBy("pos")
    both = both.withColumn("parent", F.last("place.up", ignorenulls=True).over(before)).where("place.up is null")
    siblings = Window.partitionBy(id_col, "parent").orderBy("pos")
    whole = lambda c: F.col(c).cast("int")
    return both.select(id_col, whole("pre").alias("pre"), whole("last").alias("last"), whole("parent").alias("parent"), (F.row_number().over(siblings) - 1).alias("ord"), whole("level").alias("depth"), "type", attributes(F.col("rest")).alias("attrs"), "text")
