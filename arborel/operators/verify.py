"""Self-verification: a rule must flag its bad example and leave its good one alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborel.operators.nodes import line_nodes
from arborel.operators.rules import Rule, violations


def verified(entries: DataFrame, id_col: str) -> DataFrame:
    """[S2, C10] (id, checked, ok) of entries (id, pattern, good_example, bad_example): a forbidden pattern found in the
    bad example and not in the good one. Entries without an example are not checked."""
    bad = F.nullif("bad_example", F.lit(""))
    good = F.nullif("good_example", F.lit(""))
    caught = F.coalesce(F.regexp_like(bad, F.col("pattern")), F.lit(True))
    silent = ~F.coalesce(F.regexp_like(good, F.col("pattern")), F.lit(False))
    checked = bad.isNotNull() | good.isNotNull()
    return entries.select(id_col, checked.alias("checked"), F.when(checked, caught & silent).alias("ok"))


def verified_rules(examples: DataFrame, rules: list[Rule], *, id_col: str, language_col: str, text_col: str, bad: Column) -> DataFrame:
    """[S2, C10] (id, rule_id, ok) of each example and each rule of any type that holds for its language: a bad example
    must be flagged, others must not. Examples without a text are not checked."""
    of = examples.where(F.coalesce(text_col, F.lit("")) != "").select(id_col, F.col(language_col).alias("lang"), F.col(text_col).alias("text"), bad.alias("_bad"))
    found = violations(of, line_nodes(of, "text", id_col, "lang"), rules, id_col, "lang", first=True).select(id_col, "rule_id").distinct()
    holds = (F.when(F.lit(r.language is None) | (F.col("lang") == (r.language or "")), F.lit(r.id)) for r in rules)
    pairs = of.select(id_col, "_bad", F.explode(F.array_compact(F.array(*holds))).alias("rule_id"))
    marked = pairs.join(found.withColumn("_flagged", F.lit(True)), [id_col, "rule_id"], "left")
    return marked.select(id_col, "rule_id", (F.coalesce("_flagged", F.lit(False)) == F.col("_bad")).alias("ok"))
