"""Prompts as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def generate_prompt(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """[G6] (id, prompt): the text, and the violations in order with their snippets."""
    per = found.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start_line", "start_col", "rule_id", "message", "snippet"))).alias("found"))
    prompt = F.concat(F.lit("## Text\n"), F.coalesce(text_col, F.lit("")), F.lit("\n## Findings\n"), findings(F.col("found")))
    return docs.join(per, id_col, "left").select(id_col, prompt.alias("prompt"))


def findings(found: Column) -> Column:
    """[G6] A line for each violation of an array (start_line, rule_id, message, snippet), in its order."""
    snippet = lambda v: F.when(v["snippet"] != "", F.concat(F.lit(" -> `"), v["snippet"], F.lit("`"))).otherwise("")
    line = lambda v: F.concat(F.lit("- line "), v["start_line"].cast("string"), F.lit(": ["), v["rule_id"], F.lit("] "), v["message"], snippet(v))
    return F.coalesce(F.nullif(F.array_join(F.transform(found, line), "\n"), F.lit("")), F.lit("- none"))


def fenced(text: Column, language: Column) -> Column:
    return F.concat(F.lit("```"), F.coalesce(language, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("\n```"))


def conventions(hits: Column) -> Column:
    """[G6] What retrieval found, an array (kind, id, title, guideline, example, language, score) in order: rules, which
    are checked afterwards, and then patterns to imitate; null without any."""
    guideline = lambda h: F.when(h["guideline"] != "", F.concat(F.lit("\n  "), h["guideline"]))
    example = lambda h: F.when(h["example"] != "", F.concat(F.lit("\n"), fenced(h["example"], h["language"])))
    rule = lambda h: F.concat(F.lit("- "), h["id"], F.lit(": "), h["title"], F.coalesce(guideline(h), F.lit("")), F.coalesce(example(h), F.lit("")))
    pattern = lambda h: F.concat(F.lit("- "), h["title"], F.format_string(" (%.2f)", h["score"]), F.coalesce(example(h), F.lit("")))
    part = lambda kind, title, one: F.when(F.exists(hits, lambda h: h["kind"] == kind), F.concat(F.lit(f"## {title}\n"), F.array_join(F.transform(F.filter(hits, lambda h: h["kind"] == kind), one), "\n")))
    return F.nullif(F.concat_ws("\n", part("rule", "Rules", rule), part("pattern", "Patterns", pattern)), F.lit(""))


def generation(task: Column, language: Column, hits: Column, context: Column | None = None) -> Column:
    """[G6] Asks for new text: the task, what surrounds it, and the conventions."""
    around = F.lit(None).cast("string") if context is None else F.when(context != "", F.concat(F.lit("## Around it\n"), fenced(context, language)))
    return F.concat_ws("\n", F.lit("Write this text."), F.concat(F.lit("## Task\n"), task), around, conventions(hits), F.lit("Answer with one fenced block."))


def correction(task: Column, language: Column, text: Column, found: Column, hits: Column) -> Column:
    """[G6] Asks for another try: the task, the text, what was found in it, and the rules."""
    return F.concat_ws("\n", F.lit("This text fails its check; mend what was found and nothing else."), F.concat(F.lit("## Task\n"), task), F.concat(F.lit("## Text\n"), fenced(text, language)), F.concat(F.lit("## Findings\n"), findings(found)), conventions(F.filter(hits, lambda h: h["kind"] == "rule")), F.lit("Answer with one fenced block."))


def review(text: Column, language: Column, found: Column, hits: Column, wish: Column | None = None) -> Column:
    """[G6] Asks for a review: the text, the change that is wished for, what was found, and the conventions."""
    asked = F.lit(None).cast("string") if wish is None else F.when(wish != "", F.concat(F.lit("## Change\n"), wish))
    return F.concat_ws("\n", F.lit("Review this text; take the findings as given."), asked, F.concat(F.lit("## Text\n"), fenced(text, language)), F.concat(F.lit("## Findings\n"), findings(found)), conventions(hits), F.lit("Answer with a review and the mended text in one fenced block."))
