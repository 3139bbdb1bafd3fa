"""Generate, check and repair, a whole batch of texts in each round."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborel.functions.text import extract_code_block
from arborel.jobs.prompts import generate_prompt, review
from arborel.sources.tables import written

#: (id, text, prompt) -> (id, reply): the text generator of a round, given all rows that still fail.
Provider = Callable[[DataFrame], DataFrame]
#: (id, text and further columns) -> violations.
Check = Callable[[DataFrame], DataFrame]


def repair(docs: DataFrame, id_col: str, text_col: str, check: Check, provider: Provider, rounds: int = 3) -> DataFrame:
    """[G2, G4] (id, text, iterations, verified): the first part of traced_repair."""
    return traced_repair(docs, id_col, text_col, check, provider, rounds)[0]


def traced_repair(docs: DataFrame, id_col: str, text_col: str, check: Check, provider: Provider, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """[G2, G4, G5] (id, text, iterations, verified) and the trace (id, seq, stage, message). Rows that fail go to the
    provider with what was found, at most rounds times; those that pass are done. A reply without a code block ends a row
    unverified, and its turn counts. Each round is written, so a lost executor repeats one round only."""
    todo = docs.withColumn("iterations", F.lit(0))
    done, trace = [], []
    event = lambda df, seq, stage, message: trace.append(df.select(id_col, F.lit(seq).alias("seq"), F.lit(stage).alias("stage"), message.alias("message")))
    for turn in range(rounds + 1):
        found = written(check(todo))
        failing = written(found.groupBy(id_col).agg(F.count("*").alias("_n")))
        verdict = F.when(F.col("_n").isNull(), "passed").otherwise(F.concat(F.col("_n").cast("string"), F.lit(" found")))
        event(todo.join(failing, id_col, "left"), 2 * turn, f"verify#{turn}", verdict)
        done.append(todo.join(failing, id_col, "left_anti").withColumn("verified", F.lit(True)))
        failed = todo.join(failing, id_col, "left_semi")
        if turn == rounds:
            done.append(failed.withColumn("verified", F.lit(False)))
            break
        prompts = generate_prompt(failed, found, id_col, text_col)
        replies = provider(failed.select(id_col, text_col).join(prompts, id_col)).select(id_col, extract_code_block(F.col("reply")).alias("_code"))
        answered = written(failed.join(replies, id_col, "left").withColumn("iterations", F.col("iterations") + 1))
        event(answered, 2 * turn + 1, f"repair#{turn + 1}", F.when(F.col("_code").isNull(), "no code block").otherwise("answered"))
        done.append(answered.where("_code is null").drop("_code").withColumn("verified", F.lit(False)))
        todo = answered.where("_code is not null").withColumn(text_col, F.col("_code")).drop("_code")
        if todo.isEmpty():
            break
    return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, trace)


def reviewed(docs: DataFrame, id_col: str, text_col: str, language_col: str, check: Check, provider: Provider, hits: DataFrame | None = None, wish: Column | None = None) -> DataFrame:
    """[G3] (id, violations, review, fix, fix_violations, fix_verified): each text is checked, reviewed by the provider,
    which is told what was found and what retrieval gave (hits: id, and an array of conventions), and the fix of the reply
    is checked in turn. Without a fenced block there is no fix; violations are counts."""
    found = written(check(docs))
    row = F.struct("start_line", "start_col", "rule_id", "message", "snippet")
    per = found.groupBy(id_col).agg(F.array_sort(F.collect_list(row)).alias("_found"))
    of = docs.join(per, id_col, "left")
    none = F.array().cast("array<struct<kind:string,id:string,title:string,guideline:string,example:string,language:string,score:double>>")
    of = of.join(hits.toDF(id_col, "_hits"), id_col, "left") if hits is not None else of.withColumn("_hits", none)
    prompt = review(F.coalesce(text_col, F.lit("")), F.col(language_col), F.col("_found"), F.coalesce("_hits", none), wish)
    asked = of.withColumn("prompt", prompt)
    replies = provider(asked.select(id_col, text_col, "prompt")).select(id_col, "reply")
    answered = written(asked.join(replies, id_col, "left").withColumn("_fix", extract_code_block(F.col("reply"))))
    again = check(answered.where("_fix is not null").select(*(F.col("_fix").alias(c) if c == text_col else F.col(c) for c in docs.columns)))
    left = again.groupBy(id_col).agg(F.count("*").alias("_left"))
    out, zero = answered.join(left, id_col, "left"), F.lit(0).cast("long")
    fixed = F.when(F.col("_fix").isNotNull(), F.coalesce("_left", zero))
    return out.select(id_col, F.coalesce(F.array_size("_found").cast("long"), zero).alias("violations"), F.col("reply").alias("review"), F.col("_fix").alias("fix"), fixed.alias("fix_violations"), F.coalesce(fixed == 0, F.lit(False)).alias("fix_verified"))
