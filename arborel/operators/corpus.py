"""Corpora of entries: statistics, grouping, content ids, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stats(entries: DataFrame, language_col: str, kind_col: str) -> DataFrame:
    """[C8] (by, value, n): counts by language and by kind in one pass."""
    sets = entries.groupingSets([[F.col(language_col)], [F.col(kind_col)]], F.col(language_col), F.col(kind_col))
    out = sets.agg(F.grouping(F.col(language_col)).alias("g"), F.count("*").alias("n"))
    return out.select(F.when(F.col("g") == 0, "language").otherwise("kind").alias("by"), F.when(F.col("g") == 0, F.col(language_col)).otherwise(F.col(kind_col)).alias("value"), "n")


def grouped(entries: DataFrame, category_col: str, language_col: str) -> DataFrame:
    """[C9] (category, n, languages), the largest first; entries without a category are uncategorized."""
    category = F.coalesce(F.nullif(F.col(category_col), F.lit("")), F.lit("uncategorized"))
    per = entries.groupBy(category.alias("category")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(language_col)), ",").alias("languages"))
    return per.orderBy(F.desc("n"), "category")


def content_ids(entries: DataFrame, id_col: str, language_col: str, name_col: str, text_col: str) -> DataFrame:
    """[C3, C4] (content_id, id): of entries with one content the first by id stays."""
    content = F.concat(F.lit("pattern:"), language_col, F.lit(":"), name_col, F.lit(":"), F.substring(F.md5(text_col), 1, 10))
    return entries.where(F.col(text_col).isNotNull()).groupBy(content.alias("content_id")).agg(F.min(id_col).alias(id_col))


def first_rows(files: DataFrame, order_col: str, limit: int) -> DataFrame:
    """[I6] The first rows in order. TakeOrderedAndProject keeps limit rows of each task."""
    return files.orderBy(order_col).limit(limit)


def upsert(old: DataFrame, new: DataFrame, id_col: str, replace: bool) -> DataFrame:
    """[I11] old with new; an id that both have is an error unless replace is set. New ids must be distinct."""
    ids = new.select(id_col)
    if not replace and not old.join(ids, id_col, "left_semi").isEmpty():
        raise ValueError("some ids already exist")
    return old.join(ids, id_col, "left_anti").unionByName(new)


def delete(old: DataFrame, entry_id: str, id_col: str) -> tuple[DataFrame, bool]:
    """[I12] The rest, and whether the id was there."""
    return old.where(F.col(id_col) != entry_id), not old.where(F.col(id_col) == entry_id).isEmpty()


def latest(entries: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """The last row of each id."""
    order = Window.partitionBy(id_col).orderBy(F.desc(order_col))
    return entries.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
