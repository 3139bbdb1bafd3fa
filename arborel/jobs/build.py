"""Corpora built from convention files and indexed units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborel.operators.corpus import latest
from arborel.sources.conventions import quarantined
from arborel.sources.tables import written


def indexed_units(units: DataFrame, *, language: Column, name: Column, snippet: Column, source: Column, existing: DataFrame | None = None) -> DataFrame:
    """[C3-C5] Pattern entries (id, kind, language, title, guideline, meta, good_example) of code units: the id holds a
    digest of the snippet, the first source of one content stays, and ids of existing entries are left alone."""
    of = units.select(language.alias("language"), name.alias("name"), snippet.alias("good_example"), source.alias("source")).where("good_example is not null")
    of = of.withColumn("id", F.concat(F.lit("pattern:"), "language", F.lit(":"), "name", F.lit(":"), F.substring(F.md5("good_example"), 1, 10)))
    of = of.groupBy("id").agg(F.min(F.struct("source", "language", "name", "good_example")).alias("u")).select("id", "u.*")
    if existing is not None:
        of = of.join(existing.select("id"), "id", "left_anti")
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), F.array(value).alias("value"))
    return of.select("id", F.lit("pattern").alias("kind"), "language", F.concat(F.lit("unit "), "name").alias("title"), F.concat(F.lit("As written in "), "source", F.lit("; keep to its shape.")).alias("guideline"), F.map_from_entries(F.array(pair("source", F.col("source")), pair("unit", F.col("name")))).alias("meta"), "good_example")


def index_summary(indexed: DataFrame, most: int = 50) -> DataFrame:
    """[C6] One row: how many patterns were indexed, and the first ids."""
    first = indexed.select("id").orderBy("id").limit(most).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return indexed.agg(F.count("*").alias("indexed")).join(first)


def build(entries: DataFrame, indexed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """[C7] The corpus (id, kind, language, title, guideline, meta, good_example) from entries of convention files and
    indexed units, and a report (source, loaded, errors, error) with a row for each file and one for the units. An entry
    with an error is left out and counted; of one id the last by its file stays, and a unit gives way to an entry."""
    checked = written(quarantined(entries))
    good = latest(checked.where("error is null"), "id", "file")
    columns = ("id", "kind", "language", "title", "guideline", "meta", "good_example")
    corpus = good.select(*columns).unionByName(indexed.join(good.select("id"), "id", "left_anti").select(*columns))
    files = checked.groupBy(F.col("file").alias("source")).agg(F.count_if(F.col("error").isNull()).alias("loaded"), F.count("error").alias("errors"), F.min("error").alias("error"))
    units = indexed.agg(F.lit("units").alias("source"), F.count("*").alias("loaded"), F.lit(0).cast("long").alias("errors"), F.lit(None).cast("string").alias("error"))
    return corpus, files.unionByName(units)
