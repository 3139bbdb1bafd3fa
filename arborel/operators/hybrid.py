"""Hybrid search: lexical, vector and metadata signals blended by weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborel.functions.metadata import matches, overlap
from arborel.operators.lexical import score_query

# The weights of the signals.
WEIGHTS = {"meta": 0.20, "ast": 0.45, "text": 0.35}


def blend(entries: DataFrame, *, id_col: str, wanted: dict[str, object], text: DataFrame | None = None, vector: DataFrame | None = None, least: float = 0.0, k: int = 8) -> DataFrame:
    """[S3-S11] The k best entries (id, meta map, further columns): rank, score and match_reason.

    text (id, bm25) and vector (id, ast) hold scores over the whole corpus; None says that the signal is absent, and
    the weights of those present are scaled to one. Entries must pass the metadata filter; with vectors those under
    least go, without them those without a lexical match. An absent score counts 0. Ties go to the smaller id.
    """
    present = ["meta"] + ["ast"] * (vector is not None) + ["text"] * (text is not None)
    of = entries.where(matches(F.col("meta"), wanted)).withColumn("s_meta", overlap(F.col("meta"), wanted))
    if vector is not None:
        of = of.join(vector, id_col, "left").withColumn("s_ast", F.coalesce("ast", F.lit(0.0))).where(F.col("s_ast") >= least)
    if text is not None:
        # a hit of pure text search needs a lexical match
        of = of.join(text, id_col, "left" if vector is not None else "inner").withColumn("s_text", F.coalesce("bm25", F.lit(0.0)))
    total = sum(WEIGHTS[x] for x in present)
    score = sum((F.col(f"s_{x}") * WEIGHTS[x] for x in present), F.lit(0.0)) / total
    reason = [F.format_string(f"{name}=%.3f", F.col(f"s_{x}")) for x, name in (("text", "bm25"), ("ast", "ast_similarity"), ("meta", "metadata_overlap")) if x in present]
    of = of.withColumn("score", F.round(score, 6)).withColumn("match_reason", F.concat_ws(", ", *reason))
    return of.select(id_col, "score", "match_reason").orderBy(F.desc("score"), id_col).limit(k)


def search(entries: DataFrame, corpus: DataFrame, *, id_col: str, text: Column, query: str | None, wanted: dict[str, object], vector: DataFrame | None = None, least: float = 0.0, k: int = 8) -> DataFrame:
    """[S6, S13] blend with scores of query over the whole corpus. An empty query is an absent signal, as null is: hits
    are then ranked by what else is given."""
    return blend(entries, id_col=id_col, wanted=wanted, text=score_query(corpus, id_col, text, query) if query else None, vector=vector, least=least, k=k)


def summaries(entries: DataFrame, *, id_col: str) -> DataFrame:
    """[S14] What a listing shows of entries: id, kind, language, title and the metadata as JSON, keys in order."""
    items = F.array_sort(F.map_entries("meta"))
    one = lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), F.to_json(e["value"]))
    return entries.select(id_col, "kind", "language", "title", F.concat(F.lit("{"), F.array_join(F.transform(items, one), ","), F.lit("}")).alias("metadata"))
