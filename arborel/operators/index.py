"""A stored inverted index that changes with its documents.

Postings (term, id, tf, dl, segment) lie in buckets by term, so a search reads those of its terms only; each build or
change adds a segment of them. Documents (id, dl, segment) lie in buckets by id and tell what is live: a change rewrites
those it touches and notes (id, segment) of what it takes away, which searches leave out. Number and length of the live
documents are kept with the version, so no search counts them. All that makes up a version is named in one marker.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from arborel.functions.text import bm25_term, idf, tokenize
from arborel.operators.lexical import best_documents, term_counts
from arborel.operators.lexical import postings as counted
from arborel.sources import versions
from arborel.sources.tables import written
from arborel.sources.versions import Version

#: Buckets of terms and of documents, and postings that one file is to hold.
BUCKETS, FILE_POSTINGS = 64, 5_000_000
#: Segments after which a change also merges all of them.
SEGMENTS = 8


def _documents(docs: DataFrame, id_col: str, text: Column, segment: int) -> tuple[DataFrame, DataFrame]:
    """(id, dl, segment) and (term, id, tf, dl, segment). A document's terms are counted where it is read; only postings
    are shuffled, once, to their buckets."""
    of = written(term_counts(docs, id_col, text))
    mark = F.lit(segment).alias("segment")
    posted = of.select("id", "dl", F.inline(F.arrays_zip("terms", "tf")).alias("term", "tf"))
    return of.select("id", "dl", mark), posted.select("term", "id", F.col("tf").cast("long").alias("tf"), "dl", mark)


def _files(length: int, buckets: int) -> int:
    """Files of a bucket: a term that all documents hold is split over them."""
    return max(1, -(-length // (FILE_POSTINGS * buckets)))


def _sizes(docs: DataFrame) -> tuple[int, int]:
    s = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length"), F.count_distinct("id").alias("ids")).first()
    if s["ids"] != s["n"]:
        raise ValueError("an id is null or comes more than once")
    return s["n"], s["length"]


def _docs_table(v: Version) -> Version:
    return replace(v, key="id", schema=StructType.fromJson(v.notes["docs_schema"]), folders={int(b): f for b, f in v.notes["docs"].items()})


def build(docs: DataFrame, path: str, id_col: str, text: Column, *, buckets: int = BUCKETS) -> Version:
    """[S6] A new index of all documents in path, as version 1. Ids must be there and distinct; null and empty texts have a
    length of 0 and count as documents."""
    own, posted = _documents(docs, id_col, text, 0)
    n, length = _sizes(own)
    notes = {"n": n, "length": length, "segments": 1, "next": 1, "dead": [], "docs": versions.put(own, path, "id", buckets), "docs_schema": own.schema.jsonValue()}
    return versions.create(posted, path, "term", buckets=buckets, files=_files(length, buckets), notes=notes)


def change(spark: SparkSession, path: str, *, new: DataFrame | None = None, id_col: str = "id", text: Column | None = None, gone: DataFrame | None = None) -> Version:
    """[S12] The next version: new documents take the place of those with their ids, and the ids of gone go. Only the
    documents' touched buckets are rewritten; postings are added, and merged after SEGMENTS changes."""
    v = versions.version(spark, path)
    docs, segment = _docs_table(v), v.notes["next"]
    kind = docs.schema["id"].dataType
    none = spark.createDataFrame([], v.schema)
    added, posted = _documents(new.withColumn(id_col, F.col(id_col).cast(kind)), id_col, text, segment) if new is not None else (none.select("id", "dl", "segment"), none)
    n, length = _sizes(added)
    ids = added.select("id")
    ids = written((ids if gone is None else ids.unionByName(gone.select(F.col(id_col).cast(kind).alias("id")))).distinct())
    touched = versions.buckets_of(ids, docs)
    old = versions.rows(spark, docs, touched)
    dead = written(old.join(ids, "id", "left_semi").select("id", "segment", "dl"))
    lost = dead.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
    kept = {b: f for b, f in docs.folders.items() if b not in touched}
    put = versions.put(old.join(ids, "id", "left_anti").unionByName(added), path, "id", v.buckets)
    made = versions.put(posted, path, "term", v.buckets, _files(length, v.buckets)) if n else {}
    grave = [f for of in versions.put(dead.select("id", "segment"), path, "id", 1).values() for f in of] if lost["n"] else []
    notes = v.notes | {"n": v.notes["n"] + n - lost["n"], "length": v.notes["length"] + length - lost["length"], "segments": v.notes["segments"] + 1, "next": segment + 1, "dead": v.notes["dead"] + grave, "docs": kept | put}
    folders = {b: v.folders.get(b, []) + made.get(b, []) for b in v.folders.keys() | made.keys()}
    after = replace(v, number=v.number + 1, folders=folders, notes=notes)
    return versions.commit(spark, _merged(spark, after) if notes["segments"] > SEGMENTS else after)


def _merged(spark: SparkSession, v: Version) -> Version:
    """v with its live postings in one segment's folders; what is dead is gone."""
    put = versions.put(live_postings(spark, v), v.path, "term", v.buckets, _files(v.notes["length"], v.buckets))
    return replace(v, folders=put, notes=v.notes | {"segments": 1, "dead": []})


def live_postings(spark: SparkSession, v: Version, terms: DataFrame | None = None) -> DataFrame:
    """The postings of the version, of the terms only if they are given: other buckets are not read."""
    of = versions.rows(spark, v, None if terms is None else versions.buckets_of(terms, v))
    if v.notes["dead"]:
        dead = spark.read.schema("id " + v.schema["id"].dataType.simpleString() + ", segment int").parquet(*(f"{v.path}/{f}" for f in v.notes["dead"]))
        of = of.join(dead, ["id", "segment"], "left_anti")
    return of


def score_query(spark: SparkSession, path: str, query: str, number: int | None = None) -> DataFrame:
    """[T8, T9, S6] (id, bm25) as lexical.score_query has it, from the last version of the index or the one of the number."""
    v = versions.version(spark, path, number)
    times = Counter(spark.range(1).select(tokenize(F.lit(query))).first()[0])
    none = spark.createDataFrame([], v.schema).select("id", F.lit(0.0).alias("bm25"))
    if not times or not v.notes["length"]:
        return none
    terms = spark.createDataFrame(list(times.items()), "term string, times long")
    found = written(live_postings(spark, v, terms).where(F.col("term").isin(*times)))
    df = found.groupBy("term").agg(F.count("*").alias("df")).collect()  # a row for each term of the query
    if not df:
        return none
    n, avgdl = F.lit(v.notes["n"]), F.lit(v.notes["length"] / v.notes["n"])
    weights = [F.when(F.col("term") == r["term"], idf(n, F.lit(r["df"])) * times[r["term"]]) for r in df]
    raw = found.groupBy("id").agg(F.sum(bm25_term(F.col("tf"), F.col("dl"), avgdl, F.coalesce(*weights))).alias("raw")).where("raw > 0")
    raw = written(raw)
    best = raw.agg(F.max("raw")).first()[0]
    return raw.select("id", (F.col("raw") / F.lit(best)).alias("bm25"))


def score_queries(spark: SparkSession, path: str, queries: DataFrame, query_col: str, query_text: Column, k: int, number: int | None = None) -> DataFrame:
    """[G1, S11] (query, id, rank, raw) as lexical.score_queries has it, from the index."""
    v = versions.version(spark, path, number)
    asked = written(counted(queries, query_col, query_text).select(F.col(query_col).alias("query"), "term", "tf"))
    terms = written(asked.select("term").distinct())
    found = written(live_postings(spark, v, terms).join(terms, "term", "left_semi"))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    row = F.struct("term", F.col("tf").cast("double").alias("tf"))
    of = found.groupBy("id", "dl").agg(F.collect_list(row).alias("of")).select("id", "dl", F.col("of.term").alias("terms"), F.col("of.tf").alias("tf"))
    avgdl = v.notes["length"] / v.notes["n"] if v.notes["length"] else 1.0
    return best_documents(written(of), asked, df, v.notes["n"], avgdl, k).toDF(query_col, "id", "rank", "raw")
