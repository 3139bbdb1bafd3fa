"""Lexical retrieval: postings, corpus statistics and exact BM25."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborel.functions.batches import largest
from arborel.functions.text import K1, B, bm25_term, idf, tokenize
from arborel.operators.blocks import best_of_blocks
from arborel.sources.tables import written

#: Query terms of a block, documents and terms of a block, and cells of a matrix that a step holds.
BATCH_TERMS, BLOCK_DOCS, BLOCK_TERMS, _CELLS = 2_000, 16_384, 1_000_000, 2_000_000
#: Bits of the filter of the terms that are asked, and tokens that a task counts at once.
FILTER_BITS, _BUCKET, _TOKENS = 1 << 22, 1 << 15, 500_000


def postings(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """[T4] (id, term, tf)."""
    return docs.select(F.col(id_col), F.explode(tokenize(text)).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def doc_lengths(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """[T5] (id, dl), documents without tokens included."""
    return docs.select(id_col, F.size(tokenize(text)).cast("long").alias("dl"))


def corpus_stats(docs: DataFrame, text: Column) -> DataFrame:
    """[T5, T11] One row: docs, terms, avg_doc_len. Texts are tokenized once: each gives its distinct terms, and a null
    with its length."""
    tokens = docs.select(tokenize(text).alias("tokens"))
    terms = tokens.select(F.size("tokens").alias("dl"), F.explode(F.array_append(F.array_distinct("tokens"), F.lit(None).cast("string"))).alias("term"))
    per = terms.groupBy("term").agg(F.count("*").alias("n"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("length"))
    # only the null has a length
    sums = per.agg(F.coalesce(F.sum(F.when(F.col("term").isNull(), F.col("n"))), F.lit(0)).alias("docs"), F.count("term").alias("terms"), F.sum("length").alias("length"))
    return sums.select("docs", "terms", F.coalesce(F.round(F.col("length") / F.nullif("docs", F.lit(0)), 1), F.lit(0.0)).alias("avg_doc_len"))


def document_frequency(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """[T6, T7] (term, df, idf)."""
    n = docs.count()
    df = docs.select(F.explode(F.array_distinct(tokenize(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", "df", idf(F.lit(n), F.col("df")).alias("idf"))


def score_query(docs: DataFrame, id_col: str, text: Column, query: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """[T8, T9] (id, keep, bm25): scores of all documents that hold a term, divided by the best one.

    A term counts as often as the query holds it. Texts are tokenized once: each document's length and counts of the
    query's terms are written, and two rows of sums over them (documents, mean length and document frequencies; the
    best score) are all that is gathered. Postings are never shuffled.
    """
    spark = docs.sparkSession
    terms = Counter(spark.range(1).select(tokenize(F.lit(query))).first()[0])
    if not terms:
        return docs.select(id_col, *keep, F.lit(0.0).alias("bm25")).where(F.lit(False))
    names = list(terms)
    of = docs.select(id_col, *keep, tokenize(text).alias("tokens"))
    counts = [F.size(F.array_remove("tokens", x)) for x in names]
    of = written(of.select(id_col, *keep, F.size("tokens").alias("dl"), F.array(*(F.size("tokens") - c for c in counts)).alias("tf")))
    s = of.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(names)))).first()
    if not s["n"] or not s["avgdl"]:
        return docs.select(id_col, *keep, F.lit(0.0).alias("bm25")).where(F.lit(False))
    weight = [idf(F.lit(s["n"]), F.lit(s[f"df{i}"])) * terms[x] for i, x in enumerate(names)]
    parts = [F.when(F.col("tf")[i] > 0, bm25_term(F.col("tf")[i], F.col("dl"), F.lit(s["avgdl"]), w)).otherwise(0.0) for i, w in enumerate(weight)]
    raw = of.select(id_col, *keep, sum(parts[1:], parts[0]).alias("raw")).where("raw > 0")
    best = raw.agg(F.max("raw")).first()[0]
    return raw.select(id_col, *keep, (F.col("raw") / F.lit(best)).alias("bm25"))


def term_counts(docs: DataFrame, id_col: str, text: Column, asked: DataFrame | None = None) -> DataFrame:
    """(id, dl, terms, tf) of each document: its distinct terms with their counts; if asked (term) is given, those that it
    may hold. A filter of FILTER_BITS bits tells them, of a fixed size whatever is asked; it lets some other terms pass too.
    A task counts the terms of about _TOKENS tokens at once."""
    bits = None if asked is None else np.zeros(FILTER_BITS // 8, np.uint8)
    if asked is not None:
        at = F.crc32(F.col("term").cast("binary")) % FILTER_BITS
        for r in asked.select("term").distinct().groupBy(F.floor(at / _BUCKET).cast("int").alias("b")).agg(F.bitmap_construct_agg(at % _BUCKET).alias("bits")).collect():
            bits[r["b"] * _BUCKET // 8 : (r["b"] + 1) * _BUCKET // 8] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in _parts(batches):
            tokens = batch.column(1)
            size = np.diff(tokens.offsets.to_numpy())
            coded = tokens.flatten().dictionary_encode()
            code = coded.indices.to_numpy()
            of = np.repeat(np.arange(len(batch)), size)
            if bits is not None:
                hashed = np.fromiter((zlib.crc32(t.encode()) % FILTER_BITS for t in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
                passed = (bits[hashed >> 3] >> (hashed & 7) & 1).astype(bool)
                kept = passed[code] if len(code) else np.zeros(0, bool)
                of, code = of[kept], code[kept]
            width = max(1, len(coded.dictionary))
            key, tf = np.unique(of * width + code, return_counts=True)
            ends = np.searchsorted(key, np.arange(len(batch) + 1) * width).astype(np.int32)
            terms = coded.dictionary.take(pa.array(key % width))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), terms), pa.ListArray.from_arrays(pa.array(ends), pa.array(tf.astype(np.float64)))], names=["id", "dl", "terms", "tf"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), tokenize(text).alias("tokens")).mapInArrow(run, f"id {kind}, dl long, terms array<string>, tf array<double>")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of (id, tokens) with about _TOKENS tokens, one document at least."""
    for batch in batches:
        ends = batch.column(1).offsets.to_numpy()
        cut = np.flatnonzero(np.diff((ends[1:] - ends[0]) // _TOKENS, prepend=0))
        bounds = sorted({0, *cut.tolist(), len(batch)})
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield batch.slice(a, b - a)


def score_queries(docs: DataFrame, id_col: str, text: Column, queries: DataFrame, query_col: str, query_text: Column, k: int) -> DataFrame:
    """[G1, T8, S11] (query, id, rank, raw): the k best documents of each of many queries. Scores are rounded to six
    places, and ties go to smaller ids.

    Texts are tokenized once, and of each document the counts of terms that are asked are written. Then blocks of
    documents are scored against blocks of queries, and each task hands on its k best of a query only, so a frequent term
    is no hot key.
    """
    asked = written(postings(queries, query_col, query_text).select(F.col(query_col).alias("query"), "term", "tf"))
    of = written(term_counts(docs, id_col, text, asked))
    s = of.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    # tasks count the terms of their documents before any are shuffled
    df = of.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return best_documents(of, asked, df, s["n"], s["avgdl"] or 1.0, k).toDF(query_col, id_col, "rank", "raw")


def best_documents(of: DataFrame, asked: DataFrame, df: DataFrame, n: int, avgdl: float, k: int) -> DataFrame:
    """(query, id, rank, raw) for documents (id, dl, terms, tf) among n of a mean length, queries (query, term, tf) and
    document frequencies (term, df)."""
    term = F.struct("term", (F.col("tf") * idf(F.lit(n), F.col("df"))).alias("w"))
    asks = asked.join(df, "term").groupBy("query").agg(F.array_sort(F.collect_list(term)).alias("of"))
    asks = written(asks.select(F.col("query").alias("id"), F.lit(0).cast("long").alias("dl"), F.col("of.term").alias("terms"), F.col("of.w").alias("tf")))
    sized = lambda d: d.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    q, d = sized(asks), sized(of)

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = asked["terms"].combine_chunks()
        vocabulary = names.flatten().unique()
        W = np.zeros((len(vocabulary), len(asked)))
        column = np.repeat(np.arange(len(asked)), np.diff(names.offsets.to_numpy()))
        W[pa.compute.index_in(names.flatten(), value_set=vocabulary).to_numpy(), column] = asked["tf"].combine_chunks().flatten().to_numpy()
        block, found = max(1, _CELLS // max(W.shape)), []
        for a in range(0, len(held), block):
            part = held.slice(a, block)
            terms = part["terms"].combine_chunks()
            of = np.repeat(np.arange(len(part)), np.diff(terms.offsets.to_numpy()))
            term = pa.compute.fill_null(pa.compute.index_in(terms.flatten(), value_set=vocabulary), -1).to_numpy()
            tf = np.zeros((len(part), len(vocabulary)))
            tf[of[term >= 0], term[term >= 0]] = part["tf"].combine_chunks().flatten().to_numpy()[term >= 0]
            length = K1 * (1 - B + B * part["dl"].to_numpy() / avgdl)
            raw = np.round((tf * (K1 + 1) / (tf + length[:, None])) @ W, 6)
            row, column = largest(np.where(raw > 0, raw, -np.inf), k)
            found.append(pa.table([asked["query"].take(pa.array(column)), part["id"].take(pa.array(row)), pa.array(raw[row, column])], names=["query", "id", "raw"]))
        return pa.concat_tables(found)

    blocks = -(-q["terms"] // BATCH_TERMS), max(-(-d["n"] // BLOCK_DOCS), -(-d["terms"] // BLOCK_TERMS))
    return best_of_blocks(asks, of.select("id", "dl", "terms", "tf").where(F.size("terms") > 0), *blocks, score, k).select("query", "id", "rank", "raw")
