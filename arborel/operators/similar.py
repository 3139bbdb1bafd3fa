"""Exact similarity search of many vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborel.functions.batches import largest
from arborel.functions.vectors import finite
from arborel.operators.blocks import best_of_blocks
from arborel.sources.tables import written

#: Queries and vectors of a block, and scores that a step holds.
BATCH, BLOCK, _CELLS = 2_000, 16_384, 2_000_000


def similar(vectors: DataFrame, is_query: Column, *, id_col: str, vector_col: str, k: int) -> DataFrame:
    """[V1, V3] (query_id, rank, id, score): for each query the k other vectors of the largest inner product, clipped to
    0 and 1 and rounded to six places; ties go to smaller ids.

    Blocks of queries and of vectors meet once each, and a task hands on its k best of a query. Vectors of another length
    than a query's, null ones, those with null or non-finite components and null ids are left out.
    """
    of = vectors.where(F.col(id_col).isNotNull() & finite(F.col(vector_col)))
    of = written(of.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")))
    s = of.agg(F.count_if("q").alias("queries"), F.count("*").alias("n")).first()

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = []
        queries = _by_length(asked["query"].to_numpy(), asked["v"].combine_chunks())
        for length, (ids, X) in _by_length(held["id"].to_numpy(), held["v"].combine_chunks()).items():
            asks, Q = queries.get(length, ((), None))
            step = max(1, _CELLS // max(1, len(asks)))
            for a in range(0, len(ids) if len(asks) else 0, step):
                part = np.round(np.clip(X[a : a + step] @ Q.T, 0, 1), 6)
                part[ids[a : a + step, None] == asks] = -np.inf
                row, column = largest(part, k)
                found.append(pa.table([pa.array(asks[column]), pa.array(ids[a + row]), pa.array(part[row, column])], names=["query", "id", "raw"]))
        return pa.concat_tables(found) if found else pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query", "id", "raw"])

    top = best_of_blocks(of.where("q").select("id", "v"), of.select("id", "v"), -(-s["queries"] // BATCH), -(-s["n"] // BLOCK), score, k)
    return top.select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), F.col("raw").alias("score"))


def _by_length(ids: np.ndarray, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the vectors of each length."""
    vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
    offsets, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    at = {int(n): np.flatnonzero(size == n) for n in np.unique(size)}
    return {n: (ids[i], flat[offsets[:-1][i][:, None] + np.arange(n)]) for n, i in at.items()}
