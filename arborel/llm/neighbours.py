"""Nearest neighbours by a block matrix join of int8 tiles with error bounds, exact distances and heaps."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborel.llm.common import grouped, stored, usable, vector_blocks

#: Queries and candidates of a tile. A candidate is sent once for each block of queries, so these are the larger ones.
QUERY_BLOCK, CANDIDATE_BLOCK, _STRIP = 4096, 512, 512
#: Dimensions whose int8 products a float32 sum holds exactly.
_SLAB = 1024


def power_of_two(X: np.ndarray, axis: int | None = None) -> np.ndarray:
    """A power of two about the largest component of X (of each row, with axis 1): dividing by it is exact, and keeps
    squares of very large or small vectors within the range of numbers."""
    most = np.abs(X).max(axis, initial=0.0)
    return np.ldexp(1.0, np.clip(np.frexp(most)[1], -1000, 1000))


def quantized(X: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of what the codes stand for, and norms of what they miss."""
    scale = np.maximum(np.abs(X).max(1) / 127, np.finfo(float).tiny)
    codes = np.rint(X / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.sqrt((back**2).sum(1)), np.sqrt(((X - back) ** 2).sum(1))


def products(A: np.ndarray, B: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows: sums of a slab of dimensions fit the mantissa of the float32 that BLAS adds in."""
    out = np.zeros((len(A), len(B)))
    for k in range(0, A.shape[1], _SLAB):
        out += A[:, k : k + _SLAB].astype(np.float32) @ B[:, k : k + _SLAB].astype(np.float32).T
    return out


def tile(Q: np.ndarray, q_ids: np.ndarray, C: np.ndarray, c_ids: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """(query's row, its k nearest of the tile as (distance, id)). The int8 product bounds each distance from both
    sides; pairs whose lower bound is within the k-th smallest upper bound are computed in double precision. The queries
    go in strips, so that the bounds of a strip only are held."""
    unit = max(power_of_two(Q), power_of_two(C))
    ca, cs, cn, ce = quantized(C / unit)
    c_square = ((C / unit) ** 2).sum(1)
    for a in range(0, len(Q), _STRIP):
        q = Q[a : a + _STRIP] / unit
        qa, qs, qn, qe = quantized(q)
        dot = products(qa, ca) * qs[:, None] * cs
        slack = qn[:, None] * ce + qe[:, None] * cn + qe[:, None] * ce
        square = (q**2).sum(1)[:, None] + c_square
        slack += 1e-9 * square
        upper = square - 2 * (dot - slack)
        lower = square - 2 * (dot + slack)
        own = q_ids[a : a + _STRIP, None] == c_ids
        upper[own] = lower[own] = np.inf
        limit = np.partition(upper, k - 1, 1)[:, k - 1] if len(C) > k else np.full(len(q), np.inf)
        for i in range(len(q)):
            at = np.flatnonzero((lower[i] <= limit[i]) & ~own[i])
            if len(at):
                exact = distances(Q[a + i] - C[at])
                best = np.lexsort((c_ids[at], exact))[:k]
                yield a + i, list(zip(exact[best].tolist(), c_ids[at][best].tolist(), strict=True))


def distances(D: np.ndarray) -> np.ndarray:
    """Lengths of the rows, their squares added in the order of the components."""
    unit = power_of_two(D, 1)
    return np.sqrt(np.add.accumulate((D / unit[:, None]) ** 2, axis=1)[:, -1]) * unit


def nearest(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """query_id, rank (from 1), id_col and score (Euclidean distance) of each query's k nearest among all other rows.

    Queries and candidates are dealt to blocks by their ids; each pair of blocks meets once, in a task that holds no
    more than these two. A task merges its tiles' results by heaps, and so does a last step for each query.

    Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components, take no part.
    Vectors of different lengths do not meet. Rows with one id count once, by the smallest vector. Ties go to smaller
    ids. Queries without a candidate and empty tables give no rows; other columns are not used.
    """
    one = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).withColumn("_query", F.coalesce(is_query, F.lit(False)))
    one = one.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(vector_col).alias("vector"), F.max("_query").alias("query"))
    one = stored(one.withColumn("dim", F.size("vector")))
    n = one.agg(F.count("*").alias("all"), F.count_if("query").alias("queries")).first()
    cols, rows = max(1, -(-n["all"] // CANDIDATE_BLOCK)), max(1, -(-n["queries"] // QUERY_BLOCK))
    block = lambda count, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    asks = one.where("query").select("dim", block(rows, "q").alias("qb"), every(cols).alias("cb"), F.lit(True).alias("ask"), "id", "vector")
    answers = one.select("dim", every(rows).alias("qb"), block(cols, "c").alias("cb"), F.lit(False).alias("ask"), "id", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {}
        row = None

        def out() -> pa.RecordBatch:
            flat = [(q, i, d) for q, found in best.items() for d, i in found]
            best.clear()
            q, i, d = zip(*flat, strict=True) if flat else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "id", "score"])

        for t, b in grouped(batches, ["dim", "qb", "cb"]):
            for x, y in zip(b[:-1].tolist(), b[1:].tolist(), strict=True):
                part = t.slice(x, y - x)
                now = (part.column("dim")[0].as_py(), part.column("qb")[0].as_py())
                if row not in (None, now):
                    yield out()
                row = now
                ask = part.column("ask").to_numpy()
                ids, X = part.column("id").to_numpy(), vector_blocks(part, "vector")
                if ask.all() or not ask.any():
                    continue
                for i, found in tile(X[ask], ids[ask], X[~ask], ids[~ask], k):
                    q = int(ids[ask][i])
                    best[q] = heapq.nsmallest(k, heapq.merge(best.get(q, []), found))
        yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, b in grouped(batches, ["query_id"]):
            ids, score = t.column("id").to_pylist(), t.column("score").to_pylist()
            rows = []
            for x, y in zip(b[:-1].tolist(), b[1:].tolist(), strict=True):
                q = t.column("query_id")[x].as_py()
                rows += [(q, r, i, d) for r, (d, i) in enumerate(heapq.nsmallest(k, zip(score[x:y], ids[x:y], strict=True)), 1)]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())], names=["query_id", "rank", id_col, "score"])

    found = asks.union(answers).repartition("dim", "qb", "cb").sortWithinPartitions("dim", "qb", "cb").mapInArrow(run, "query_id long, id long, score double")
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, f"query_id long, rank int, `{id_col}` long, score double")
