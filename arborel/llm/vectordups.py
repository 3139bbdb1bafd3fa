"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborel.llm.common import dealt, grouped, stored, usable, vector_blocks
from arborel.llm.components import connected_components
from arborel.llm.neighbours import power_of_two

#: Bits of a code, and the vectors of a label for which the least of them do; each doubling of these adds a bit, so that
#: buckets of unlike vectors do not grow with the input.
LEAST_BITS, MOST_BITS, ROWS = 12, 30, 1 << 20
#: The probability that a pair just at the least cosine meets in no table.
MISSED = 5e-4
#: Members of a bucket that meet in one task; larger buckets meet block by block.
BLOCK = 512
_SMALL = 24


def tables_of(bits: int, cosine: float) -> int:
    """Tables with which a pair at this cosine is missed with a probability of MISSED: 32 of 12 bits at 0.93."""
    agree = (1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi) ** bits
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-agree))) if agree < 1 else 1


def sign_codes(X: np.ndarray, bits: int, tables: int, seed: int = 11) -> np.ndarray:
    """A code for each row and table."""
    planes = np.random.default_rng(seed + X.shape[1]).normal(size=(X.shape[1], tables * bits))
    signs = (X @ planes > 0).reshape(len(X), tables, bits)
    return (signs << np.arange(bits)).sum(2).astype(np.int32)


def units(X: np.ndarray) -> np.ndarray:
    """Rows of length one; the division by a power of two keeps squares of very large and small ones within range."""
    X = X / power_of_two(X, 1)[:, None]
    return X / np.sqrt((X**2).sum(1))[:, None]


def _coded(reps: DataFrame, cosine: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in _alike(batch.column(2).to_numpy(), batch.column(3).to_numpy(), 2048):
                part = batch.slice(x, y - x)
                bits = part.column(3)[0].as_py()
                tables = tables_of(bits, cosine)
                codes = sign_codes(units(vector_blocks(pa.Table.from_batches([part]), "vector")), bits, tables)
                at = pa.array(np.repeat(np.arange(len(part)), tables))
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(at) for k in range(4)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(part))), pa.array(codes.ravel())], names=["id", "label", "dim", "bits", "tab", "code"])

    kind = dict(reps.dtypes)["label"]
    return reps.select("id", "label", "dim", "bits", "vector").mapInArrow(run, f"id long, label {kind}, dim int, bits int, tab int, code int")


def _alike(dims: np.ndarray, bits: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Stretches of rows, most at most, that agree in dimensions and bits."""
    new = np.flatnonzero((np.diff(dims) != 0) | (np.diff(bits) != 0)) + 1
    cuts = sorted({0, len(dims), *new.tolist(), *range(0, len(dims), most)})
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _links(meeting: DataFrame, cosine: float) -> DataFrame:
    """Partial results of each group: a row (a, null, n) for n vectors linked with a, and (a, b, 0) for pairs that
    connect what is linked. A pair counts in the first table where its codes agree, and of a split bucket only where
    its two blocks meet, so it counts once."""
    by = ["label", "dim", "bits", "tab", "code", "bi", "bj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, b in grouped(batches, by):
            ids, weight, own = (t.column(c).to_numpy() for c in ("id", "copies", "own"))
            cross, table = t.column("bi").to_numpy() != t.column("bj").to_numpy(), t.column("tab").to_numpy()
            degree = np.zeros(len(t), np.int64)
            left, right = [], []
            for lo, hi in _alike(t.column("dim").to_numpy(), t.column("bits").to_numpy(), len(t)):
                X = units(vector_blocks(t.slice(lo, hi - lo), "vector"))
                bits = t.column("bits")[lo].as_py()
                codes = sign_codes(X, bits, tables_of(bits, cosine))
                mine = b[(b >= lo) & (b <= hi)] - lo
                size = np.diff(mine)

                def counted(i: np.ndarray, j: np.ndarray, lo: int = lo, codes: np.ndarray = codes) -> np.ndarray:
                    first = (codes[i] == codes[j]).argmax(1) == table[lo + i]
                    return first & ((own[lo + i] != own[lo + j]) == cross[lo + i])

                small = size <= _SMALL
                for off in range(1, int(size[small].max(initial=1))):
                    some = small & (size > off)
                    spans = [np.arange(x, y - off) for x, y in zip(mine[:-1][some], mine[1:][some], strict=True)]
                    for i in np.array_split(np.concatenate(spans), max(1, sum(map(len, spans)) // 20_000)) if spans else ():
                        i = i[np.einsum("ij,ij->i", X[i], X[i + off]) >= cosine]
                        i = i[counted(i, i + off)]
                        np.add.at(degree, lo + i, weight[lo + i + off])
                        np.add.at(degree, lo + i + off, weight[lo + i])
                        left.append(lo + i)
                        right.append(lo + i + off)
                for x, y in zip(mine[:-1][~small].tolist(), mine[1:][~small].tolist(), strict=True):
                    near = X[x:y] @ X[x:y].T >= cosine
                    np.fill_diagonal(near, False)
                    for k in range(y - x):
                        j = np.flatnonzero(near[k])
                        j = j[counted(np.full(len(j), x + k), x + j)]
                        degree[lo + x + k] += weight[lo + x + j].sum()
                    rest = np.ones(y - x, bool)
                    for root in range(y - x):
                        todo = [root] if rest[root] else []
                        rest[root] = False
                        while todo:
                            k = todo.pop()
                            j = np.flatnonzero(near[k] & rest)
                            rest[j] = False
                            todo.extend(j.tolist())
                            j = j[counted(np.full(len(j), x + k), x + j)]
                            left.append(np.full(len(j), lo + x + k))
                            right.append(lo + x + j)
            a, c = (np.concatenate(z).astype(int) if z else np.zeros(0, int) for z in (left, right))
            some = np.flatnonzero(degree)
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((ids[some], ids[a]))), pa.concat_arrays([none, pa.array(ids[c])]), pa.array(np.concatenate((degree[some], np.zeros(len(a), np.int64))))], names=["a", "b", "n"])

    return meeting.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long, n long")


def near_duplicate_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93) -> DataFrame:
    """id_col, n_links, component_id and kept, one row for each id.

    Vectors with one label are linked if their cosine, in double precision, is at least cosine. n_links counts the
    other vectors linked directly; component_id is the smallest id that links reach. Exact copies become one vector
    with a number first, so copies are never paired; pairs are found in hash tables and checked.

    Rows with a null id are left out; rows with one id count once, by the smallest vector and label. Null labels and
    vectors that are null, empty, zero or hold null or non-finite components are linked with nothing.
    """
    one = vectors.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.struct(F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))).alias("_v"))
    one = stored(one.select("id", "_v.vector", "_v.label"))
    part = one.where(F.col("label").isNotNull() & usable(F.col("vector")))
    reps = stored(part.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("vector")))
    # a label's vectors set the length of its codes
    sizes = reps.groupBy("label").agg(F.count("*").alias("size"))
    bits = F.least(F.greatest(F.ceil(F.log2(F.col("size") / ROWS)).cast("int"), F.lit(0)) + LEAST_BITS, F.lit(MOST_BITS))
    reps = stored(reps.join(dealt(sizes.select("label", bits.alias("bits"))), "label"))
    coded = _coded(reps.select(F.col("rep").alias("id"), "label", "dim", "bits", "vector"), cosine)
    bucket = ["label", "dim", "bits", "tab", "code"]
    shared = dealt(coded.groupBy(*bucket).count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")))
    own = F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int")
    met = coded.join(shared, bucket).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.join(reps.select(F.col("rep").alias("id"), "vector", "copies"), "id")
    met = met.select(*bucket, F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "id", "vector", "copies")
    found = stored(_links(met, cosine))
    degree = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("more"))
    component = connected_components(found.where("b is not null").select("a", "b")).toDF("rep", "component")
    of = reps.join(degree, "rep", "left").join(component, "rep", "left")
    of = of.select("label", "vector", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = one.join(of, ["label", "vector"], "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("component_id") == F.col("id")).alias("kept"))
