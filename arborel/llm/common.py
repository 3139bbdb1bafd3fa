"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborel.functions.batches import grouped  # noqa: F401
from arborel.sources.tables import load as table  # noqa: F401
from arborel.sources.tables import written as stored  # noqa: F401


def dealt(df: DataFrame) -> DataFrame:
    """df, dealt out evenly. A sum over a key is small but lies where the key's rows are; dealt out anew, it makes a join
    with those rows shuffle both sides, and Spark can split a key of very many rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fold(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo buckets; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(buckets)


def text_chunks(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about most_bytes of text each (one text at least), so that Python objects stay few."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if len(column) == 0:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // most_bytes, prepend=0)) if sizes.sum() > most_bytes else []
        bounds = sorted({0, *map(int, cut), len(column)})
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield batch.slice(a, b - a)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def drawn(sample: DataFrame, lists: list[str]) -> list[tuple[object, list[np.ndarray]]]:
    """The rows (draw, label, lists) of a bounded sample on the driver, in the order of their draw: label and arrays."""
    t = sample.toArrow().sort_by([(sample.columns[0], "ascending"), (sample.columns[1], "ascending")]).combine_chunks()
    labels = t.column(1).to_pylist()
    arrays = []
    for name in lists:
        column = t.column(name).combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
        arrays.append([values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    return [(label, [a[i] for a in arrays]) for i, label in enumerate(labels)]


def vector_blocks(t: pa.Table, name: str) -> np.ndarray:
    """A column of lists of equal length as a matrix in double precision."""
    column = t.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(t), -1)


def finite(vector: Column) -> Column:
    """Whether a vector is not null or empty, and all its components are finite numbers."""
    every = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.coalesce((F.size(vector) > 0) & every, F.lit(False))


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite numbers, not all zero."""
    return finite(vector) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


#: Bits of the filter of among, and of one of its rows.
ID_BITS, _ID_ROW = 1 << 24, 1 << 15


def among(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose id may be among ids (one column): all that are and, as ids go to ID_BITS bits by their hashes, a
    few others. The bits are broadcast, so that a join with ids need not shuffle what has no partner. Ids of a type whose
    equal values may have unequal hashes, or of two types, are not filtered."""
    key = ids.columns[0]
    if dict(df.dtypes)[id_col] != dict(ids.dtypes)[key] or dict(df.dtypes)[id_col] not in ("int", "bigint", "string"):
        return df
    at = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(ID_BITS))
    row, bit = lambda c: F.floor(at(c) / _ID_ROW).cast("int"), lambda c: at(c) % _ID_ROW
    bits = ids.select(row(key).alias("_row"), bit(key).alias("_bit")).repartition("_row").groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring(bits["_bits"], F.floor(bit(id_col) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return df.join(F.broadcast(bits), (row(id_col) == bits["_row"]) & (F.getbit(byte, (bit(id_col) % 8).cast("int")) == 1), "left_semi")


#: Groups of tasks whose vectors are summed before those of all, and numbers of a piece.
SHARES, PIECE = 64, 2048
PARTS = "piece int, share int, part binary"


def pieces(total: np.ndarray) -> pa.RecordBatch:
    """A task's vector of doubles, cut into pieces that added_up sums over all tasks."""
    cut = [total[a : a + PIECE].tobytes() for a in range(0, len(total), PIECE)]
    share = TaskContext.get().partitionId() % SHARES
    return pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([share] * len(cut), pa.int32()), pa.array(cut, pa.binary())], names=["piece", "share", "part"])


def added_up(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of the tasks' vectors of a fixed size, made of PARTS: each piece is summed over tasks, first those of
    SHARES groups of tasks. The driver gets one vector."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for *key, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(part)
                sums[tuple(key)] = sums[tuple(key)] + x if tuple(key) in sums else x
        piece, share = zip(*sums, strict=True) if sums else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(share, pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["piece", "share", "part"])

    sums = parts.repartition("piece", "share").mapInArrow(add, PARTS)
    rows = sums.withColumn("share", F.lit(0)).repartition("piece").mapInArrow(add, PARTS).collect()
    return np.concatenate([np.frombuffer(r["part"]) for r in sorted(rows)]) if rows else np.zeros(size)
