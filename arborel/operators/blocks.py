"""Many queries against all rows: blocks of both meet once each, and the best rows of each query are merged."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborel.functions.batches import best_rows, grouped

#: Groups of a query's results that are ranked before all of them.
SHARES = 32


def _dealt(of: Column, blocks: int, salt: str) -> Column:
    return F.pmod(F.xxhash64(of, F.lit(salt)), F.lit(blocks)).cast("int")


def best_of_blocks(asks: DataFrame, rows: DataFrame, n_asks: int, n_rows: int, score: Callable[[pa.Table, pa.Table], pa.Table], k: int) -> DataFrame:
    """(query, id, raw, rank): the k rows of the highest score of each query, ties by id.

    asks and rows have the same columns, of which id is a query's and a row's own. They are dealt to n_asks and n_rows
    blocks by their ids; a row is sent once for each block of queries, and a query once for each block of rows, whatever
    they score. score gets the queries and the rows of a pair of blocks and gives (query, id, raw) of what may be among
    the best; a task merges what its pairs give. The plan is the same for any number of queries.
    """
    kinds = dict(asks.dtypes)["id"], dict(rows.dtypes)["id"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
    rest = [c for c in rows.columns if c != "id"]
    no = lambda kind: F.lit(None).cast(kind)
    left = asks.select(_dealt(F.col("id"), max(1, n_asks), "q").alias("qb"), every(n_rows).alias("rb"), F.lit(True).alias("ask"), F.col("id").alias("query"), no(kinds[1]).alias("id"), *rest)
    right = rows.select(every(n_asks).alias("qb"), _dealt(F.col("id"), max(1, n_rows), "r").alias("rb"), F.lit(False).alias("ask"), no(kinds[0]).alias("query"), "id", *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        at = None
        for t, b in grouped(batches, ["qb", "rb"]):
            for x, y in zip(b[:-1].tolist(), b[1:].tolist(), strict=True):
                part = t.slice(x, y - x)
                now = part.column("qb")[0].as_py()
                if at not in (None, now) and best is not None:
                    yield from best.to_batches()
                    best = None
                at = now
                asked, held = part.filter(part["ask"]), part.filter(pa.compute.invert(part["ask"]))
                if len(asked) and len(held):
                    some = score(asked, held)
                    best = best_rows(some if best is None else pa.concat_tables([best, some]), k)
        if best is not None:
            yield from best.to_batches()

    found = left.union(right).repartition("qb", "rb").sortWithinPartitions("qb", "rb").mapInArrow(run, f"query {kinds[0]}, id {kinds[1]}, raw double")
    # a task gives k rows of a query at most; those of a query are ranked by shares first
    order = [F.desc("raw"), "id"]
    some = found.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(SHARES)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("query", "share").orderBy(*order))).where(F.col("rank") <= k).drop("rank", "share")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
