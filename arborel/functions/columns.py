"""Columns made of columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


_BLOCK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(x: Column, start: Column, value: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """For each element of x (a column or what let names) the values of those before it joined, from start on. It goes by
    blocks, so that long arrays stay cheap."""
    add = lambda a, r: join(a, value(r))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _BLOCK).cast("int")), lambda b: F.slice(x, b * _BLOCK + 1, F.lit(_BLOCK)))

    def folded(blocks: Column) -> Column:
        return let(F.transform(blocks, lambda b: F.aggregate(b, start, add)), lambda sums: F.flatten(F.transform(blocks, lambda b, i: let(F.aggregate(F.slice(sums, F.lit(1), i), start, lambda a, n: join(a, n)), lambda before: F.transform(b, lambda _, j: F.aggregate(F.slice(b, F.lit(1), j), before, add))))))

    return F.when(F.size(x) > 0, let(blocks, folded)).otherwise(F.array().cast("array<int>"))
