"""Metadata of entries, map<string, array<string>>, against wanted values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _values(wanted: object) -> list[str] | None:
    if wanted is None:
        return None
    return [str(x) for x in wanted] if isinstance(wanted, (list, tuple, set)) else [str(wanted)]


def _agrees(meta: Column, key: str, values: list[str]) -> Column:
    return F.arrays_overlap(meta[key], F.array(*map(F.lit, values)).cast("array<string>"))


def matches(meta: Column, wanted: dict[str, object]) -> Column:
    """[S3] Every wanted key that the entry declares agrees in a value; keys it lacks, and null wishes, do not count."""
    tests = [F.coalesce(_agrees(meta, k, v), F.lit(True)) for k, w in wanted.items() if (v := _values(w)) is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def overlap(meta: Column, wanted: dict[str, object]) -> Column:
    """[S4] The share of wanted keys that the entry declares with an agreeing value; 0 without wishes."""
    tests = [F.coalesce(_agrees(meta, k, v), F.lit(False)).cast("int") for k, w in wanted.items() if (v := _values(w)) is not None]
    return (reduce(lambda a, b: a + b, tests) / len(tests)).cast("double") if tests else F.lit(0.0)
