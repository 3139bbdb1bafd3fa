"""Vectors and feature hashing as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: dimensions of a fingerprint.
DIM = 256


def _product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    """In double precision; vectors of different lengths are an error."""
    return F.when(F.size(a) == F.size(b), _product(a, b)).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def finite(vector: Column) -> Column:
    """[V1, V3] Whether a vector is there and all its components are finite numbers; a search leaves the others out."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)), F.lit(False))


def comparable(a: Column, b: Column) -> Column:
    """[V1, V3] Whether two vectors are finite and of one length; a scan leaves the others out."""
    return F.coalesce(F.size(a) == F.size(b), F.lit(False)) & finite(a) & finite(b)


def similarity(a: Column, b: Column) -> Column:
    """[V1] The inner product within 0 and 1; null if the vectors are not comparable."""
    return F.when(comparable(a, b), F.least(F.lit(1.0), F.greatest(F.lit(0.0), _product(a, b))))


def feature_index(feature: Column) -> Column:
    """First four bytes of the feature's MD5, modulo DIM."""
    return (F.conv(F.substring(F.md5(feature), 1, 8), 16, 10).cast("long") % DIM).cast("int")


def feature_sign(feature: Column) -> Column:
    """1 if the fifth byte is odd, else -1."""
    return F.when(F.conv(F.substring(F.md5(feature), 9, 2), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)
