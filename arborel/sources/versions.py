"""Tables in a folder that change by whole versions: rows are dealt to buckets by a key, a change rewrites the buckets it
touches, and a version counts from when its marker is there.

    folder/data/<name>/bucket=<n>/*.parquet     rows of one bucket, never changed
    folder/versions/<number>.json               which of these folders the version is made of

The marker is written last, under a name of its own, and moved to its place, which fails if another change was faster.
What a change that failed has left is in no marker; readers keep seeing the version before. Spark does the work on rows;
the driver holds the names of folders only, of which there are as many as buckets and changes since.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a new table, if nothing else is asked for.
BUCKETS = 32


class Conflict(Exception):
    """Another change has made the version that this one was about to make."""


@dataclass(frozen=True)
class Version:
    """number, and of each bucket the folders with its rows; notes: what else the writer keeps of the version."""

    path: str
    number: int
    key: str
    buckets: int
    schema: StructType
    folders: dict[int, list[str]]
    notes: dict = field(default_factory=dict)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _context(spark: SparkSession, path: str):
    jvm = spark._jvm
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.org.apache.hadoop.fs.Path(path).toUri(), spark._jsc.hadoopConfiguration())


def _file_system(spark: SparkSession, path: str):
    of = spark._jvm.org.apache.hadoop.fs.Path(path)
    return of, of.getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The versions that are there, in order."""
    of, fs = _file_system(spark, f"{path}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(of)] if fs.exists(of) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The last version, or the one of the number."""
    have = numbers(spark, path)
    if not have or number not in (None, *have):
        raise ValueError(f"{path} has no version" + (f" {number}" if have else ""))
    of, fs = _file_system(spark, f"{path}/versions/{have[-1] if number is None else number}.json")
    with_ = spark._jvm.org.apache.commons.io.IOUtils
    stream = fs.open(of)
    try:
        m = json.loads(with_.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Version(path, m["number"], m["key"], m["buckets"], StructType.fromJson(m["schema"]), {int(b): f for b, f in m["folders"].items()}, m["notes"])


def commit(spark: SparkSession, v: Version) -> Version:
    """Makes v the table's next version, or raises Conflict if there is one of its number by now."""
    marker = {"number": v.number, "key": v.key, "buckets": v.buckets, "schema": v.schema.jsonValue(), "folders": v.folders, "notes": v.notes}
    draft, place = (spark._jvm.org.apache.hadoop.fs.Path(f"{v.path}/versions/{name}") for name in (f".{uuid.uuid4().hex}", f"{v.number}.json"))
    fs = draft.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(draft, False)
    out.write(json.dumps(marker).encode())
    out.close()
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        _context(spark, v.path).rename(draft, place, none)
    except Exception as e:
        if not fs.exists(place):
            raise
        fs.delete(draft, False)
        raise Conflict(f"{v.path} has a version {v.number} already") from e
    return v


def put(df: DataFrame, path: str, key: str, buckets: int, files: int = 1) -> dict[int, list[str]]:
    """Writes df by buckets of its key into a new folder, and gives the folders. Each bucket has up to so many files, which
    split what rows of one key would else put into one task."""
    spark, name, at = df.sparkSession, uuid.uuid4().hex, "bucket"
    while at in df.columns:
        at += "_"
    own = f"{path}/data/{name}"
    spread = F.pmod(F.xxhash64(*(f"`{c}`" for c, t in df.dtypes if "map<" not in t)), F.lit(files))
    of = df.withColumn(at, bucket_of(F.col(key), buckets))
    of.repartition(at, spread).sortWithinPartitions(at, key).write.partitionBy(at).parquet(own)
    place, fs = _file_system(spark, own)
    found = [s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory()]
    return {int(n.split("=")[1]): [f"data/{name}/{n}"] for n in sorted(found) if n.startswith(f"{at}=")}


def rows(spark: SparkSession, v: Version, buckets: set[int] | None = None) -> DataFrame:
    """The rows of a version, of some buckets only if they are given: folders of others are never looked at."""
    folders = [f"{v.path}/{f}" for b, of in sorted(v.folders.items()) if buckets is None or b in buckets for f in of]
    return spark.read.schema(v.schema).parquet(*folders) if folders else spark.createDataFrame([], v.schema)


def buckets_of(df: DataFrame, v: Version) -> set[int]:
    """The buckets that hold the keys of df, at most all."""
    return {r[0] for r in df.select(bucket_of(F.col(v.key).cast(v.schema[v.key].dataType), v.buckets)).distinct().collect()}


def create(df: DataFrame, path: str, key: str, *, buckets: int = BUCKETS, files: int = 1, notes: dict | None = None) -> Version:
    """A new table with the rows of df, as version 1."""
    if numbers(df.sparkSession, path):
        raise ValueError(f"{path} is a table already")
    return commit(df.sparkSession, Version(path, 1, key, buckets, df.schema, put(df, path, key, buckets, files), notes or {}))


def upsert(new: DataFrame, path: str, *, replace: bool, notes: dict | None = None) -> Version:
    """[I11] The next version: new takes the place of rows with its keys. A key that is there already is an error unless
    replace is set, and so are two new rows with one key, or a null key. Only buckets with a new key are read and written."""
    spark = new.sparkSession
    v = version(spark, path)
    new = new.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in v.schema))
    if not new.groupBy(v.key).count().where((F.col("count") > 1) | F.col(v.key).isNull()).isEmpty():
        raise ValueError("a key is null or comes more than once")
    touched = buckets_of(new, v)
    old = rows(spark, v, touched)
    if not replace and not old.join(new.select(v.key), v.key, "left_semi").isEmpty():
        raise ValueError("some ids already exist")
    return _changed(v, touched, old.join(new.select(v.key), v.key, "left_anti").unionByName(new), notes)


def delete(gone: DataFrame, path: str, *, notes: dict | None = None) -> tuple[Version, int]:
    """[I12] The next version, without the keys of gone, and how many rows that takes away; with none there is no new
    version."""
    spark = gone.sparkSession
    v = version(spark, path)
    touched = buckets_of(gone, v)
    old, keys = rows(spark, v, touched), gone.select(F.col(v.key).cast(v.schema[v.key].dataType).alias(v.key))
    n = old.join(keys, v.key, "left_semi").count()
    return (_changed(v, touched, old.join(keys, v.key, "left_anti"), notes) if n else v), n


def _changed(v: Version, touched: set[int], df: DataFrame, notes: dict | None) -> Version:
    kept = {b: f for b, f in v.folders.items() if b not in touched}
    made = put(df.select(v.schema.names), v.path, v.key, v.buckets)
    return commit(df.sparkSession, Version(v.path, v.number + 1, v.key, v.buckets, v.schema, kept | made, v.notes if notes is None else notes))
