"""Tables that jobs write between steps."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table; one of fewer splits than the session has cores is dealt out to them, as a file of a single row group
    would keep all but one idle."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Paths that this process has written for each application.
_paths: dict[str, list[str]] = {}


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-arborel-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, spark.checkpoint.dir. Where it is unset a local session, as in tests, has a
    temporary one; on a cluster, whose executors would write to their own disks, this is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return base or _own_folder()


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    path = f"{shared_folder(spark).rstrip('/')}/arborel-{uuid.uuid4().hex}"
    _paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def discard(spark: SparkSession) -> int:
    """Deletes the tables that this session's jobs have written between steps, and says how many paths these were. For
    the end of a job, when its result is stored: DataFrames that still read such tables fail afterwards."""
    paths = _paths.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        of = spark._jvm.org.apache.hadoop.fs.Path(path)
        of.getFileSystem(spark._jsc.hadoopConfiguration()).delete(of, True)
    return len(paths)


def written(df: DataFrame) -> DataFrame:
    """df, written to the folder that the cluster shares and read again: lineage ends here, and any executor can read it."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
