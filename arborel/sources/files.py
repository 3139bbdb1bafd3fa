"""Source trees as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborel.functions.languages import language_of_path
from arborel.sources.tables import written

# Folders that a scan leaves out.
SKIPPED = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "target", ".next", ".tox", "vendor")


def scan(spark: SparkSession, root: str, language: str | None = None, most: int | None = None) -> DataFrame:
    """[I3-I7] (path, language, code) of the files under root in a known language; code is null for what isn't UTF-8.

    Folders count from the root on, so a root inside a skipped folder can be read. most: the first so many by path.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    below = F.element_at(F.split("path", f"\\Q{base}\\E/", 2), -1)
    of = raw.withColumn("language", language_of_path(F.col("path"))).where("language is not null")
    of = of.where(~F.arrays_overlap(F.split(below, "/"), F.array(*map(F.lit, SKIPPED))))
    of = of if language is None else of.where(F.col("language") == language)
    code = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    of = of.select("path", "language", code.alias("code"))
    return of if most is None else of.orderBy("path").limit(most)


def counted(found: DataFrame, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """[I6, I7] The files of a scan that are read, and one row (files, skipped): the first most by path count as files;
    those beyond, and those of them that are no UTF-8, as skipped."""
    of = written(found.select("path").orderBy("path").limit(most)).withColumn("_within", F.lit(True))
    marked = found.join(of, "path", "left")
    files = F.count_if(F.col("_within")).alias("files")
    return marked.where("_within and code is not null").drop("_within"), marked.agg(files, F.count_if(F.col("_within").isNull() | F.col("code").isNull()).alias("skipped"))
