"""Tables of versions and the stored index: failures, conflicts, what is read, and the same rows as without an index."""

import json
import os

import pytest
from pyspark.sql import functions as F

from arborel.operators import index, lexical
from arborel.sources import versions

SCHEMA = "id int, v string, bucket int"


def rows_of(spark, v):
    return sorted(map(tuple, versions.rows(spark, v).collect()))


def test_upserts_and_deletes_make_versions(spark, tmp_path):
    path = str(tmp_path)
    old = [(i, f"v{i}", i) for i in range(40)]
    first = versions.create(spark.createDataFrame(old, SCHEMA), path, "id", buckets=8)
    assert first.number == 1 and rows_of(spark, first) == old
    with pytest.raises(ValueError, match="already"):
        versions.create(spark.createDataFrame(old, SCHEMA), path, "id")
    new = spark.createDataFrame([(3, 5, "new"), (100, 6, None)], "id long, bucket int, v string")
    with pytest.raises(ValueError, match="exist"):
        versions.upsert(new, path, replace=False)
    with pytest.raises(ValueError, match="more than once"):
        versions.upsert(new.union(new), path, replace=True)
    with pytest.raises(ValueError, match="null"):
        versions.upsert(spark.createDataFrame([(None, "x", 1)], SCHEMA), path, replace=True)
    second = versions.upsert(new, path, replace=True)
    want = sorted([r for r in old if r[0] != 3] + [(3, "new", 5), (100, None, 6)], key=lambda r: r[0])
    assert second.number == 2 and rows_of(spark, second) == want and rows_of(spark, versions.version(spark, path, 1)) == old
    # only the folders of the two keys' buckets are new
    touched = {b for b in second.folders if second.folders[b] != first.folders.get(b)}
    assert touched == versions.buckets_of(new, first)
    third, n = versions.delete(spark.createDataFrame([(100,), (7,), (555,)], "id int"), path)
    assert n == 2 and third.number == 3 and rows_of(spark, third) == [r for r in want if r[0] not in (7, 100)]
    same, n = versions.delete(spark.createDataFrame([(555,)], "id int"), path)
    assert n == 0 and same.number == 3 and versions.numbers(spark, path) == [1, 2, 3]
    fine = versions.upsert(spark.createDataFrame([(900, "x", 1)], SCHEMA), path, replace=False)
    assert fine.number == 4
    with pytest.raises(ValueError, match="no version 9"):
        versions.version(spark, path, 9)
    with pytest.raises(ValueError, match="no version"):
        versions.version(spark, path + "/none")


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path)
    versions.create(spark.range(20).withColumn("v", F.lit("a")), path, "id", buckets=4)
    bad = spark.range(5).select("id", F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise("b").alias("v"))
    with pytest.raises(Exception, match="lost"):
        versions.upsert(bad, path, replace=True)
    assert versions.numbers(spark, path) == [1] and {r.v for r in versions.rows(spark, versions.version(spark, path)).collect()} == {"a"}
    # a marker that was never finished is none
    os.makedirs(f"{path}/versions", exist_ok=True)
    with open(f"{path}/versions/.draft", "w") as f:
        f.write('{"number": 2')
    assert versions.version(spark, path).number == 1
    assert versions.upsert(spark.range(5).withColumn("v", F.lit("c")), path, replace=True).number == 2


def test_of_two_changes_at_once_one_is_a_conflict(spark, tmp_path):
    path = str(tmp_path)
    first = versions.create(spark.range(20).withColumn("v", F.lit("a")), path, "id", buckets=4)
    after = versions.upsert(spark.range(2).withColumn("v", F.lit("b")), path, replace=True)
    late = versions.Version(path, 2, "id", 4, first.schema, first.folders, {})
    with pytest.raises(versions.Conflict):
        versions.commit(spark, late)
    assert versions.version(spark, path).folders == after.folders and len([n for n in os.listdir(f"{path}/versions") if n.endswith(".json") and not n.startswith(".")]) == 2
    assert json.load(open(f"{path}/versions/2.json"))["number"] == 2


def test_only_the_asked_buckets_are_read(spark, tmp_path):
    path = str(tmp_path)
    v = versions.create(spark.range(1000), path, "id", buckets=50)
    asked = versions.buckets_of(spark.range(3), v)
    assert len(asked) <= 3
    files = versions.rows(spark, v, asked).inputFiles()
    assert files and {f.split("bucket=")[1].split("/")[0] for f in files} == {str(b) for b in asked}
    assert versions.rows(spark, v, set()).count() == 0


def test_an_empty_table_and_hot_keys_over_files(spark, tmp_path):
    v = versions.create(spark.createDataFrame([], "id int, m map<string,int>"), f"{tmp_path}/a", "id")
    assert versions.rows(spark, v).count() == 0
    assert versions.rows(spark, versions.upsert(spark.createDataFrame([(1, {"x": 1})], v.schema), f"{tmp_path}/a", replace=False)).count() == 1
    put = versions.put(spark.range(1000).withColumn("k", F.lit(1)), f"{tmp_path}/b", "k", 4, files=5)
    (folder,) = next(iter(put.values()))
    # small files are merged, so five is the most
    assert len(put) == 1 and 1 <= len([f for f in os.listdir(f"{tmp_path}/b/{folder}") if f.endswith(".parquet")]) <= 5
    assert spark.read.parquet(f"{tmp_path}/b/{folder}").count() == 1000


# ---------------------------------------------------------------- index


TEXTS = ["the route logs", "naming the Route", "logs logs logs naming", "", None, "the the the", "one two three four five", "userName logsFor route"]


def searched(spark, path, query, number=None):
    return {r.id: round(r.bm25, 6) for r in index.score_query(spark, path, query, number).collect()}


def scanned(docs, query):
    return {r.id: round(r.bm25, 6) for r in lexical.score_query(docs, "id", F.col("text"), query).collect()}


QUERIES = ["the route logs the", "absent", "", "user four for"]


def test_an_index_gives_what_a_scan_gives_after_every_change(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SEGMENTS", 3)
    path = str(tmp_path)
    have = {i: TEXTS[i % len(TEXTS)] for i in range(30)}
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "id int, text string")
    index.build(frame(have), path, "id", F.col("text"), buckets=5)
    items = spark.createDataFrame(list(enumerate(QUERIES)), "q int, text string")

    def same():
        docs = frame(have)
        assert searched(spark, path, QUERIES[0]) == scanned(docs, QUERIES[0])
        got = sorted(map(tuple, index.score_queries(spark, path, items, "q", F.col("text"), 4).collect()))
        assert got == sorted(map(tuple, lexical.score_queries(docs, "id", F.col("text"), items, "q", F.col("text"), 4).collect()))

    same()
    before = searched(spark, path, QUERIES[0])
    changes = [({3: "route route", 4: "now it has text", 90: "the new logs"}, []), ({}, [0, 3, 90, 777]), ({3: "back again the"}, [5]), ({i: "the" for i in range(6, 12)}, [1])]
    for new, gone in changes:
        index.change(spark, path, new=frame(new) if new else None, id_col="id", text=F.col("text"), gone=spark.createDataFrame([(g,) for g in gone], "id long") if gone else None)
        have = {i: t for i, t in have.items() if i not in gone} | new
        same()
    assert all(searched(spark, path, q) == scanned(frame(have), q) for q in QUERIES[1:])
    last = versions.version(spark, path)
    # the last change merged the segments
    assert last.number == 5 and last.notes["segments"] <= 3 and last.notes["n"] == len(have)
    assert searched(spark, path, QUERIES[0], 1) == before


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    path = str(tmp_path)
    docs = spark.range(200).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("word"), F.col("id"), F.lit(" common")).alias("text"))
    v = index.build(docs, path, "id", F.col("text"), buckets=40)
    terms = spark.createDataFrame([("word7",), ("absent",)], "term string")
    found = index.live_postings(spark, v, terms)
    assert len({f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()}) <= 2
    assert found.where("term = 'word7'").count() == 1


def test_odd_indexes(spark, tmp_path):
    none = spark.createDataFrame([], "id int, text string")
    index.build(none, f"{tmp_path}/a", "id", F.col("text"))
    assert searched(spark, f"{tmp_path}/a", "the") == {}
    items = spark.createDataFrame([(1, "the")], "q int, text string")
    assert index.score_queries(spark, f"{tmp_path}/a", items, "q", F.col("text"), 3).count() == 0
    index.change(spark, f"{tmp_path}/a", new=spark.createDataFrame([(1, "the")], "id int, text string"), id_col="id", text=F.col("text"))
    assert searched(spark, f"{tmp_path}/a", "the") == {1: 1.0}
    for rows in ([(1, "a b"), (1, "c d")], [(None, "a b")]):
        with pytest.raises(ValueError, match="more than once"):
            index.build(spark.createDataFrame(rows, "id int, text string"), f"{tmp_path}/b", "id", F.col("text"))
