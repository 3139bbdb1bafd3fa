"""What the findings of the third round asked for: whole results on tables that are larger than the given ones."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from arborel import registry
from arborel.llm import pii, topics
from arborel.operators import markup
from arborel.sources import conventions
from tests.oracle import database, rows


def same(spark, sf, name):
    got, want = registry.QUERIES[name](spark, sf), database(sf).execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = rows(got.columns, [tuple(r) for r in got.collect()])
    assert got == rows(names, want.fetchall())
    return got


def table(folder, name, select):
    duckdb.sql(f"COPY ({select}) TO '{folder}/{name}.parquet'")
    return str(folder)


def test_first_files_are_500(spark, tmp_path):
    sf = table(tmp_path, "pages", "SELECT i AS page_id, 'http://' || hash(i) AS url, '' AS html FROM range(1200) r(i)")
    assert len(same(spark, sf, "i6_first_files")) == 500


@pytest.mark.parametrize("name", ["i14_empty_lists", "i14_groups", "i13_sink"])
def test_categories_of_several_pages_are_one_row(spark, sf, monkeypatch, name):
    monkeypatch.setattr(conventions, "PAGE", 7)
    same(spark, sf, name)


def test_more_files_than_the_limit(spark, tmp_path):
    sf = table(tmp_path, "documents", "SELECT i * 500 AS doc_id, 'x' AS text, 'en' AS lang, 's' AS source, 1::BIGINT AS n_chars FROM range(600) r(i)")
    assert {r[0] for r in same(spark, sf, "i7_file_counts")} == {1, 500}


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    return sum("Exchange hashpartitioning(page" in line for line in plan.splitlines())


@pytest.mark.parametrize("name", ["a1_exclusive_members", "a3_exclusive_flags", "a4_closed_domains", "a6_unchanged_values", "a7_known_values", "p7_dialects"])
def test_analyses_stay_where_their_orders_are(spark, sf, name):
    """The lines are dealt by orders, once for the trees and once for the dialects of orders; nothing else is shuffled."""
    assert exchanges(registry.QUERIES[name](spark, sf)) <= (1 if name == "p7_dialects" else 2)


def test_attributes_of_many_forms(spark):
    text = """ A = "x'y" b='p"q' c=r a=2 d:e.f-g= "" h i=j/ k=\t"l" """
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(markup.attributes(F.col("t")).alias("a"))
    got = [r.a for r in df.collect()]
    assert got[0] == {"a": "x'y", "b": 'p"q', "c": "r", "d:e.f-g": "", "i": "j/", "k": "l"} and got[2] == {}


def test_topics_and_thresholds_are_of_all_texts(spark):
    """Words that only a few of many texts have weigh as the counts of all texts say; candidates of all texts are counted."""
    words = ["apple pear plum fig", "iron steel zinc tin"]
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, words[0]).otherwise(words[1]).alias("text"))
    df = df.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" rare"))).otherwise(F.col("text")))
    model = topics.fit(df, topics=2)
    at = topics.buckets([b"rare"])[1][0]
    assert model["weights"][at] == pytest.approx(np.log(6001 / 2001), rel=1e-6)
    found = topics.with_topics(df, model).groupBy("topic").count().collect()
    assert sorted(r["count"] for r in found) == [3000, 3000]


def test_every_document_counts_for_the_trees(spark, monkeypatch):
    seen = []
    plain = pii.boost
    monkeypatch.setattr(pii, "boost", lambda X, n, y: seen.append(n.sum()) or plain(X, n, y))
    pii.fit(spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("mail a"), "id", F.lit("@b.com now")).alias("text")))
    assert max(seen) >= 30_000
