"""Captures' columns, empty lists and rule sets, odd vectors, and plans that do not grow with the queries."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborel.functions.vectors import similarity
from arborel.operators import lexical, nodes, rules, similar
from arborel.operators.rules import Rule, before_and_group
from arborel.sources import conventions


@pytest.mark.parametrize("capture", [r"def (\w+)", r"(?i)DEF\s+(\w+)", r"[a-z(]\(?(\w+)\)", r"(\w+)!", r"\((?:a|b)(c+)", r"(?:x|é)+ ([^ ]+) (y)", r"[](]([a-c])"])
def test_captures_stand_where_they_are(spark, capture):
    texts = ["def d", "def é def  foo", "d def d", "(ac (bccc xé q y", "x!y!!", "(a)(b) ](c", "", None, "Def X(y) def def def"]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "id int, lang string, text string")
    rule = Rule("r", "naming", "never", "m", capture=capture)
    got = sorted((r.id, r.start_col, r.snippet) for r in rules.violations(docs, nodes.line_nodes(docs, "text", "id", "lang"), [rule], "id", "lang").collect())
    want = sorted((i, len(t[: m.start(1)].encode()), m.group(1)) for i, t in enumerate(texts) if t for m in re.finditer(capture, t, re.ASCII))
    assert got == want


@pytest.mark.parametrize("capture", ["def", "(?:a(b))", "(a)|b", r"(a)\1", "(a)(b)|c"])
def test_captures_without_a_place(capture):
    with pytest.raises(ValueError):
        before_and_group(capture)
    with pytest.raises(ValueError):
        Rule("r", "naming", "x", "m", capture=capture)


def test_no_rules(spark):
    docs = spark.createDataFrame([(1, "en", "x\ny"), (2, None, None)], "id int, lang string, text string")
    found = rules.violations(docs, nodes.line_nodes(docs, "text", "id", "lang"), [], "id", "lang")
    assert found.collect() == [] and found.columns == ["id", "rule_id", "message", "severity", "start_line", "start_col", "snippet"]
    assert all(r.passed and r.rule_ids == "" for r in rules.report(docs, found, "id").collect())
    assert all(r.passed and r.checked_rules == r.violations == [] for r in rules.reports(docs, found, [], "id", "lang").collect())
    assert [r.rule_ids for r in rules.applicable_to(docs, [], "id", F.col("lang"), F.create_map().cast("map<string,array<string>>")).collect()] == [[], []]


def test_empty_lists_in_convention_files(spark, tmp_path):
    entry = lambda i, meta: {"id": i, "language": "py", "good_example": "x", "metadata": meta}
    entries = [entry("a", {"category": [], "tags": []}), entry("b", {"category": ["c", "d"]}), entry("c", {"category": "c", "tags": ["t"]}), entry("d", {}), entry("e", {"category": None, "tags": [None]}), entry("f", {"category": ""})]
    (tmp_path / "x.json").write_text(json.dumps(entries))
    found = conventions.quarantined(conventions.read(spark, str(tmp_path)))
    got = {r.id: (r.meta, r.error) for r in found.collect()}
    assert got["a"] == ({"category": [], "tags": []}, None) and got["c"][0] == {"category": ["c"], "tags": ["t"]} and all(e is None for _, e in got.values())
    groups = {r.slug: [e.id for e in r.entries] for r in conventions.groups(found).collect()}
    assert groups == {"uncategorized": ["a", "d", "e", "f"], "c": ["b", "c"]}
    assert conventions.exported_groups(found, str(tmp_path / "out")) and spark.read.text(str(tmp_path / "out")).count() == 2


def test_large_categories_go_on_pages(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(conventions, "PAGE", 7)
    entries = [{"id": f"e{i:03}", "language": "py", "good_example": "x", "metadata": {"category": "big" if i < 90 else "small"}} for i in range(95)]
    (tmp_path / "x.json").write_text(json.dumps(entries))
    found = conventions.quarantined(conventions.read(spark, str(tmp_path)))
    got = conventions.groups(found).collect()
    big = [r for r in got if r.slug == "big"]
    assert {(r["count"], r.pages) for r in big} == {(90, 13)}
    assert len(big) > 6 and sorted(e.id for r in big for e in r.entries) == [f"e{i:03}" for i in range(90)]
    assert all([e.id for e in r.entries] == sorted(e.id for e in r.entries) for r in big) and len([r for r in got if r.slug == "small"]) == 1


NAN, INF = float("nan"), float("inf")
VECTORS = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [NAN, 1.0]), (3, [None, 1.0]), (4, [1.0, -INF]), (5, None), (6, []), (7, [1.0]), (8, [-1.0, 0.0]), (None, [1.0, 1.0]), (9, [0.5, 0.5])]


def test_odd_vectors_are_in_no_result(spark):
    df = spark.createDataFrame(VECTORS, "id long, v array<double>")
    got = similar.similar(df, F.col("id") < 8, id_col="id", vector_col="v", k=3)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 0.5), (0, 2, 9, 0.5), (0, 3, 8, 0.0), (1, 1, 0, 0.5), (1, 2, 9, 0.5), (1, 3, 8, 0.0)]
    asked = df.where("id is not null").select("id", similarity(F.col("v"), F.array(F.lit(1.0), F.lit(0.0))).alias("s")).collect()
    assert {r.id: r.s for r in asked} == {0: 1.0, 1: 0.5, 2: None, 3: None, 4: None, 5: None, 6: None, 7: None, 8: 0.0, 9: 0.5}
    assert similar.similar(df, F.lit(False), id_col="id", vector_col="v", k=3).count() == 0
    assert similar.similar(df.where("false"), F.lit(True), id_col="id", vector_col="v", k=3).count() == 0


def operators_of(df):
    return sorted(re.findall(r"[A-Z]\w+", re.sub(r"#\d+L?|\d+", "", df._jdf.queryExecution().simpleString())))


def test_plans_of_many_queries_are_those_of_few(spark, monkeypatch):
    monkeypatch.setattr(similar, "BATCH", 7)
    monkeypatch.setattr(similar, "BLOCK", 50)
    monkeypatch.setattr(lexical, "BATCH_TERMS", 20)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 60)
    rng = np.random.default_rng(3)
    X = np.round(rng.normal(size=(400, 6)), 2)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, v array<double>")
    few, many = (similar.similar(df, F.col("id") % n == 0, id_col="id", vector_col="v", k=5) for n in (200, 2))
    assert operators_of(few) == operators_of(many)
    raw = np.round(np.clip(X @ X.T, 0, 1), 6)
    want = {(q, n, i, raw[q, i]) for q in range(0, 400, 2) for n, i in enumerate(sorted((i for i in range(400) if i != q), key=lambda i: (-raw[q, i], i))[:5], 1)}
    assert set(map(tuple, many.collect())) == want

    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, rng.integers(0, 9)))) for i in range(150)], "id int, t string")
    items = lambda n: spark.createDataFrame([(i, " ".join(rng.choice(words, 3))) for i in range(n)], "q int, qt string")
    asked = items(200)
    few, many = (lexical.score_queries(docs, "id", F.col("t"), of, "q", F.col("qt"), 4) for of in (items(2), asked))
    assert operators_of(few) == operators_of(many)
    got = {}
    for r in many.collect():
        got.setdefault(r.q, []).append((r["rank"], r.id, r.raw))
    for q, t in asked.where("q < 6").collect():
        best = lexical.score_query(docs, "id", F.col("t"), t).orderBy(F.desc(F.round("bm25", 6)), "id").limit(4).collect()
        assert [i for _, i, _ in sorted(got[q])] == [r.id for r in best]
        assert all(abs(raw / max(x[2] for x in got[q]) - r.bm25) < 1e-5 for (_, _, raw), r in zip(sorted(got[q]), best, strict=True))
