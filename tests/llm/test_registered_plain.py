"""The registered queries without SQL against plain versions, on the smallest tables."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arborel.llm import hmm, langid, mixing, registry, topics, toxicity, urls
from tests.llm.test_plain_versions import check_language_model, plain_language, plain_mixing, plain_toxicity
from tests.llm.test_vectors_urls_pipeline import plain, plain_distrust, plain_ranks


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def kept_models(monkeypatch, module, name):
    """What a function of a module gives from now on."""
    made, models = getattr(module, name), []
    monkeypatch.setattr(module, name, lambda *a, **b: models.append(made(*a, **b)) or models[-1])
    return models


def test_language_model(spark, sf, docs, monkeypatch):
    models = kept_models(monkeypatch, hmm, "trained")
    got = registry.QUERIES["op2_hmm"](spark, sf).collect()
    check_language_model(got, {r.doc_id: r.text for r in docs}, lambda i: fold(i, 7) == 2, models)


def test_mixing(spark, sf, docs, monkeypatch):
    models = kept_models(monkeypatch, topics, "fit")
    got = {r.doc_id: r for r in registry.QUERIES["op4_mixing"](spark, sf).collect()}
    want = plain_mixing([(r.doc_id, r.text, r.source, r.lang) for r in docs], models[-1])
    assert len(got) == len(docs) and len({c[2] for c, *_ in want}) > 2
    for r, (cell, n, p, draw) in zip(docs, want, strict=True):
        x = got[r.doc_id]
        assert (x.source or mixing.NONE, x.lang or mixing.NONE, x.topic, x.n_tokens) == (*cell, n) and abs(x.probability - p) < 2e-3 and x.weight == 1
        assert x.sampled == (draw < p) or abs(draw - p) < 2e-3


def test_urls(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in registry.QUERIES["op5_urls"](spark, sf).collect()}
    judged = {r.page_id: plain(r.url) for r in pages}
    count, allowed, blocked, links = Counter(), Counter(), Counter(), Counter()
    for r in pages:
        h, _, rule = judged[r.page_id]
        if not h:
            continue
        count[h] += 1
        allowed[h] += bool(rule and rule[1] == "allow")
        blocked[h] += bool(rule and rule[1] == "block")
        for m in re.finditer(r"""href\s{0,8}=\s{0,8}["']?((?:https?:)?//[^"'\s<>]+)""", r.html or "", re.I):
            to = plain("x://" + re.sub(r"^(?:https?:)?//", "", m.group(1), flags=re.I))[0]
            if to and to != h:
                links[h, to] += 1
    for h, n in count.items():
        if h.count(".") >= 2:
            up = h.split(".", 1)[1]
            links[h, up] += n
            links[up, h] += n
    edges = [(a, b, n) for (a, b), n in links.items()]
    trust = plain_ranks(edges, count, {h: allowed[h] / n for h, n in count.items()})
    distrust = plain_distrust(edges, count, {h: blocked[h] / n for h, n in count.items()})
    assert len(got) == len(pages)
    for i, (h, path, rule) in judged.items():
        r = got[i]
        assert (r.host, r.path, r.rule) == (h, path, rule and rule[0])
        t, d = trust.get(h, 0.0), distrust.get(h, 0.0)
        assert abs(r.trust - t) < 1e-3 and abs(r.distrust - d) < 1e-3
        if rule:
            assert r.verdict == rule[1]
        elif abs(d - urls.SHARE) > 1e-3 and abs(d - t) > 1e-3:
            assert r.verdict == ("block" if d > t and d >= urls.SHARE else "allow")


def test_toxicity(spark, sf, docs, monkeypatch):
    models = kept_models(monkeypatch, toxicity, "fit")
    got = {r.doc_id: r for r in registry.QUERIES["op6_toxicity"](spark, sf).collect()}
    assert len(got) == len(docs)
    for r in docs:
        x = got[r.doc_id]
        score = plain_toxicity(models[-1], r.text)[0]
        assert math.isclose(x.score, score, abs_tol=1e-6) and x.predicted == (x.score >= 0.3) and x.held_out == (fold(r.doc_id, 4) == 2)


def test_languages(spark, sf, docs, monkeypatch):
    models = kept_models(monkeypatch, langid, "fit")
    got = {r.doc_id: r for r in registry.QUERIES["op9_language"](spark, sf).collect()}
    assert len(got) == len(docs)
    for r in docs:
        x = got[r.doc_id]
        assert x.held_out == (fold(r.doc_id, 5) == 0)
        if not any(map(str.isalpha, r.text or "")):
            assert (x.lang_pred, x.score) == ("und", 0)
        elif len(r.text) < 1500:
            lang, score = plain_language(models[-1], r.text)
            assert x.lang_pred == lang and abs(x.score - score) < 0.02
    held = [r for r in docs if got[r.doc_id].held_out and r.lang is not None and any(map(str.isalpha, r.text or ""))]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.9 * len(held) > 0


def test_columns_that_more_than_one_query_adds(spark, sf):
    """Scores lie within 0 and 1, and nothing is null that should not be."""
    for name in ("op6_toxicity", "op9_language", "op13_quality"):
        assert registry.QUERIES[name](spark, sf).where(~F.col("score").between(0, 1) | F.col("score").isNull()).count() == 0
