"""Whitening, ranked search and quality against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborel.llm import gam, ranked, registry, whitening

NAN, INF = float("nan"), float("inf")

# ---------------------------------------------------------------- whitening


def plain_whitening(vectors, most=8):
    """(id, component) -> (deviation, whitened, explained), whole numbers by Python's, components by numpy."""
    x = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in vectors]
    n, S = len(x), [sum(c) for c in zip(*(v for _, v in x), strict=True)]
    far = [sum((n * c - s) ** 2 for c, s in zip(v, S, strict=True)) for _, v in x]
    Y = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, S, strict=True)] for _, v in x])
    e, U = np.linalg.eigh(Y.T @ Y / n)
    e, U = e[::-1], U.T[::-1]
    k = min(most, int((e > 1e-9 * e[0]).sum())) if e[0] > 0 else 0
    return {(i, j + 1): (d, Y[row] @ U[j] / math.sqrt(e[j]), e[j] / e.sum()) for row, ((i, _), d) in enumerate(zip(x, far, strict=True)) for j in range(k)}


def check_whitened(got, want, n):
    assert len(got) == len(want)
    sign = {}
    for r in got:
        deviation, w, explained = want[r.vec_id, r.component]
        assert r.deviation == deviation and r.n == n and math.isclose(r.explained, explained, rel_tol=1e-9)
        sign[r.component] = sign.get(r.component) or (1 if r.whitened * w >= 0 else -1)
        assert abs(abs(r.whitened) - abs(w)) < 1e-7 and (abs(w) < 1e-6 or r.whitened * w * sign[r.component] > 0)
    assert all(0 <= r.identity_error < 1e-9 for r in got)


def test_registered_whitening_is_the_plain_one(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = registry.QUERIES["op11_whitening"](spark, sf).collect()
    check_whitened(got, plain_whitening([(r.vec_id, r.embedding) for r in rows]), len(rows))


def test_vectors_that_take_no_part_in_whitening(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5)) * 3
    X[:, 4] = 7.0  # no variance
    good = [(i, x.tolist()) for i, x in enumerate(X)] + [(3, X[3].tolist()), (70, [0.0] * 5)]
    odd = [(100, None), (101, []), (102, [NAN, 1.0, 1.0, 1.0, 1.0]), (103, [1.0, INF, 1.0, 1.0, 1.0]), (104, [1.0, None, 1.0, 1.0, 1.0]), (105, [1.0, 2.0]), (106, [1e300] * 5)]
    df = spark.createDataFrame([(*r, 1, "c") for r in good + odd], "vec_id int, embedding array<double>, n int, whitened string").repartition(3)
    got = whitening.whiten(df).collect()
    want = plain_whitening(good)
    check_whitened([r for r in got if r.vec_id != 3], {k: v for k, v in want.items() if k[0] != 3}, len(good))
    assert {r.component for r in got} == {1, 2, 3, 4, 5} and Counter(r.vec_id for r in got)[3] == 10
    null_id = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (1, [3.0, 5.0])], "vec_id int, embedding array<double>")).collect()
    assert [(r.vec_id, r.component) for r in sorted(null_id, key=lambda r: r.vec_id or 0)] == [(None, 1), (1, 1)]


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, None), (2, [NAN])]])
def test_nothing_to_whiten(spark, rows):
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whole_numbers_beyond_64_bits(spark):
    big = [(i, [v * 1e12, v * -3e12, float(i)]) for i, v in enumerate([1.0, -2.0, 0.5, 4.0])]
    got = whitening.whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()
    want = plain_whitening(big)
    assert {r.deviation for r in got} == {None} and {r.n for r in got} == {4}
    assert all(abs(abs(r.whitened) - abs(want[r.vec_id, 1][1])) < 1e-6 for r in got if r.component == 1)
    wide = [(i, [v * 2e5, 0.0]) for i, v in enumerate([1.0, -2.0, 0.5, 0.75])]
    got = whitening.whiten(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).collect()
    check_whitened(got, plain_whitening(wide), 4)
    assert max(r.deviation for r in got) > 1 << 60


def test_factor_and_rotations():
    rng = np.random.default_rng(1)
    for d, rank in ((1, 1), (7, 7), (12, 5), (40, 40)):
        X = rng.normal(size=(60, rank)) @ rng.normal(size=(rank, d)) * rng.uniform(0.01, 100, d)
        C = X.T @ X
        L, order = whitening.pivoted_cholesky(C)
        assert L.shape == (d, rank) and np.allclose(np.triu(L, 1), 0) and np.allclose(L @ L.T, C[np.ix_(order, order)], rtol=0, atol=1e-9 * C.max())
        e, U = whitening.components(C)
        assert np.allclose(e, np.linalg.eigvalsh(C)[::-1][:rank], rtol=1e-9) and np.allclose(U @ U.T, np.eye(rank), atol=1e-12)
        assert np.allclose(U @ C @ U.T, np.diag(e), atol=1e-12 * e[0])
    assert whitening.components(np.zeros((3, 3)))[0].tolist() == []
    e, _ = whitening.components(np.eye(6))
    assert np.allclose(e, 1)


# ---------------------------------------------------------------- ranked search


def plain_search(docs, items, k=50):
    term = re.compile(ranked.TERM)
    low = str.maketrans(ranked._UPPER, ranked._LOWER)
    words = [(i, Counter(term.findall((t or "").translate(low)))) for i, t in docs]
    N, L = sum(bool(c) for _, c in words), sum(sum(c.values()) for _, c in words)
    df = Counter(t for _, c in words for t in c)
    w = {t: math.floor(1000 * math.log((2 * N + 2) / (2 * n + 1))) for t, n in df.items()}
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(term.findall((t or "").translate(low)))
    out = set()
    for item, of in asked.items():
        scores = []
        for i, c in words:
            m = 100 - 50 + 50 * sum(c.values()) * N // L if L else 50
            s = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in of if t in c)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out |= {(item, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    # frequent and rare words, copies, ties
    vocabulary = [f"w{i}" for i in range(400)] + ["Ünï", "日本", "x9"]
    weights = [1 / (1 + i) for i in range(len(vocabulary))]
    docs = [(i, rng.choice(" ,-\t").join(rng.choices(vocabulary, weights, k=rng.randint(1, 60)))) for i in range(900)]
    docs += [(2000 + i, docs[5][1]) for i in range(70)] + [(3000, None), (3001, ""), (3002, " .,;"), (3003, "W1 " * 20_000 + "w399"), docs[9], docs[9], (None, "w7 w8 w9")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(25)]
    items += [(100, docs[5][1]), (101, None), (102, "notthere"), (103, " "), (104, "W0,w0 w1"), (None, "w1"), (105, "w3"), (105, "w4 w5"), (106, "ÜNÏ ünï Ünï 日本 é"), (107, " ".join(vocabulary))]
    return docs, items


@pytest.mark.parametrize("blocks", [(ranked.POSTINGS, ranked.ASKED, 1 << 24), (300, 40, 1 << 15)])
def test_search_is_the_plain_one(spark, corpus, monkeypatch, blocks):
    """Also with a filter that passes most terms, and many blocks of both."""
    monkeypatch.setattr(ranked, "POSTINGS", blocks[0])
    monkeypatch.setattr(ranked, "ASKED", blocks[1])
    monkeypatch.setattr(ranked, "FILTER_BITS", blocks[2])
    docs, items = corpus
    df = spark.createDataFrame([(*d, 1, "b") for d in docs], "doc_id long, text string, score int, item_id string").repartition(5)
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    got = ranked.search(df, asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    found = [tuple(r) for r in got.collect()]
    want = plain_search(docs, items)
    assert len(found) == len(want) and set(found) == want
    assert set(map(tuple, ranked.search(df, asked, k=3).collect())) == plain_search(docs, items, 3)


def test_search_of_empty_tables(spark, corpus):
    none = spark.createDataFrame([], "doc_id long, text string, item_id long")
    some = spark.createDataFrame([(*d, 1) for d in corpus[0][:5]], "doc_id long, text string, item_id long")
    assert ranked.search(none, none).count() == ranked.search(some, none).count() == ranked.search(none, some).count() == 0


def test_accumulators_stop_and_survivors_are_exact():
    """With a bound in hand frequent terms make no accumulators: what is found is what a full sum finds."""
    import pyarrow as pa

    rng = random.Random(3)
    lists = [sorted({f"t{int(30 * rng.random() ** 3)}" for _ in range(8)}) for _ in range(500)]
    docs = pa.table({"id": pa.array(range(500), pa.int64()), "m": pa.array([100] * 500, pa.int64()), "terms": pa.array(lists, pa.list_(pa.string())), "nums": pa.array([[1] * len(x) for x in lists], pa.list_(pa.int64()))})
    names = [f"t{i}" for i in range(29, -1, -1)]
    asks = pa.table({"id": pa.array([1], pa.int64()), "terms": pa.array([names], pa.list_(pa.string())), "nums": pa.array([[10 * i + 1 for i in range(29, -1, -1)]], pa.list_(pa.int64()))})
    block = ranked.Block(docs, asks)
    full = np.array([sum((10 * int(t[1:]) + 1) * (10**9 // 3000) for t in x) for x in lists])
    least = int(np.sort(full)[-20])
    scores, ids = block.best(0, 20, 0)
    want = ranked.first_k(full, np.arange(500), 20)
    assert all((a == b).all() for a, b in zip(ranked.first_k(scores, ids, 20), want, strict=True))
    assert (full[ids] >= scores).all() and len(ids) < 500
    scores, ids = block.best(0, 20, least)
    assert sorted(ids.tolist()) == np.flatnonzero(full >= least).tolist() and (full[ids] == scores).all()


# ---------------------------------------------------------------- quality


def plain_features(t):
    t = t or ""
    raw = t.encode()
    words = re.findall(rb"[^\t\n\x0b\x0c\r ]+", raw)
    size, chars = max(len(words), 1), max(len(t), 1)
    upper, lower = len(re.findall("[A-Z]", t)), len(re.findall("[a-z]", t))
    wide = len(re.findall(r"[^\x00-\x7f]", t))
    letters = upper + lower + wide
    inside = [len(re.findall(rb"[A-Za-z\x80-\xff]", w)) for w in words]
    low = [w.lower() for w in words]
    pairs = list(zip(low[:-1], low[1:], strict=True))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = sum(w[-1:] in (b".", b",", b";", b":") for w in words)
    odd = re.compile(rb"[^A-Za-z.,;:\x80-\xff]$")
    return [
        math.log1p(len(t)),
        math.log1p(len(words)),
        upper / max(letters, 1),
        len(re.findall("[0-9]", t)) / chars,
        len(re.findall("[.,;:]", t)) / size,
        len(re.findall("[!?'\"()-]", t)) / size,
        len(re.findall(r"[^A-Za-z0-9.,;:!?'\"()\t\n\x0b\x0c\r \x80-\U0010ffff-]", t)) / size,
        len(re.findall("[\t\n\x0b\x0c\r ]", t)) / chars,
        wide / max(letters, 1),
        letters / chars,
        sum(map(len, words)) / size,
        sum(bool(re.match(b"[A-Z]", w)) for w in words) / size,
        sum(0 < n < len(w) - 1 for n, w in zip(inside, words, strict=True)) / size,
        sum(bool(odd.search(w)) for w in words) / size,
        len(set(low)) / size,
        max(Counter(low).values(), default=0) / size,
        sum(a == b for a, b in pairs) / size,
        len(set(pairs)) / max(len(words) - 1, 1),
        math.log1p(len(lines)),
        len(set(lines)) / max(len(lines), 1),
        math.log1p(len(t) / max(len(lines), 1)),
        math.log1p(len(words) / max(ends, 1)),
    ]


def plain_chance(m, x):
    z = m["start"] + sum(t[sum(x[f] >= c for c in m["cuts"][f])] for f, t in enumerate(m["single"]))
    for (i, j), t in zip(m["pairs"], m["double"], strict=True):
        z += t[sum(x[i] >= c for c in m["coarse"][i])][sum(x[j] >= c for c in m["coarse"][j])]
    return 1 / (1 + math.exp(-z))


TEXTS = ["", None, " ", "\n", "One two. Two, three!\nfour FIVE5 six%%%", "a", "é ß", "x" * 100, "Same same same\nSame same same\n", "| | |", "日本 語。", "1 2 3", " a\tb\x0bc\rd\n\n"]


def test_features_of_texts():
    got = gam.features([(t or "").encode() for t in TEXTS])
    assert got.shape == (len(TEXTS), len(gam.FEATURES)) and np.isfinite(got).all()
    for t, row in zip(TEXTS, got, strict=True):
        assert np.allclose(row, plain_features(t)), t
    assert gam.features([]).shape == (0, len(gam.FEATURES))


def test_features_of_long_texts_by_slices(monkeypatch):
    whole = ("Wort, %s! " * 40_000 % tuple(range(40_000))).encode() + b"x" * 1_500_000
    want = gam.features([b"a b", whole, b"c"])
    monkeypatch.setattr(gam, "_SLICE", 999)
    monkeypatch.setattr(gam.stretches, "__defaults__", (1 << 12,))
    assert np.allclose(gam.features([b"a b", whole, b"c"]), want) and np.allclose(want[1], plain_features(whole.decode()))


def test_registered_quality_is_the_plain_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = gam.fit(docs.where("not held_out"), labels.where("crc32(cast(doc_id as string)) % 5 <> 0"))
    got = {r.doc_id: r for r in registry.QUERIES["op13_quality"](spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id].held_out == r.held_out
        assert math.isclose(got[r.doc_id].score, plain_chance(model, plain_features(r.text)), abs_tol=1e-6)
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    found = registry.QUERIES["op13_quality"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in found) >= 0.95 * len(found) > 0


def test_pairs_catch_what_single_features_miss():
    rng = np.random.default_rng(2)
    X = rng.uniform(size=(3000, 4))
    y = ((X[:, 0] > 0.5) != (X[:, 2] > 0.5)).astype(int)
    m = gam.train(X, y)
    assert (0, 2) in m["pairs"] and ((gam.chances(m, X) >= 0.5) == y).mean() > 0.95
    assert all(np.isclose(gam.chances(m, X[i : i + 1])[0], plain_chance(m, X[i])) for i in range(50))


def test_trees():
    g, h = np.array([5.0, 4.0, -6.0, -5.0, 7.0]), np.ones(5)
    got = gam.tree(g, h)
    assert (got[[0, 1, 4]] > 0).all() and (got[[2, 3]] < 0).all() and got[0] == got[1] and got[2] == got[3]
    assert gam.tree(np.zeros(3), np.zeros(3)).tolist() == [0, 0, 0] and gam.tree(np.array([2.0]), np.array([2.0])).tolist() == [0.5]
    G = np.outer([1, 1, -1], [1, -1, -1]) * 4.0
    gain, values = gam.quarters(G, np.ones((3, 3)))
    assert gain > 0 and (np.sign(values) == np.sign(G)).all()
    assert gam.quarters(np.ones((1, 3)), np.ones((1, 3)))[0] == 0


def test_odd_rows_of_quality(spark):
    rows = [(i, "Good words, of many kinds. " * 3 if i % 2 else "BAD!! " * 9, i, "s") for i in range(120)] + [(None, "x", 1, "s"), (7, "a second text", 1, "s"), (900, None, 1, "s"), (901, "", 1, "s")]
    df = spark.createDataFrame(rows, ["doc_id", "text", "a.b", "score"]).withColumn("c`d", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(None, 1), (5, None), (900, 0), (6, 1), (4, 3)], "doc_id long, quality int")
    model = gam.fit(df, labels)
    got = gam.score(df, model)
    assert got.columns == ["doc_id", "a.b", "c`d", "score", "predicted"]
    found = got.collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert sum(r.predicted == r.doc_id % 2 for r in found if r.doc_id is not None and r.doc_id < 120) >= 118
    assert gam.fit(df, labels.where("false")) is None and {r.score for r in gam.score(df, None).collect()} == {0.0}
    none = df.where("false")
    assert gam.fit(none, labels) is None and gam.score(none, model).count() == 0
    one = gam.fit(df, labels.where("quality = 1"))
    assert all(r.predicted == 1 for r in gam.score(df, one).collect())
