"""Vectors against brute force, URL verdicts against plain rules, and the pipeline's stages on its table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from arborel.llm import neighbours, registry, urls, vectordups
from arborel.llm.components import connected_components
from arborel.llm.vectordups import near_duplicate_vectors
from tests.oracle import database
from tests.oracle import rows as rows_of

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    X = rng.normal(size=(700, 16)).astype(np.float32)
    X[100:140] = X[100] + rng.normal(size=(40, 16)) * 0.12
    X[200:260] = X[200]
    X[300:320] = X[300] * np.linspace(0.5, 3, 20)[:, None]
    out = [(i, X[i].tolist(), None if i % 50 == 7 else (i >= 100) + (i >= 400), "x", 1) for i in range(700)]
    nan, inf = float("nan"), float("inf")
    out += [(1000, None, 1, None, None), (1100, [0.0] * 16, 1, None, None), (1200, [nan] + [1.0] * 15, 1, None, None), (1300, [inf] * 16, 1, None, None), (1400, [None] + [1.0] * 15, 1, None, None), (1500, [], 1, None, None), (None, X[0].tolist(), 0, None, None), (1600, [1.0, 2.0], 1, None, None), out[200], out[300]]
    return out


@pytest.fixture(scope="module")
def vectors(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


def whole(rows):
    return {i: (np.array(v, float), label) for i, v, label, *_ in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}


def test_nearest_is_exact(vectors, rows, monkeypatch):
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 100)
    got = {}
    for r in neighbours.nearest(vectors, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    usable = whole(rows)
    asked = {i for i in usable if i % 100 == 0}
    assert set(got) == asked
    for q in asked:
        best = sorted((float(np.sqrt(((usable[q][0] - v) ** 2).sum())), i) for i, (v, _) in usable.items() if i != q)[:10]
        assert sorted(got[q]) == [(k, i, pytest.approx(d, abs=1e-12)) for k, (d, i) in enumerate(best, 1)]


def test_bounds_hold():
    rng = np.random.default_rng(0)
    X = rng.normal(size=(30, 1500)) * rng.uniform(0.1, 10, (30, 1))
    codes, scale, norm, miss = neighbours.quantized(X)
    dot = neighbours.products(codes, codes)
    assert (dot == codes.astype(int) @ codes.astype(int).T).all()
    slack = norm[:, None] * miss + miss[:, None] * norm + miss[:, None] * miss
    assert (np.abs(X @ X.T - dot * scale[:, None] * scale) <= slack + 1e-9).all()


def test_vector_links(vectors, rows):
    usable = whole(rows)
    ids = sorted(usable)
    unit = np.array([usable[i][0] / np.linalg.norm(usable[i][0]) for i in ids])
    label = np.array([-1 if usable[i][1] is None else usable[i][1] for i in ids])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label) & (label >= 0)
    np.fill_diagonal(near, False)
    low = {i: i for i in ids}
    for _ in range(50):
        for a, b in np.argwhere(near):
            low[ids[a]] = low[ids[b]] = min(low[ids[a]], low[ids[b]])
    got = {r.vec_id: r for r in near_duplicate_vectors(vectors).collect()}
    assert set(got) == {r[0] for r in rows if r[0] is not None}
    links = dict(zip(ids, near.sum(1), strict=True))
    exact = sum((got[i].n_links, got[i].component_id) == (links[i], low[i]) for i in ids)
    assert exact == len(ids)
    assert all(got[i].n_links == 0 and got[i].kept for i in got if i not in usable)


def test_empty_vectors(spark, vectors):
    none = spark.createDataFrame([], SCHEMA)
    assert near_duplicate_vectors(none).count() == 0 and neighbours.nearest(none, F.lit(True)).count() == 0
    assert neighbours.nearest(vectors, F.lit(False)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5), (None, 3)]
    low = {}
    for a, b in edges:
        if a is not None and a != b:
            low.setdefault(a, a), low.setdefault(b, b)
    for _ in range(300):
        for a, b in edges:
            if a is not None and a != b:
                low[a] = low[b] = min(low[a], low[b])
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == low and len(got) == len(low)


URLS = ["http://A.COM/x", "https://www.example.com/en/1", "https://m.example.com/en/1?x", "example.com/en/", "ftp://b.net/es/1", "b://b.net/en/1#q", "http://xexample.com/en/", "http://com/", "http://d.com", "http://c.org/a://b.com/en/", "http:///x", "http://e.net?x/es/", None, "", "http://\nf.com/ü?"]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at]), rest[at:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def test_url_rules_and_trust(spark):
    rows = [(i, u, None if i % 3 else '<a href="//b.net/q">', 1) for i, u in enumerate(URLS)] + [(99, URLS[0], "<a HREF = https://b.net/>", 1), (99, URLS[0], "", 1)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule = plain(URLS[r.page_id] if r.page_id < 99 else URLS[0])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        assert r.verdict == rule[1] if rule else r.verdict in ("allow", "block")
    assert next(r for r in got if r.host == "a.com").trust > 0 and next(r for r in got if r.host == "b.net").distrust > 0
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def plain_ranks(links, pages, seeds, damping=0.85):
    """Personalised PageRank by many rounds over the whole matrix; hosts refer to themselves once a page."""
    hosts = sorted({h for e in links for h in e[:2]} | set(pages))
    M = np.zeros((len(hosts), len(hosts)))
    for a, b, n in [*links, *((h, h, n) for h, n in pages.items())]:
        M[hosts.index(b), hosts.index(a)] += n
    M /= np.maximum(M.sum(0), 1)
    seed = np.array([seeds.get(h, 0.0) for h in hosts])
    v = seed
    for _ in range(500):
        v = (1 - damping) * seed + damping * M @ v
    return dict(zip(hosts, v, strict=True))


def plain_distrust(links, pages, blocked, damping=0.85):
    """What a host's blocked pages and the hosts it links to make of it, round by round."""
    hosts, out = {h for e in links for h in e[:2]} | set(pages), dict(pages)
    for a, _, n in links:
        out[a] = out.get(a, 0) + n
    d = dict.fromkeys(hosts, 0.0)
    for _ in range(500):
        d = {h: blocked.get(h, 0.0) + (1 - blocked.get(h, 0.0)) * damping * sum(n * d[b] for a, b, n in links if a == h) / max(out.get(h, 0), 1) for h in hosts}
    return d


def test_undecided_hosts_are_judged_by_ranks_at_convergence(spark):
    link = lambda h, n=1: f'<a href="http://{h}/p">' * n
    rows = [("http://b.net/es/1", ""), ("http://b.net/es/2", ""), ("http://x.org/1", link("b.net", 9)), ("http://y.org/1", link("b.net") + link("a.com", 9)), ("http://a.com/1", link("z.org")), ("http://z.org/1", link("y.org") + link("z.org")), ("http://m.c.org/1", link("z.org")), ("http://c.org/1", None), ("http://c.org/2", "")]
    got = {r.host: r for r in urls.judge(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id int, url string, html string")).collect()}
    links = [("x.org", "b.net", 9), ("y.org", "b.net", 1), ("y.org", "a.com", 9), ("a.com", "z.org", 1), ("z.org", "y.org", 1), ("m.c.org", "z.org", 1), ("m.c.org", "c.org", 1), ("c.org", "m.c.org", 1)]
    pages = {"b.net": 2, "x.org": 1, "y.org": 1, "a.com": 1, "z.org": 1, "m.c.org": 1, "c.org": 2}
    trust, distrust = plain_ranks(links, pages, {"a.com": 1.0}), plain_distrust(links, pages, {"b.net": 1.0})
    for h, r in got.items():
        assert abs(r.trust - trust[h]) < 1e-3 and abs(r.distrust - distrust[h]) < 1e-3
        if r.rule is None:
            assert r.verdict == ("block" if distrust[h] > trust[h] and distrust[h] >= urls.SHARE else "allow")
    assert got["x.org"].verdict == "block" and got["y.org"].verdict == got["z.org"].verdict == "allow" and distrust["y.org"] > 0


def test_links_to_hosts_without_pages_and_few_bad_links(spark):
    """Hosts that are only linked to, sinks, an offender with many good links, and one bad link in 1,500."""
    link = lambda h, n=1: f'<a href="http://{h}/p">' * n
    rows = [("http://bad.net/es/1", link("good.org", 50)), ("http://bad.net/es/2", ""), ("http://half.net/fr/1", ""), ("http://half.net/en/1", ""), ("http://a.com/1", link("elsewhere.org", 3)), ("http://sink.org/1", None), ("http://x.org/1", link("bad.net", 4) + link("sink.org")), ("http://away.org/1", link("nowhere.org", 9)), ("http://good.org/1", "")]
    rows += [(f"http://big.org/{i}", link("good.org", 50) + (link("bad.net") if i == 0 else "")) for i in range(30)]
    every = urls.judge(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id int, url string, html string")).collect()
    got = {r.host: r for r in every}
    pages = {"bad.net": 2, "half.net": 2, "a.com": 1, "sink.org": 1, "x.org": 1, "away.org": 1, "good.org": 1, "big.org": 30}
    links = [("bad.net", "good.org", 50), ("a.com", "elsewhere.org", 3), ("x.org", "bad.net", 4), ("x.org", "sink.org", 1), ("away.org", "nowhere.org", 9), ("big.org", "good.org", 1500), ("big.org", "bad.net", 1)]
    trust, distrust = plain_ranks(links, pages, {"a.com": 1.0}), plain_distrust(links, pages, {"bad.net": 1.0, "half.net": 0.5})
    assert set(got) == set(pages)
    for h, r in got.items():
        assert abs(r.trust - trust[h]) < 1e-3 and abs(r.distrust - distrust[h]) < 1e-3
    assert got["bad.net"].distrust == 1 > got["x.org"].distrust > 0.25 > got["big.org"].distrust > 0
    want = {"x.org": "block", "half.net": "block", "sink.org": "allow", "away.org": "allow", "good.org": "allow", "big.org": "allow"}
    assert len(every) == len(rows) and {r.host: r.verdict for r in every if r.rule is None} == want
    only = urls.judge(spark.createDataFrame([(1, "http://p.org/", link("elsewhere.org")), (2, "http://q.org/", "")], "page_id int, url string, html string")).collect()
    assert [r.verdict for r in only] == ["allow", "allow"]


def test_very_large_and_small_vectors(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(300, 8)) * np.repeat([1e200, 1e-200, 1.0], 100)[:, None]
    X[5], X[105] = X[4] * 1.001, X[104] * 1.001
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(X)], "vec_id long, embedding array<double>, label int")
    found = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0, k=5).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in (0, 100, 200):
        D = X - X[q]
        unit = np.abs(D).max(1)
        d = np.sqrt(((D / np.where(unit > 0, unit, 1)[:, None]) ** 2).sum(1)) * unit
        best = sorted((x, i) for i, x in enumerate(d) if i != q)[:5]
        assert sorted(found[q]) == [(k, i, pytest.approx(x, rel=1e-9)) for k, (x, i) in enumerate(best, 1)]
    U = X / np.abs(X).max(1, keepdims=True)
    U /= np.linalg.norm(U, axis=1, keepdims=True)
    near = (U @ U.T >= 0.93).sum(1) - 1
    assert {r.vec_id: r.n_links for r in near_duplicate_vectors(df).collect()} == dict(enumerate(near.tolist()))


def test_longer_codes_find_the_same_links(vectors, monkeypatch):
    want = sorted(map(tuple, near_duplicate_vectors(vectors).collect()), key=repr)
    monkeypatch.setattr(vectordups, "ROWS", 32)
    assert sorted(map(tuple, near_duplicate_vectors(vectors).collect()), key=repr) == want
    assert vectordups.tables_of(12, 0.93) == 32 and vectordups.tables_of(20, 0.93) > 64


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, size = docs.dtypes, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.dtypes == columns
        now = docs.count()
        assert 0 < now <= size and docs.select("doc_id").distinct().count() == now, name
        assert now > 0.8 * size or name == "mixing"
        size = now
    assert "@" not in " ".join(r.text for r in docs.where("text like '%example.com%'").collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == size


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    got = registry.QUERIES[name](spark, sf)
    want = database(sf).execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_registered_queries_give_rows(spark, sf, name):
    assert __spark_entry__.queries()[name](spark, sf).count() > 0
