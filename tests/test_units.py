"""Edges of the column functions, sources and jobs."""

import json
import math
import re
import types
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from arborel.functions import languages, metadata, text, vectors
from arborel.jobs import build, prompts
from arborel.jobs.generate import reviewed
from arborel.operators import corpus, fingerprint, hybrid, lexical, nodes, rules
from arborel.operators.similar import similar
from arborel.registry import RULES
from arborel.sources import conventions, files, tables
from arborel.streaming.check import check_stream


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<double>'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def plain_tokens(s):
    return [t.lower() for c in re.split(r"[^a-zA-Z0-9]+", s) if c for t in re.split(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", c) if len(t) >= 2]


@pytest.mark.parametrize("s", ["", "parseHTTPResponse x9Y a_b", "ABCDef ghiJ", "éÀ naïveCafé", "--", "A", "aBcDeF HTMLParser2Go"])
def test_tokens(spark, s):
    assert one(spark, text.tokenize(F.col("t")), t=s) == plain_tokens(s)


@pytest.mark.parametrize("reply, code", [("x\n```py\na\nb\n\n```\n```\nc```", "a\nb\n"), ("none", None), ("```a```", None), (None, None)])
def test_code_block(spark, reply, code):
    assert one(spark, text.extract_code_block(F.col("t")), t=reply) == code


def test_vectors(spark):
    assert one(spark, vectors.similarity(F.col("a"), F.col("b")), a=[1.0, 2.0], b=[-3.0, 1.0]) == 0
    assert one(spark, vectors.dot(F.col("a"), F.col("b")), a=[1.0, 2.0], b=[3.0, 1.0]) == 5
    with pytest.raises(PySparkException):
        one(spark, vectors.dot(F.col("a"), F.col("b")), a=[1.0], b=[3.0, 1.0])


def test_metadata_wildcards(spark):
    df = spark.createDataFrame([("a", {"framework": ["x"], "tags": ["p", "q"]}), ("b", {"tags": []}), ("c", {})], "id string, meta map<string,array<string>>")
    ids = lambda wanted: [r.id for r in df.where(metadata.matches(F.col("meta"), wanted)).orderBy("id").collect()]
    assert ids({"framework": "x"}) == ["a", "b", "c"] and ids({"framework": "y"}) == ["b", "c"]
    assert ids({"tags": ["q", "z"]}) == ["a", "c"] and ids({"tags": []}) == ["c"] and ids({"tags": None}) == ["a", "b", "c"]
    share = {r.id: r.s for r in df.select("id", metadata.overlap(F.col("meta"), {"framework": "x", "tags": "q", "n": None}).alias("s")).collect()}
    assert share == {"a": 1.0, "b": 0.0, "c": 0.0}


def test_languages(spark):
    assert one(spark, languages.normalize_language(F.col("t")), t=" TS ") == "typescript"
    assert one(spark, languages.language_of_path(F.col("t")), t="a.b/c.TSX") == "tsx"
    assert one(spark, languages.rule_languages(F.col("t")), t="tsx") == ["tsx", "typescript"]
    with pytest.raises(PySparkException):
        one(spark, languages.normalize_language(F.col("t")), t="cobol")


def test_bm25_against_a_plain_one(spark):
    texts = ["log the logger name", "naming naming rules", "route the routes route", "", None, "nothing"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    toks = [plain_tokens(t or "") for t in texts]
    avg = sum(map(len, toks)) / len(toks)
    query = plain_tokens("the route the naming")
    raw = {}
    for i, d in enumerate(toks):
        s = 0.0
        for q in query:
            n = sum(q in x for x in toks)
            if q in d:
                s += math.log(1 + (len(toks) - n + 0.5) / (n + 0.5)) * d.count(q) * 2.5 / (d.count(q) + 1.5 * (0.25 + 0.75 * len(d) / avg))
        if s:
            raw[i] = s
    got = {r.id: r.bm25 for r in lexical.score_query(df, "id", F.col("t"), "the route the naming").collect()}
    assert got.keys() == raw.keys() and all(math.isclose(got[i], raw[i] / max(raw.values())) for i in raw)
    assert lexical.score_query(df, "id", F.col("t"), "?").count() == 0
    assert lexical.score_query(df.limit(0), "id", F.col("t"), "the").count() == 0
    many = lexical.score_queries(df, "id", F.col("t"), spark.createDataFrame([(7, "the route the naming"), (8, "absent")], "q int, qt string"), "q", F.col("qt"), 2).collect()
    assert [(r.q, r.id, r["rank"]) for r in many] == [(7, i, k) for k, i in enumerate(sorted(raw, key=lambda i: (-round(raw[i], 6), i))[:2], 1)]


def test_blend_weights(spark):
    entries = spark.createDataFrame([("a", {"k": ["v"]}), ("b", {}), ("c", {"k": ["w"]})], "id string, meta map<string,array<string>>")
    textual = spark.createDataFrame([("b", 1.0)], "id string, bm25 double")
    got = hybrid.blend(entries, id_col="id", wanted={"k": "v"}, text=textual).collect()
    assert [(r.id, r.score, r.match_reason) for r in got] == [("b", round(0.35 / 0.55, 6), "bm25=1.000, metadata_overlap=0.000")]
    vector = spark.createDataFrame([("a", 0.5)], "id string, ast double")
    got = hybrid.blend(entries, id_col="id", wanted={"k": "v"}, text=textual, vector=vector).collect()
    assert [(r.id, r.score) for r in got] == [("a", 0.425), ("b", 0.35)]
    assert [r.id for r in hybrid.blend(entries, id_col="id", wanted={}, k=2).collect()] == ["a", "b"]


def test_markup_tree(spark):
    html = "<html><head><meta x></head><body><ul><li>a<li>b</ul><br/><p>x</p></body></html>"
    got = {r.pre: (r.type, r.last, r.parent, r.depth) for r in nodes.markup_nodes(spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string"), "id", "html").collect()}
    assert got[1] == ("html", 9, None, 0) and got[3] == ("meta", 3, 2, 2) and got[4][0] == "body" and got[6][:1] == ("li",) and got[7][2] == 6
    assert len(got) == 9
    entries = fingerprint.components(fingerprint.features(nodes.markup_nodes(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html"), "id"), "id")
    vector = fingerprint.vectors(entries, "id").first().fingerprint
    assert len(vector) == 256 and math.isclose(sum(x * x for x in vector), 1, rel_tol=1e-5)


def test_rules_over_odd_rows(spark):
    docs = spark.createDataFrame([(1, "en", None), (2, "en", ""), (3, "de", "Ä geheim = 1\npassword=x"), (4, None, "The x\nno\nThe y, z\nWow!!")], "doc_id int, lang string, text string")
    lines = nodes.line_nodes(docs, "text", "doc_id", "lang")
    found = rules.violations(docs, lines, RULES, "doc_id", "lang")
    got = Counter((r.doc_id, r.rule_id, r.start_line, r.start_col) for r in found.collect())
    assert got[(3, "no-secret-de", 1, 3)] == 1 and got[(3, "no-secret", 2, 0)] == 1 and got[(1, "needs-sentence", 1, 0)] == 1
    assert not any(k[1] == "no-shouting" for k in got)
    passed = {r.doc_id: r.passed for r in rules.report(docs, found, "doc_id").collect()}
    assert not any(passed.values()) and len(passed) == 4
    assert [r.id for r in rules.applicable(RULES, "de")] == ["needs-sentence", "first-word-plain", "no-secret-de"]
    for bad in ({"type": "x"}, {"type": "require_in"}, {"type": "naming"}):
        with pytest.raises(ValueError):
            rules.Rule("r", pattern="", message="", **bad)


def test_store(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int")
    with pytest.raises(ValueError):
        corpus.upsert(old, new, "id", replace=False)
    assert sorted(map(tuple, corpus.upsert(old, new, "id", replace=True).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    rest, was = corpus.delete(old, "a", "id")
    assert was and rest.count() == 1 and not corpus.delete(old, "z", "id")[1]


def test_convention_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "r", "language": "py", "rule": {"id": "r", "type": "forbid", "query": "(call)"}, "metadata": {"tags": ["x", "y"], "framework": "f", "n": None}}, {"id": "p", "language": "ts", "title": "T", "good_example": "x"}]))
    (tmp_path / "b.json").write_text(json.dumps({"id": "q", "language": "go"}))
    got = {r.id: r for r in conventions.quarantined(conventions.read(spark, str(tmp_path))).collect()}
    assert (got["r"].kind, got["r"].title, got["r"].rule.language, got["r"].rule.severity, got["r"].error) == ("rule", "r", "python", "error", None)
    assert got["r"].meta == {"tags": ["x", "y"], "framework": ["f"]} and got["p"].kind == "pattern" and got["q"].error
    entries = conventions.read(spark, str(tmp_path))
    assert [r.id for r in conventions.listed(entries, ("python", "go")).collect()] == ["q", "r"]
    assert json.loads(conventions.export(entries.where("id = 'p'")).first().value)["good_example"] == "x"


def test_source_tree(spark, tmp_path):
    root = tmp_path / "build"
    for name, body in (("a.py", b"x"), ("b/c.TS", b"y"), ("b/node_modules/d.js", b"z"), ("e.md", b"-"), ("f.go", b"\xff\xfe")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[1]: (r.language, r.code) for r in files.scan(spark, str(root)).collect()}
    assert got == {"a.py": ("python", "x"), "c.TS": ("typescript", "y"), "f.go": ("go", None)}
    assert files.scan(spark, str(root), "python").count() == 1 and files.scan(spark, str(root), most=2).count() == 2


def test_results_do_not_depend_on_partitions(spark, sf):
    from arborel.registry import QUERIES

    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append([sorted(map(tuple, QUERIES[q](spark, sf).collect()), key=repr) for q in ("f5_fingerprints", "t8_bm25_search", "r14_report")])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


def test_stream(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.where("doc_id < 50").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    check_stream(stream, RULES, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    docs.where("doc_id >= 50").write.mode("append").parquet(str(tmp_path / "in"))
    check_stream(stream, RULES, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    from arborel.registry import _violations

    assert 0 < first < spark.read.parquet(str(tmp_path / "out")).count() == _violations(spark, sf)[1].count()


def test_every_match_of_a_line_counts(spark):
    lines = spark.createDataFrame([(1, "en", 1, "é password = token=x " + "!!" * 600), (2, "en", 1, "é id Ok id bad id Fine id worse")], "doc_id long, lang string, start_line int, text string")
    of = [rules.Rule("s", "forbid", r"(password|token) ?=", "m"), rules.Rule("b", "forbid", "!!", "m"), rules.Rule("n", "naming", "[A-Z][a-z]+", "m", capture=r"id (\w+)")]
    found = rules.violations(lines.select("doc_id", "lang"), lines, of, "doc_id", "lang")
    got = sorted((r.doc_id, r.rule_id, r.start_col, r.message) for r in found.select("doc_id", "rule_id", "start_col", "message").collect())
    want = [(1, "b", 22 + 2 * i, "m") for i in range(600)] + [(1, "s", 3, "m"), (1, "s", 14, "m")] + [(2, "n", 12, "m (got 'bad')"), (2, "n", 27, "m (got 'worse')")]
    assert got == sorted(want)


def test_names_of_languages(spark):
    for name, want in ((" PY\t", "python"), ("Python3", "python"), ("node", "javascript"), ("GoLang", "go"), ("cobol", None), ("", None), (None, None)):
        assert one(spark, languages.known_language(F.col("t")), t=name) == want


def test_patterns_must_compile():
    for bad in ({"type": "forbid", "pattern": "("}, {"type": "naming", "pattern": "[", "capture": "x"}, {"type": "require_in", "pattern": "x", "scope": "*"}):
        with pytest.raises(ValueError):
            rules.Rule("r", message="", **bad)


def test_comparable_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, []), (5, [-1.0, 0.0]), (6, [0.5, 0.25])], "vec_id long, v array<double>")
    asked = F.array(F.lit(1.0), F.lit(0.0))
    assert {r.vec_id: r.s for r in df.select("vec_id", vectors.similarity(F.col("v"), asked).alias("s")).collect()} == {1: 1.0, 2: None, 3: None, 4: None, 5: 0.0, 6: 0.5}
    got = [tuple(r) for r in similar(df, F.col("vec_id") > 4, id_col="vec_id", vector_col="v", k=2).orderBy("query_id", "rank").collect()]
    assert got == [(5, 1, 1, 0.0), (5, 2, 6, 0.0), (6, 1, 1, 1.0), (6, 2, 5, 0.0)]
    assert similar(df, F.lit(False), id_col="vec_id", vector_col="v", k=2).count() == 0


def test_batches_of_queries_give_what_one_batch_gives(spark, sf, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    ask = lambda: sorted(map(tuple, lexical.score_queries(docs, "doc_id", F.col("text"), items, "item_id", F.col("text"), 4).collect()))
    want = ask()
    monkeypatch.setattr(lexical, "BATCH_TERMS", 300)
    assert ask() == want and len(want) > 100


def test_conventions_in_prompts(spark):
    kind = "array<struct<kind:string,id:string,title:string,guideline:string,example:string,language:string,score:double>>"
    rows = [(1, [("rule", "r1", "Say so", "as told", "x = 1", "py", 0.5), ("pattern", "p1", "Shape", "", "y\nz", "py", 0.256)]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, f"id int, hits {kind}")
    got = {r.id: r.c for r in df.select("id", prompts.conventions(F.col("hits")).alias("c")).collect()}
    assert got == {1: "## Rules\n- r1: Say so\n  as told\n```py\nx = 1\n```\n## Patterns\n- Shape (0.26)\n```py\ny\nz\n```", 2: None, 3: None}
    asks = df.select("id", prompts.generation(F.lit("T"), F.lit("py"), F.col("hits"), F.lit("")).alias("g"), prompts.correction(F.lit("T"), F.lit("py"), F.lit("old"), F.lit(None).cast("array<struct<start_line:int,rule_id:string,message:string,snippet:string>>"), F.col("hits")).alias("c"))
    got = {r.id: r for r in asks.collect()}
    assert "## Around it" not in got[1].g and got[1].g.index("## Task\nT") < got[1].g.index("## Patterns") and got[2].g == "Write this text.\n## Task\nT\nAnswer with one fenced block."
    assert "## Patterns" not in got[1].c and "## Text\n```py\nold\n```\n## Findings\n- none" in got[1].c


def test_reviews(spark):
    docs = spark.createDataFrame([(1, "en", "a!! b!!"), (2, "en", "fine"), (3, "en", None), (4, "en", "no!!"), (5, "en", "keep!!")], "doc_id long, lang string, text string")
    of = [rules.Rule("loud", "forbid", "!!", "calm")]
    check = lambda d: rules.violations(d, nodes.line_nodes(d, "text", "doc_id", "lang"), of, "doc_id", "lang")
    seen = []

    def provider(rows):
        seen.extend(rows.collect())
        fix = F.when(F.col("doc_id") == 5, F.col("text")).otherwise(F.regexp_replace("text", "!!", "!"))
        return rows.select("doc_id", F.when(F.col("doc_id") == 4, "no block").otherwise(F.concat(F.lit("so\n```\n"), F.coalesce(fix, F.lit("")), F.lit("\n```"))).alias("reply"))

    hits = docs.where("doc_id = 1").select("doc_id", F.array(F.struct(F.lit("rule").alias("kind"), F.lit("loud").alias("id"), F.lit("calm").alias("title"), F.lit("").alias("guideline"), F.lit("").alias("example"), F.lit("").alias("language"), F.lit(1.0).alias("score"))).alias("h"))
    got = {r.doc_id: r for r in reviewed(docs, "doc_id", "text", "lang", check, provider, hits).collect()}
    assert {i: (r.violations, r.fix, r.fix_violations, r.fix_verified) for i, r in got.items()} == {1: (2, "a! b!\n", 0, True), 2: (0, "fine\n", 0, True), 3: (0, "\n", 0, True), 4: (1, None, None, False), 5: (1, "keep!!\n", 1, False)}
    asked = {r.doc_id: r.prompt for r in seen}
    assert "## Rules\n- loud: calm" in asked[1] and "## Rules" not in asked[2] and "- line 1: [loud] calm" in asked[1]


def test_broken_convention_files_do_not_stop_a_build(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "x", "language": "py", "good_example": "1", "metadata": {"category": "c"}}, {"id": "y", "language": "klingon", "good_example": "1"}]))
    (tmp_path / "b.json").write_text('[{"id": "z", ')
    (tmp_path / "c.json").write_text(json.dumps({"id": "x", "language": "go", "good_example": "2"}))
    entries = conventions.read(spark, str(tmp_path))
    units = spark.createDataFrame([("n", "s1", "f1"), ("n", "s1", "f0"), ("m", "s2", "f1"), ("m", None, "f2")], "name string, snippet string, source string")
    indexed = build.indexed_units(units, language=F.lit("go"), name=F.col("name"), snippet=F.col("snippet"), source=F.col("source"))
    assert sorted((r.title, r.meta["source"][0]) for r in indexed.collect()) == [("unit m", "f1"), ("unit n", "f0")]
    corpus_, report = build.build(entries, indexed)
    assert sorted((r.source.rsplit("/", 1)[-1], r.loaded, r.errors, r.error) for r in report.collect()) == [("a.json", 1, 1, "unknown language klingon"), ("b.json", 0, 1, "not JSON"), ("c.json", 1, 0, None), ("units", 2, 0, None)]
    assert sorted((r.id, r.language) for r in corpus_.where("kind = 'pattern' and id = 'x'").collect()) == [("x", "go")] and corpus_.count() == 3
    again = build.indexed_units(units, language=F.lit("go"), name=F.col("name"), snippet=F.col("snippet"), source=F.col("source"), existing=indexed)
    assert again.count() == 0
    checked = conventions.quarantined(entries)
    assert not conventions.exported_groups(checked, str(tmp_path / "out")) and not (tmp_path / "out").exists()
    assert conventions.exported_groups(checked.where("error is null"), str(tmp_path / "out")) and (tmp_path / "out").exists()


def test_files_beyond_the_limit_are_counted(spark, tmp_path):
    for name, body in (("a.py", b"x"), ("b.py", b"\xff"), ("c.py", b"y"), ("d.py", b"z"), ("e.txt", b"-")):
        (tmp_path / name).write_bytes(body)
    read, counts = files.counted(files.scan(spark, str(tmp_path)), most=3)
    assert [r.code for r in read.orderBy("path").collect()] == ["x", "y"] and tuple(counts.first()) == (3, 2)


def test_units_and_parents_on_odd_markup(spark):
    html = "</p><nav><ul><li>a</li></ul></nav></div></div><article><h2>t</h2><p>x<br></p></article><p>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<article><p></p><i></i></article>")], "id int, html string")
    tree = nodes.markup_nodes(pages, "id", "html")
    plain, open_, pre = [], [], 0
    for closing, name in re.findall(r"<(/?)([a-z0-9]+)[^>]*>", html):
        if closing:
            open_ = open_[:-1] if open_ else []
            continue
        pre += 1
        plain.append((pre, open_[-1] if open_ else None))
        if name != "br":
            open_.append(pre)
    got = {r.pre: r.parent for r in tree.where("id = 1").collect()}
    assert {p: got[p] for p in (1, 2, 3)} == {1: None, 2: 1, 3: 2} and all(got[a] is None or got[a] < a for a in got) and len(got) == len(plain)
    shapes = nodes.unit_shapes(tree, nodes.units(tree, "id", ("article", "nav"), 0, 2), "id").where("id = 3").collect()
    assert [(r.pre, r.shape, r.name) for r in shapes] == [(1, "article p i", "article")]


def test_tables_between_steps_can_be_discarded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_folder", lambda spark: str(tmp_path))
    monkeypatch.setattr(tables, "_paths", {})
    assert tables.written(spark.range(3)).count() == 3 and len(list(tmp_path.iterdir())) == 1
    assert tables.discard(spark) == 1 and not list(tmp_path.iterdir()) and tables.discard(spark) == 0


def test_where_tables_between_steps_go():
    session = lambda master, folder: types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *a: folder), sparkContext=types.SimpleNamespace(master=master))
    assert tables.shared_folder(session("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y"
    assert tables.shared_folder(session("local[4]", None)) == tables.shared_folder(session("local", None)) != ""
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            tables.shared_folder(session(master, None))
