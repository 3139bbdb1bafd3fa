"""Markup as trees, patterns and rules over them, against plain versions and on edges."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from arborel.operators import analyzers, markup, tree_rules
from arborel.operators.patterns import Condition, Either, Node, captures_of, matches, types_of, within
from arborel.operators.tree_rules import TreeRule

PAGES = [
    (1, "<html lang=en><P class='a b' class=\"c\" id = x>one<br>two<b>x</b></p><p>y</p></html>"),
    (2, '<a><b/><c x="1"/></a>'),
    (3, "<p><b></p></b>"),
    (4, None),
    (5, "</p>"),
    (6, "<p>open"),
    (7, ""),
    (8, "no tags < here > at all"),
    (9, "<a/>"),
    (10, "<br></br><img src=x/>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "id int, html string").repartition(3)


def test_dialects_and_errors(pages):
    got = {r.id: (r.dialect, r.syntax_ok, r.errors) for r in markup.dialect_of(pages, "id", "html").collect()}
    clean = ("html", True, 0)
    assert got == {1: clean, 2: ("xhtml", True, 0), 3: ("html", False, 4), 4: clean, 5: ("html", False, 1), 6: ("html", False, 1), 7: clean, 8: clean, 9: ("xhtml", True, 0), 10: clean}
    declared = F.when(F.col("id") == 1, "xhtml").when(F.col("id") == 2, "sgml")
    got = {r.id: (r.dialect, r.syntax_ok) for r in markup.dialect_of(pages, "id", "html", declared).collect()}
    assert got[1] == ("xhtml", False) and got[2] == ("xhtml", True)


def test_only_pages_with_errors_are_read_again(spark):
    deep = "".join(f"<t{i}>" for i in range(300)) + "".join(f"</t{i}>" for i in reversed(range(300)))
    df = spark.createDataFrame([(1, deep), (2, deep[:-5]), (3, deep.replace("</t5>", "</t6>"))], "id int, html string")
    assert {r.id: r.errors for r in markup.dialect_of(df, "id", "html").collect()} == {1: 0, 2: 1, 3: 2}


def test_tree_has_order_attributes_and_text(pages):
    got = [tuple(r) for r in markup.markup_tree(pages, "id", "html").where("id in (1, 2, 5, 9)").orderBy("id", "pre").collect()]
    assert got[:5] == [
        (1, 1, 5, None, 0, 0, "html", {"lang": "en"}, ""),
        (1, 2, 4, 1, 0, 1, "p", {"class": "a b", "id": "x"}, "one"),
        (1, 3, 3, 2, 0, 2, "br", {}, "two"),
        (1, 4, 4, 2, 1, 2, "b", {}, "x"),
        (1, 5, 5, 1, 1, 1, "p", {}, "y"),
    ]
    assert [r[:4] for r in got[5:]] == [(2, 1, 3, None), (2, 2, 3, 1), (2, 3, 3, 2), (9, 1, 1, None)]
    xhtml = markup.markup_tree(pages, "id", "html", F.lit("xhtml")).where("id = 2").orderBy("pre").collect()
    assert [(r.pre, r["last"], r.parent, r.ord, r.attrs) for r in xhtml] == [(1, 3, None, 0, {}), (2, 2, 1, 0, {}), (3, 3, 1, 1, {"x": "1"})]


# ---------------------------------------------------------------- patterns


def plain(tree, p):
    """(pre, captures) of every match in a list of nodes, by trying all ways to choose children."""
    if isinstance(p, Either):
        return [m for q in p.of for m in plain(tree, q)]
    out = []
    for n in tree:
        if p.types and n["type"] not in p.types or not all(holds(n, t) for t in p.tests):
            continue
        kids = [c for c in tree if c["parent"] == n["pre"]]
        of = {c["pre"]: c for c in kids}
        if any(pre in of and (not q.anchored or of[pre]["ord"] == 0) for q in p.without for pre, _ in plain(tree, q)):
            continue
        ways = [[m for m in plain(tree, q) if m[0] in of] for q in p.children]
        for way in product(*ways):
            at = [of[pre]["ord"] for pre, _ in way]
            if all(a == (at[i - 1] + 1 if i else 0) if q.anchored else not i or a > at[i - 1] for i, (a, q) in enumerate(zip(at, p.children, strict=True))):
                out.append((n["pre"], {**({p.capture: n["pre"]} if p.capture else {}), **{k: v for _, c in way for k, v in c.items()}}))
    return out


def holds(n, t):
    import re

    x = n["text"] if t.attribute is None else n["attrs"].get(t.attribute)
    if t.kind in ("has", "has_not"):
        return (x is not None) == (t.kind == "has")
    if x is None:
        return False
    kind = t.kind.removeprefix("not_")
    return (x == t.value if kind == "eq" else x in t.value if kind == "any_of" else bool(re.search(t.value, x))) != t.kind.startswith("not_")


PATTERNS = [
    Node(("a",)),
    Node(capture="any"),
    Node(("a",), (Node(("b",), capture="x"),), capture="up"),
    Node(("a", "c"), (Node(("b",), capture="x"), Node(("c",), capture="y"))),
    Node(("a",), (Node(("b",), anchored=True, capture="x"), Node(("c",), anchored=True, capture="y"))),
    Node((), (Node(("b",), capture="x"), Node(("c",), anchored=True, capture="y"), Node((), capture="z"))),
    Node(("a",), without=(Node(("b",)), Node(("c",), (Node(("a",)),)))),
    Node(("a",), without=(Node(("b",), anchored=True),), tests=(Condition("has", attribute="k"),)),
    Either((Node(("a",), (Node(("a",), capture="x"),)), Node(("b",), tests=(Condition("eq", "t1"),), capture="y"))),
    Node(("a",), (Either((Node(("b",), capture="x"), Node(("c",), (Node(("b",), capture="y"),))), anchored=True),)),
    Node((), tests=(Condition("any_of", ["0", "2"], "k"), Condition("not_match", "[13]"))),
    Node((), tests=(Condition("not_eq", "0", "k"), Condition("match", "t"))),
    Node((), tests=(Condition("not_any_of", ["0", "1"], "k"), Condition("has_not", attribute="other"))),
]


@pytest.fixture(scope="module")
def trees(spark):
    rng = random.Random(5)

    def element(depth):
        t = rng.choice("abc")
        kids = "".join(element(depth + 1) for _ in range(rng.randint(0, 4 if depth < 4 else 0)))
        key = rng.choice(["", f' k="{rng.randint(0, 2)}"'])
        return f"<{t}{key}>t{rng.randint(0, 3)}{kids}</{t}>"

    df = spark.createDataFrame([(i, element(0) + element(1)) for i in range(25)] + [(99, None)], "id int, html string")
    nodes = spark.createDataFrame(markup.markup_tree(df, "id", "html").collect(), markup.markup_tree(df, "id", "html").schema).persist()
    by = {}
    for r in nodes.orderBy("id", "pre").collect():
        by.setdefault(r.id, []).append(r.asDict())
    return df, nodes, by


@pytest.mark.parametrize("i", range(len(PATTERNS)))
def test_matches_are_the_plain_ones(trees, i):
    _, nodes, by = trees
    p = PATTERNS[i]
    names = captures_of(p)
    found = matches(nodes, "id", p)
    assert found.columns == ["id", "pre", "last", *names]
    got = sorted((r.id, r.pre, *((r[n].pre if r[n] else 0) for n in names)) for r in found.collect())
    want = sorted((k, pre, *(c.get(n) or 0 for n in names)) for k, t in by.items() for pre, c in plain(t, p))
    assert got == want
    if i not in (4,):
        assert got
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scopes_without_an_inner_node(trees):
    _, nodes, by = trees
    scopes, inner = matches(nodes, "id", Node(("a",), capture="s")), matches(nodes, "id", Node(("b",), (Node(("c",)),)))
    got = {(r.id, r.pre) for r in within(nodes, scopes, inner, "id").collect()}
    hits = {(k, pre) for k, t in by.items() for pre, _ in plain(t, Node(("b",), (Node(("c",)),)))}
    assert got == {(k, n["pre"]) for k, t in by.items() for n in t if n["type"] == "a" and not any((k, x) in hits for x in range(n["pre"], n["last"] + 1))}
    assert got


@pytest.mark.parametrize("make", [lambda: Condition("like", "x"), lambda: Condition("match", "("), lambda: Condition("has"), lambda: TreeRule("r", "forbid", "m"), lambda: TreeRule("r", "analysis", "m", analyzer="none"), lambda: TreeRule("r", "other", "m", Node()), lambda: TreeRule("r", "require_in", "m", Node()), lambda: TreeRule("r", "naming", "m", Node()), lambda: TreeRule("r", "forbid", "m", Node(), capture="x"), lambda: TreeRule("r", "naming", "m", Node(capture="x"), capture="x", regex="[")])
def test_rules_that_are_none(make):
    with pytest.raises(Exception):  # noqa: B017
        make()


def test_captures_must_not_clash(trees):
    with pytest.raises(ValueError, match="capture"):
        matches(trees[1], "id", Node(("a",), capture="pre"))
    assert types_of(PATTERNS[6]) == {"a", "b", "c"}


# ---------------------------------------------------------------- rules


def test_rules_hold_by_dialect_and_what_it_can_hold(spark, trees):
    df, nodes, by = trees
    dialect = F.when(F.col("id") % 2 == 0, "html").otherwise("xhtml")
    pages = df.select("id", dialect.alias("dialect"), (F.col("id") != 3).alias("syntax_ok"))
    rules = [TreeRule("b-in-a", "forbid", "no", Node(("a",), (Node(("b",), capture="x"),)), capture="x"), TreeRule("has-c", "require", "c", Node(("c",)), severity="warning", dialects=("html",)), TreeRule("names", "naming", "key", Node(("c",), capture="c"), capture="c", attribute="k", regex="[01]"), TreeRule("text", "naming", "text", Node(("b",), capture="b"), capture="b", regex="t[0-2]"), TreeRule("b-in-c", "require_in", "b", Node(("b",)), scope=Node(("c",), capture="s"), capture="s")]
    known = spark.createDataFrame([("html", t, True) for t in "abc"] + [("xhtml", "a", True), ("xhtml", "b", True), ("xhtml", "c", False)], "dialect string, type string, holds boolean")
    assert {tuple(r) for r in tree_rules.skipped(spark, rules, known).collect()} == set()
    lacks = known.where("not (dialect = 'xhtml' and type = 'b')")
    assert {tuple(r) for r in tree_rules.skipped(spark, rules, lacks).collect()} == {("xhtml", x) for x in ("b-in-a", "text", "b-in-c")}
    deep = [TreeRule("deep", "forbid", "no", Node(("c",), (Node(),)))]
    assert {tuple(r) for r in tree_rules.skipped(spark, deep, known).collect()} == {("xhtml", "deep")}
    either = [TreeRule("either", "forbid", "no", Either((Node(("b",)), Node(("a",))))), TreeRule("many", "forbid", "no", Node(("b", "a"))), TreeRule("un", "forbid", "no", Node(("a",), without=(Node(("b",)),)))]
    assert tree_rules.skipped(spark, either, lacks).count() == 0

    got = sorted((r.id, r.rule_id, r.pre) for r in tree_rules.violations(nodes, pages, rules, "id", lacks).collect())
    want = []
    for k, t in [*by.items(), (99, [])]:
        html = k % 2 == 0
        if html:
            want += [(k, "b-in-a", c["x"]) for _, c in plain(t, rules[0].pattern)]
            want += [(k, "has-c", 0)] * (not any(n["type"] == "c" for n in t))
            want += [(k, "text", n["pre"]) for n in t if n["type"] == "b" and n["text"] not in ("t0", "t1", "t2")]
            want += [(k, "b-in-c", n["pre"]) for n in t if n["type"] == "c" and not any(m["type"] == "b" and n["pre"] <= m["pre"] <= n["last"] for m in t)]
        want += [(k, "names", n["pre"]) for n in t if n["type"] == "c" and n["attrs"].get("k") == "2"]
    assert got == sorted(want) and len({r for _, r, _ in got}) == 5
    found = tree_rules.violations(nodes, pages, rules, "id", lacks)
    reports = {r.id: r for r in tree_rules.reports(pages, found, rules, "id", lacks).collect()}
    for k, r in reports.items():
        mine = [x for x in got if x[0] == k]
        assert r.passed == (k != 3 and not mine) and [(v.pre, v.rule_id) for v in r.violations] == sorted((pre, rule) for _, rule, pre in mine)
        assert (r.checked_rules, r.skipped_rules) == ((["b-in-a", "has-c", "names", "text", "b-in-c"], []) if k % 2 == 0 else (["names"], ["b-in-a", "text", "b-in-c"]))
    assert tree_rules.violations(nodes, pages, [], "id").count() == 0
    assert all(r.passed == r.syntax_ok and r.checked_rules == [] for r in tree_rules.reports(pages, tree_rules.violations(nodes, pages, [], "id"), [], "id").collect())


def test_messages_and_snippets(spark):
    df = spark.createDataFrame([(1, f'<a k="x">{"é" * 300}<b>t</b></a>')], "id int, html string")
    nodes, pages = markup.markup_tree(df, "id", "html"), df.select("id", F.lit("html").alias("dialect"))
    rules = [TreeRule("n", "naming", "wrong", Node(("a",), capture="c"), capture="c", attribute="k", regex="y"), TreeRule("f", "forbid", "no", Node(("a",)), severity="warning")]
    known = spark.createDataFrame([("html", "a", True)], "dialect string, type string, holds boolean")
    got = sorted(tuple(r) for r in tree_rules.violations(nodes, pages, rules, "id", known).collect())
    assert got == [(1, "f", "no", "warning", 1, "a", "é" * 200), (1, "n", "wrong (got 'x')", "error", 1, "a", "x")]


# ---------------------------------------------------------------- analyses


def found(spark, analyzer, *html):
    df = spark.createDataFrame(list(enumerate(html)), "id int, html string")
    return {(r.id, r.pre): r.message for r in analyzer(markup.markup_tree(df, "id", "html", F.lit("xhtml")), "id").collect()}


def test_exclusive_members(spark):
    got = found(spark, analyzers.exclusive_members, '<r><i a="1"/><i b="2" c="3"/><i c="1" b="2"/></r>', '<r><i a="1"/><i b="2" a="3"/></r>', '<r><i a="1" n="0"/><i n="1"/></r>', '<r><i a="1" b="1"/><i a="2" b="2"/></r>', '<r><i a="1"/><j b="1"/><i/></r>')
    assert got == {(0, 2): "i is used with {a} / {b, c}"}


def test_exclusive_flags(spark):
    got = found(spark, analyzers.exclusive_flags, '<r><i a="true" b="false"/><i a="false" b="true"/></r>', '<r><i a="true" b="true"/><i a="false" b="true"/><i a="true"/></r>', '<r><i a="true" b="false"/><i a="false" b="{x}"/><i b="true"/></r>', '<r><i a="true" b="false"/><i b="false"/></r>', '<r><i a="true"/><i a="false"/></r>')
    assert got == {(0, 2): "i is never set to two of a, b"}


def test_closed_domains(spark):
    got = found(spark, analyzers.closed_domains, '<r><i k="x"/><i k="y"/><i k="x"/></r>', '<r><i k="x"/><i/><i k="y"/></r>', '<r><i k="x"/><i k="${y}"/></r>', '<r><i k="x"/><i k="y"/><j k="z"/></r>', '<r><i k="x"/><i k="x"/></r>', '<r><i k="x"/></r>')
    assert got == {(0, 2): "i.k is one of x | y"}


def test_unchanged_values(spark):
    got = found(spark, analyzers.unchanged_values, '<r><c id="a" value="1"/><c id="b" value="2"/><set ref="b"/><c id="d" value="{x}"/><c id="e"/></r>', '<r><c id="a" value="1"/><x><c id="a" value="1"/></x></r>', '<r><unset ref="a"/><c id="a" value="1"/></r>')
    assert got == {(0, 2): "a is always 1"}


def test_known_values(spark):
    head = '<r><list id="l"><item name="p" value="1"/><item name="q" value="1"/><item name="s" value="2"/></list>'
    got = found(spark, analyzers.known_values, head + '<kind id="k" of="l"/><u kind="k" value="1"/><u kind="k" value="3"/><u kind="o" value="1"/></r>', head + '<kind id="k" of="l"/><kind id="k" of="m"/><u kind="k" value="1"/></r>', head + '<list id="l"/><kind id="k" of="l"/><u kind="k" value="1"/></r>', head + '<kind id="k" of="l"/><kind id="k" of="l"/><u kind="k" value="2"/></r>')
    assert got == {(0, 7): "1 is l.p", (3, 8): "2 is l.s"}
