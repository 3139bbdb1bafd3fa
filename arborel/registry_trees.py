"""Queries on trees, patterns and rules over them, with the SQL that gives the same rows.

Pages have few attributes and no well-formed page, so some queries mark up order lines: a page for each order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborel.operators import markup, tree_rules
from arborel.operators.patterns import Condition, Either, Node, matches
from arborel.operators.tree_rules import TreeRule
from arborel.sources.tables import load, written

# Patterns: nested children; alternatives with a test of an attribute; a first child and the one that follows at once;
# children that are not there.
LINKED_ITEM = Node(("ul",), (Node(("li",), (Node(("a",), capture="link"),), capture="item"),))
HEADING = Node(("article", "head"), (Either((Node(("h1",), tests=(Condition("match", "[A-Z]{2}"),), capture="name"), Node(("title",), tests=(Condition("not_match", "[A-Z]{2}"),), capture="name"))),))
OPENING = Node(("article",), (Node(("h1",), anchored=True, capture="h"), Node(("p",), anchored=True, capture="p")))
PLAIN_PART = Node(("p",), without=(Node(("b",)), Node(("br",))), tests=(Condition("match", "[.]"),), capture="p")
BODY_PARTS = Node(("body",), (Node(("nav",), capture="first"), Node(("div",), tests=(Condition("eq", "ad", "class"),), capture="ad"), Node(("article", "footer"), capture="then")))
TREE_RULES = [
    TreeRule("capital-link", "forbid", "links are lower-case", Node(("a",), tests=(Condition("match", "^/[A-Z]", "href"),), capture="a"), capture="a"),
    TreeRule("has-figure", "require", "a page has a figure", Node(("figure",))),
    TreeRule("break-in-part", "require_in", "an article has a break", Node(("br",)), scope=Node(("article",), capture="s"), capture="s", severity="warning"),
    TreeRule("plain-language", "naming", "a language is English or German", Node(("html",), capture="h"), capture="h", attribute="lang", regex="en|de"),
    TreeRule("no-bold-break", "forbid", "no break has children", Node(("br",), (Node(("b",)),))),
    TreeRule("no-font", "forbid", "no fonts", Node(("font",)), dialects=("html",)),
    TreeRule("no-nav", "forbid", "no navigation", Node(("nav",))),
]
ANALYSES = {name: [TreeRule(name, "analysis", f"[{name}]", analyzer=name)] for name in ("exclusive-members", "exclusive-flags", "closed-domain", "unchanged-values", "known-values")}


#: Order lines that a task gets, about.
LINES = 200_000


def _pages(spark, sf_dir) -> DataFrame:
    return markup.by_page(load(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html")


def _tree(spark, sf_dir) -> DataFrame:
    """Written once, as each node of a pattern reads it."""
    return written(markup.markup_tree(_pages(spark, sf_dir), "page_id", "html"))


def p4_markup_tree(spark, sf_dir):
    """Elements with their order, attributes and text."""
    return _tree(spark, sf_dir).select("page_id", "pre", "last", "parent", F.col("ord").cast("int").alias("ord"), "type", F.col("attrs")["href"].alias("href"), F.coalesce(F.col("attrs")["lang"], F.col("attrs")["class"]).alias("other"), F.md5("text").alias("text_md5"))


def r1_nested(spark, sf_dir):
    return matches(_tree(spark, sf_dir), "page_id", LINKED_ITEM).select("page_id", "pre", F.col("item.pre").alias("item"), F.col("link.pre").alias("link"), F.col("link.text").alias("text"))


def r1_alternatives(spark, sf_dir):
    return matches(_tree(spark, sf_dir), "page_id", HEADING).select("page_id", "pre", F.col("name.pre").alias("name"), F.col("name.type").alias("type"))


def r1_anchored(spark, sf_dir):
    return matches(_tree(spark, sf_dir), "page_id", OPENING).select("page_id", "pre", F.col("h.pre").alias("h"), F.col("p.pre").alias("p"))


def r1_without(spark, sf_dir):
    return matches(_tree(spark, sf_dir), "page_id", PLAIN_PART).select("page_id", "pre", F.md5("p.text").alias("text_md5"))


def r2_siblings(spark, sf_dir):
    """Children in order, with others between; each way to choose them is a match."""
    return matches(_tree(spark, sf_dir), "page_id", BODY_PARTS).select("page_id", "pre", F.col("first.pre").alias("first"), F.col("ad.pre").alias("ad"), F.col("then.type").alias("then"))


def _lines_by_page(spark, sf_dir) -> DataFrame:
    """Lines dealt by their orders, LINES a task: all that follows stays within orders, and needs no other shuffle."""
    lines = load(spark, sf_dir, "lineitem").withColumn("page", F.col("l_orderkey"))
    return lines.repartition(max(spark.sparkContext.defaultParallelism, -(-lines.count() // LINES)), "page")


def _order_lines(spark, sf_dir, line, begin, end="</order>") -> DataFrame:
    """(page, html): a page for each order, with what line gives for each of its lines in order."""
    lines = _lines_by_page(spark, sf_dir).select("page", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", line.alias("text")).alias("line"), "l_linestatus")
    # an order has few lines
    per = lines.groupBy("page").agg(F.sort_array(F.collect_list("line")).alias("lines"), F.max("l_linestatus").alias("status"))
    end = F.when(F.col("page") % 5 == 0, "").otherwise(end)
    return per.select("page", F.concat(begin, F.array_join(F.col("lines.text"), ""), end).alias("html"))


def _marked_orders(spark, sf_dir) -> DataFrame:
    part = lambda name, value: F.concat(F.lit(f' {name}="'), value, F.lit('"'))
    some = lambda name, when: F.when(when, part(name, F.lit("yes"))).otherwise("")
    flag = lambda name, when: part(name, F.when(when, "true").otherwise("false"))
    returned, opened = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    tens = F.when(F.col("l_quantity") > 45, "{n}").otherwise(F.floor(F.col("l_quantity") / 10).cast("string"))
    c = F.when(F.col("l_linenumber") == 7, part("c", F.lit("{x}"))).otherwise(flag("c", opened))
    key = F.concat(F.lit("k"), (F.col("l_partkey") % 5).cast("string"))
    close = F.when(F.col("l_orderkey") % 4 == 1, "/>").otherwise("></item>")
    item = F.concat(F.lit("<item"), part("n", F.col("l_linenumber").cast("string")), some("returned", returned), some("open", opened), some("bulk", F.col("l_quantity") > 40), flag("a", returned), flag("b", F.col("l_returnflag") == "A"), c, part("flag", F.col("l_returnflag")), part("status", F.col("l_linestatus")), part("size", tens), part("id", key), part("value", (F.col("l_suppkey") % 3).cast("string")), close)
    change = F.when(F.col("l_discount") > 0.08, F.concat(F.lit("<set"), part("ref", key), F.lit("></set>"))).otherwise("")
    return _order_lines(spark, sf_dir, F.concat(item, change), F.concat(F.lit("<order"), part("status", F.col("status")), F.lit(">")))


def _listed_orders(spark, sf_dir) -> DataFrame:
    item = F.format_string('<item name="p%d" value="%d"></item>', F.col("l_partkey") % 7, F.col("l_suppkey") % 4)
    use = F.format_string('<use kind="m" value="%d"></use>', F.col("l_linenumber") % 4)
    lines = _lines_by_page(spark, sf_dir).select("page", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", item.alias("item"), use.alias("use")).alias("line"))
    per = lines.groupBy("page").agg(F.sort_array(F.collect_list("line")).alias("l"))
    of = lambda c: F.array_join(F.col(f"l.{c}"), "")
    twice = F.when(F.size("l") > 5, '<kind id="m" of="other"></kind>').otherwise("")
    return per.select("page", F.concat(F.lit('<doc><list id="modes">'), of("item"), F.lit('</list><kind id="m" of="modes"></kind>'), twice, of("use"), F.lit("</doc>")).alias("html"))


def p5_syntax(spark, sf_dir):
    """Whether pages are well-formed, and how many of their tags are not matched."""
    return markup.dialect_of(_pages(spark, sf_dir), "page_id", "html")


def p5_tag_errors(spark, sf_dir):
    found = markup.syntax_errors(markup.tags(_pages(spark, sf_dir), "page_id", "html", F.lit("html")), "page_id")
    return found.groupBy("page_id", "type", "error").agg(F.count("*").alias("n"))


def p7_dialects(spark, sf_dir):
    """Pages that are read again in another dialect, as they have errors in the first."""
    return markup.dialect_of(_marked_orders(spark, sf_dir), "page", "html")


def _shown(found, id_col):
    line = lambda v: F.concat_ws(":", v["pre"].cast("string"), v["rule_id"])
    return found.select(id_col, "dialect", "syntax_ok", "passed", F.array_join("checked_rules", ",").alias("checked"), F.array_join("skipped_rules", ",").alias("skipped"), F.array_join(F.transform("violations", line), ",").alias("found"))


def r10_tree_report(spark, sf_dir):
    """Reports of pages under rules on trees, some of which a dialect cannot hold; half of the pages say they are xhtml."""
    pages = _pages(spark, sf_dir)
    verdict = written(markup.dialect_of(pages, "page_id", "html", F.when(F.col("page_id") % 2 == 0, "xhtml")))
    found = tree_rules.violations(_tree(spark, sf_dir), verdict, TREE_RULES, "page_id")
    return _shown(tree_rules.reports(verdict, found, TREE_RULES, "page_id"), "page_id")


def r13_order_report(spark, sf_dir):
    """A page passes only if it is well-formed and nothing was found."""
    rows = [TreeRule("no-set", "forbid", "nothing is set", Node(("set",))), *ANALYSES["exclusive-members"]]
    known = spark.createDataFrame([(d, t, True) for d in markup.DIALECTS for t in ("item", "order", *(["set"] if d == "html" else []))], "dialect string, type string, holds boolean")
    pages = _marked_orders(spark, sf_dir)
    verdict = written(markup.dialect_of(pages, "page", "html"))
    tree = written(markup.markup_tree(pages.join(verdict.select("page", "dialect"), "page"), "page", "html", F.col("dialect")))
    return _shown(tree_rules.reports(verdict, tree_rules.violations(tree, verdict, rows, "page", known), rows, "page", known), "page")


def r3_tree_violations(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return tree_rules.violations(_tree(spark, sf_dir), pages.select("page_id", F.lit("html").alias("dialect")), TREE_RULES, "page_id")


def _analysis(spark, sf_dir, name, pages):
    dialect = F.when(F.col("page") % 4 == 1, "xhtml").otherwise("html")
    tree = markup.markup_tree(pages, "page", "html", dialect)
    found = tree_rules.violations(tree, pages.select("page", dialect.alias("dialect")), ANALYSES[name], "page")
    return found.select("page", "message", "pre", "type")


def a1_exclusive_members(spark, sf_dir):
    return _analysis(spark, sf_dir, "exclusive-members", _marked_orders(spark, sf_dir))


def a3_exclusive_flags(spark, sf_dir):
    return _analysis(spark, sf_dir, "exclusive-flags", _marked_orders(spark, sf_dir))


def a4_closed_domains(spark, sf_dir):
    return _analysis(spark, sf_dir, "closed-domain", _marked_orders(spark, sf_dir))


def a6_unchanged_values(spark, sf_dir):
    return _analysis(spark, sf_dir, "unchanged-values", _marked_orders(spark, sf_dir))


def a7_known_values(spark, sf_dir):
    return _analysis(spark, sf_dir, "known-values", _listed_orders(spark, sf_dir).select("page", "html"))


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and name[0] in "apr" and name[1].isdigit()}

# ---------------------------------------------------------------- SQL

_VOID = "('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr')"
_TAG = "<(/?[a-zA-Z][a-zA-Z0-9]*)([^>]*)>([^<]*)"


def _steps(dialect: str) -> str:
    """Tags of pages under a dialect, with their level."""
    html = f"lower(ltrim(tag, '/')) IN {_VOID}"
    alone = html if dialect == "html" else "rest LIKE '%/'"
    dropped = f"NOT ({html} AND tag LIKE '/%')" if dialect == "html" else "TRUE"
    return f"""tg AS (SELECT page_id, unnest(regexp_extract_all(html, '{_TAG}', 1)) AS tag, unnest(regexp_extract_all(html, '{_TAG}', 2)) AS rest, unnest(regexp_extract_all(html, '{_TAG}', 3)) AS text, unnest(range(len(regexp_extract_all(html, '{_TAG}', 1)))) AS pos FROM pages),
sp AS (SELECT page_id, pos, lower(ltrim(tag, '/')) AS type, rest, text, CASE WHEN tag LIKE '/%' THEN -1 WHEN {alone} THEN 0 ELSE 1 END AS step FROM tg WHERE {dropped}),
lv AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY pos) - greatest(step, 0) AS level, sum(CASE WHEN step >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS pre FROM sp)"""


_TREE = _steps("html") + """,
nd AS (SELECT * FROM (SELECT page_id, pos, pre::INT AS pre, (CASE WHEN step = 0 THEN pre ELSE coalesce(lead(pre) OVER (PARTITION BY page_id, level ORDER BY pos), max(pre) OVER (PARTITION BY page_id)) END)::INT AS last, level, step, type, rest, text FROM lv) WHERE step >= 0),
np AS (SELECT n.*, (SELECT max(p.pre) FROM nd p WHERE p.page_id = n.page_id AND p.level = n.level - 1 AND p.step = 1 AND p.pre < n.pre) AS parent FROM nd n),
tr AS (SELECT *, (row_number() OVER (PARTITION BY page_id, parent ORDER BY pre) - 1)::INT AS ord, nullif(regexp_extract(rest, 'href="([^"]*)"', 1), '') AS href, nullif(regexp_extract(rest, 'lang="([^"]*)"', 1), '') AS lang, nullif(regexp_extract(rest, 'class="([^"]*)"', 1), '') AS class FROM np)"""


def _errors(dialect: str) -> str:
    return f"""{_steps(dialect)},
pr AS (SELECT *, lag(type) OVER w AS bt, lag(step) OVER w AS bs, lead(type) OVER w AS nt, lead(step) OVER w AS ns FROM lv WHERE step <> 0 WINDOW w AS (PARTITION BY page_id, level ORDER BY pos)),
er AS (SELECT page_id, type, CASE WHEN step = -1 THEN 'ends nothing' ELSE 'has no end' END AS error FROM pr WHERE CASE WHEN step = -1 THEN NOT coalesce(bt = type AND bs = 1, FALSE) ELSE NOT coalesce(nt = type AND ns = -1, FALSE) END)"""


def _count_errors(dialect: str) -> str:
    return f"(WITH {_errors(dialect)} SELECT page_id, count(*) AS n FROM er GROUP BY page_id)"


_LINES = "ln AS (SELECT l_orderkey AS page, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_quantity AS q, l_discount AS d, l_returnflag AS f, l_linestatus AS st, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem)"
# Lines of marked orders with the number of their element: the order is the first, and each item may have a set after it
_MARKED = _LINES + ", it AS (SELECT *, 'k' || p % 5 AS k, (s % 3)::VARCHAR AS v, (1 + r + coalesce(sum(CASE WHEN d > 0.08 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS pre FROM ln)"
_MEMBERS = "mb AS (SELECT page, r, pre, unnest(['n', 'returned', 'open', 'bulk', 'a', 'b', 'c', 'flag', 'status', 'size', 'id', 'value']) AS name, unnest([n::VARCHAR, CASE WHEN f = 'R' THEN 'yes' END, CASE WHEN st = 'O' THEN 'yes' END, CASE WHEN q > 40 THEN 'yes' END, CASE WHEN f = 'R' THEN 'true' ELSE 'false' END, CASE WHEN f = 'A' THEN 'true' ELSE 'false' END, CASE WHEN n = 7 THEN '{x}' WHEN st = 'O' THEN 'true' ELSE 'false' END, f, st, CASE WHEN q > 45 THEN '{n}' ELSE floor(q / 10)::INT::VARCHAR END, k, v]) AS value FROM it), ms AS (SELECT 'item' AS type, * FROM mb WHERE value IS NOT NULL UNION ALL SELECT 'set', page, r, pre + 1, 'ref', k FROM it WHERE d > 0.08), el AS (SELECT page, type, count(DISTINCT pre) AS n, min(pre) AS first FROM ms GROUP BY ALL)"
_EXCLUSIVE = f"{_MARKED}, {_MEMBERS}, op AS (SELECT page, type, name FROM (SELECT page, type, name, count(*) AS uses FROM ms GROUP BY ALL) JOIN el USING (page, type) WHERE uses < n), st AS (SELECT page, type, pre, list_sort(list(name)) AS names FROM ms JOIN op USING (page, type, name) GROUP BY page, type, pre), ds AS (SELECT DISTINCT page, type, names FROM st), ex AS (SELECT page, type, string_agg('{{' || array_to_string(names, ', ') || '}}', ' / ' ORDER BY names) AS groups FROM ds GROUP BY page, type HAVING count(*) >= 2 AND sum(len(names)) = len(list_distinct(flatten(list(names)))))"
_RULE_ROWS = f"""WITH {_TREE}, vi AS (
SELECT page_id, 'capital-link' AS rule_id, 'links are lower-case' AS message, 'error' AS severity, pre, type, substr(text, 1, 200) AS snippet FROM tr WHERE type = 'a' AND regexp_matches(href, '^/[A-Z]')
UNION ALL SELECT page_id, 'has-figure', 'a page has a figure', 'error', 0, '', '' FROM pages WHERE page_id NOT IN (SELECT page_id FROM tr WHERE type = 'figure')
UNION ALL SELECT page_id, 'break-in-part', 'an article has a break', 'warning', pre, type, substr(text, 1, 200) FROM tr a WHERE type = 'article' AND NOT EXISTS (SELECT 1 FROM tr b WHERE b.page_id = a.page_id AND b.type = 'br' AND b.pre BETWEEN a.pre AND a.last)
UNION ALL SELECT page_id, 'plain-language', 'a language is English or German (got ''' || lang || ''')', 'error', pre, type, lang FROM tr WHERE type = 'html' AND lang NOT IN ('en', 'de')
UNION ALL SELECT page_id, 'no-nav', 'no navigation', 'error', pre, type, substr(text, 1, 200) FROM tr WHERE type = 'nav')"""

ORACLE_SQL = {
    "p4_markup_tree": f"WITH {_TREE} SELECT page_id, pre, last, parent, ord, type, href, coalesce(lang, class) AS other, md5(text) AS text_md5 FROM tr",
    "r1_nested": f"WITH {_TREE} SELECT u.page_id, u.pre, l.pre AS item, a.pre AS link, a.text FROM tr u JOIN tr l ON l.page_id = u.page_id AND l.parent = u.pre JOIN tr a ON a.page_id = l.page_id AND a.parent = l.pre WHERE u.type = 'ul' AND l.type = 'li' AND a.type = 'a'",
    "r1_alternatives": f"WITH {_TREE} SELECT p.page_id, p.pre, c.pre AS name, c.type FROM tr p JOIN tr c ON c.page_id = p.page_id AND c.parent = p.pre WHERE p.type IN ('article', 'head') AND (c.type = 'h1' AND regexp_matches(c.text, '[A-Z]{{2}}') OR c.type = 'title' AND NOT regexp_matches(c.text, '[A-Z]{{2}}'))",
    "r1_anchored": f"WITH {_TREE} SELECT a.page_id, a.pre, h.pre AS h, p.pre AS p FROM tr a JOIN tr h ON h.page_id = a.page_id AND h.parent = a.pre AND h.ord = 0 JOIN tr p ON p.page_id = a.page_id AND p.parent = a.pre AND p.ord = 1 WHERE a.type = 'article' AND h.type = 'h1' AND p.type = 'p'",
    "r1_without": f"WITH {_TREE} SELECT page_id, pre, md5(text) AS text_md5 FROM tr p WHERE type = 'p' AND contains(text, '.') AND NOT EXISTS (SELECT 1 FROM tr c WHERE c.page_id = p.page_id AND c.parent = p.pre AND c.type IN ('b', 'br'))",
    "r2_siblings": f"WITH {_TREE} SELECT b.page_id, b.pre, n.pre AS first, d.pre AS ad, t.type AS then FROM tr b JOIN tr n ON n.page_id = b.page_id AND n.parent = b.pre JOIN tr d ON d.page_id = b.page_id AND d.parent = b.pre AND d.ord > n.ord JOIN tr t ON t.page_id = b.page_id AND t.parent = b.pre AND t.ord > d.ord WHERE b.type = 'body' AND n.type = 'nav' AND d.type = 'div' AND d.class = 'ad' AND t.type IN ('article', 'footer')",
    "p5_syntax": f"SELECT p.page_id, CASE WHEN a.n IS NOT NULL AND b.n IS NULL THEN 'xhtml' ELSE 'html' END AS dialect, a.n IS NULL OR b.n IS NULL AS syntax_ok, CASE WHEN b.n IS NULL THEN 0 ELSE coalesce(a.n, 0) END AS errors FROM pages p LEFT JOIN {_count_errors('html')} a USING (page_id) LEFT JOIN {_count_errors('xhtml')} b USING (page_id)",
    "p5_tag_errors": f"WITH {_errors('html')} SELECT page_id, type, error, count(*) AS n FROM er GROUP BY ALL",
    "p7_dialects": f"WITH {_LINES} SELECT page, CASE WHEN page % 4 = 1 AND page % 5 <> 0 THEN 'xhtml' ELSE 'html' END AS dialect, page % 5 <> 0 AS syntax_ok, CASE WHEN page % 5 <> 0 THEN 0 WHEN page % 4 <> 1 THEN 1 ELSE 1 + count(*) END AS errors FROM ln GROUP BY page",
    "r3_tree_violations": f"{_RULE_ROWS} SELECT * FROM vi",
    "r10_tree_report": f"{_RULE_ROWS}, dl AS (SELECT p.page_id, CASE WHEN p.page_id % 2 = 0 OR a.n IS NOT NULL AND b.n IS NULL THEN 'xhtml' ELSE 'html' END AS dialect, CASE WHEN p.page_id % 2 = 0 THEN b.n IS NULL ELSE a.n IS NULL OR b.n IS NULL END AS syntax_ok FROM pages p LEFT JOIN {_count_errors('html')} a USING (page_id) LEFT JOIN {_count_errors('xhtml')} b USING (page_id)), fd AS (SELECT page_id, string_agg(pre || ':' || rule_id, ',' ORDER BY pre, rule_id) AS found FROM vi JOIN dl USING (page_id) WHERE dialect = 'html' OR rule_id IN ('capital-link', 'plain-language') GROUP BY page_id) SELECT page_id, dialect, syntax_ok, syntax_ok AND found IS NULL AS passed, CASE dialect WHEN 'html' THEN 'capital-link,has-figure,break-in-part,plain-language,no-nav' ELSE 'capital-link,plain-language' END AS checked, CASE dialect WHEN 'html' THEN 'no-bold-break,no-font' ELSE 'has-figure,break-in-part,no-bold-break,no-nav' END AS skipped, coalesce(found, '') AS found FROM dl LEFT JOIN fd USING (page_id)",
    "a1_exclusive_members": f"WITH {_EXCLUSIVE} SELECT page, '[exclusive-members]: ' || type || ' is used with ' || groups AS message, first AS pre, type FROM ex JOIN el USING (page, type)",
    "a3_exclusive_flags": f"WITH {_MARKED}, {_MEMBERS}, fg AS (SELECT DISTINCT page, type, name FROM ms WHERE value IN ('true', 'false')), ps AS (SELECT page, type, pre, count_if(value = 'true') AS n, max(CASE WHEN value = 'true' THEN name END) AS alone, bool_or(value NOT IN ('true', 'false')) AS dynamic FROM ms JOIN fg USING (page, type, name) GROUP BY ALL), pg AS (SELECT page, type, max(n) AS most, bool_or(dynamic) AS dynamic, list_sort(list_distinct(list(alone))) AS alone FROM ps GROUP BY ALL) SELECT page, '[exclusive-flags]: ' || type || ' is never set to two of ' || array_to_string(alone, ', ') AS message, first AS pre, type FROM pg JOIN el USING (page, type) WHERE most = 1 AND NOT dynamic AND len(alone) >= 2 AND (SELECT count(*) FROM fg WHERE fg.page = pg.page AND fg.type = pg.type) >= 2",
    "a4_closed_domains": f"WITH {_MARKED}, {_MEMBERS}, us AS (SELECT page, type, name, count(*) AS uses, bool_and(NOT contains(value, '{{')) AS closed, list_sort(list_distinct(list(value))) AS vals FROM ms GROUP BY ALL) SELECT page, '[closed-domain]: ' || type || '.' || name || ' is one of ' || array_to_string(vals, ' | ') AS message, first AS pre, type FROM us JOIN el USING (page, type) WHERE uses = n AND uses >= 2 AND closed AND len(vals) >= 2 AND name <> 'status'",
    "a6_unchanged_values": f"WITH {_MARKED}, on_ AS (SELECT page, k FROM it GROUP BY ALL HAVING count(*) = 1) SELECT page, '[unchanged-values]: ' || k || ' is always ' || v AS message, pre, 'item' AS type FROM it JOIN on_ USING (page, k) WHERE NOT EXISTS (SELECT 1 FROM it c WHERE c.page = it.page AND c.k = it.k AND c.d > 0.08)",
    "a7_known_values": f"WITH {_LINES}, fi AS (SELECT page, s % 4 AS v, arg_min('p' || p % 7, r) AS name FROM ln GROUP BY ALL), sz AS (SELECT page, count(*) AS n FROM ln GROUP BY page HAVING count(*) <= 5) SELECT page, '[known-values]: ' || v || ' is modes.' || name AS message, (3 + n + r)::INT AS pre, 'use' AS type FROM (SELECT page, n % 4 AS v, r FROM ln) u JOIN sz USING (page) JOIN fi USING (page, v)",
    "r13_order_report": f"WITH {_EXCLUSIVE}, vi AS (SELECT page, first AS pre, 'exclusive-members' AS rule_id FROM ex JOIN el USING (page, type) UNION ALL SELECT page, pre + 1, 'no-set' FROM it WHERE d > 0.08 AND NOT (page % 4 = 1 AND page % 5 <> 0)), fd AS (SELECT page, string_agg(pre || ':' || rule_id, ',' ORDER BY pre, rule_id) AS found FROM vi GROUP BY page), pg AS (SELECT DISTINCT page, CASE WHEN page % 4 = 1 AND page % 5 <> 0 THEN 'xhtml' ELSE 'html' END AS dialect, page % 5 <> 0 AS syntax_ok FROM ln) SELECT page, dialect, syntax_ok, syntax_ok AND found IS NULL AS passed, CASE dialect WHEN 'html' THEN 'no-set,exclusive-members' ELSE 'exclusive-members' END AS checked, CASE dialect WHEN 'html' THEN '' ELSE 'no-set' END AS skipped, coalesce(found, '') AS found FROM pg LEFT JOIN fd USING (page)",
}
