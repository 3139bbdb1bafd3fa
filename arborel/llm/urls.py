"""URL verdicts: prefix rules, and for what they leave open, trust and distrust propagated over the host graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborel.llm.common import dealt, stored

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Rounds between two looks at what they add, and the share of the mass below which that ends the propagation.
ROUNDS, CLOSE = 4, 1e-4
#: Distrust from which on a host's pages without a rule are blocked; a host that is blocked altogether has 1.
SHARE = 0.25
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"(?i)href\s{0,8}=\s{0,8}[\"']?((?:https?:)?//[^\"'\s<>]+)"


def _rest(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(of_host: Column, of_path: Column, rules: tuple = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r))
    fits = [((of_host == h) | of_host.endswith("." + h)) & of_path.startswith(p) for h, p, _ in ordered]
    found = [F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for h, p, v in ordered]
    return reduce(lambda chain, x: chain.when(*x), list(zip(fits, found, strict=True))[1:], F.when(fits[0], found[0]))


def host_links(pages: DataFrame, hosts: DataFrame, html_col: str) -> DataFrame:
    """(src, dst, n): how often a host refers to another: by links of its pages, and by its tie with its parent domain,
    which counts once for each of its pages, both ways."""
    target = F.concat(F.lit("x://"), F.regexp_replace(F.col("link"), r"(?i)^(?:https?:)?//", ""))
    links = pages.select("host", F.explode(F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(_HREF), F.lit(1))).alias("link"))
    links = links.select(F.col("host").alias("src"), host(target).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    up = hosts.where(F.size(F.split("host", r"\.")) > 2).select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]*\.(.*)$", 1).alias("dst"), F.col("pages").alias("n"))
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    return links.union(up).union(down).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.sum("n").alias("n"))


def flows(links: DataFrame, hosts: DataFrame, damping: float) -> tuple[DataFrame, DataFrame]:
    """(kind, src, dst, share) and (kind, host, mass): what a host's mass adds to another's in a round, and what each has
    to begin with.

    Of what a host refers to, its own pages are a part (a reference each) and its links are the rest. Trust follows
    links from hosts with allowed pages, seeded with their share of the host's pages; what comes back to a host from its own
    pages again and again is summed in closed form (a geometric series), so no edge stands for it. Distrust goes against
    links from hosts with blocked pages: a host has their share of its pages, and for the rest of them so much of the
    distrust of the hosts it links to as these links are of all that it refers to."""
    zero = F.lit(0).cast("long")
    own = hosts.select("host", "pages", "allowed", "blocked", zero.alias("out"))
    ends = links.select(F.explode(F.array(F.struct(F.col("src").alias("host"), F.col("n").alias("out")), F.struct(F.col("dst").alias("host"), zero.alias("out")))).alias("e"))
    parts = own.union(ends.select("e.host", zero, zero, zero, "e.out"))
    nodes = parts.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("pages", "allowed", "blocked", "out")))
    # a host that is only linked to has no pages here and refers to nothing
    of = lambda c, whole: F.coalesce(F.try_divide(F.col(c), whole), F.lit(0.0))
    every = F.col("pages") + F.col("out")
    nodes = nodes.select("host", every.alias("all_out"), of("allowed", F.col("pages")).alias("allowed"), of("blocked", F.col("pages")).alias("blocked"), (1 / (1 - damping * of("pages", every))).alias("again"))
    nodes = stored(nodes)
    src = nodes.select(F.col("host").alias("src"), "all_out", "blocked")
    dst = nodes.select(F.col("host").alias("dst"), "again")
    both = links.join(src, "src").join(dst, "dst")
    row = lambda kind, a, b, share: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("src"), F.col(b).alias("dst"), share.alias("share"))
    passed = damping * F.col("n") / F.col("all_out")
    forth = row("trust", "src", "dst", passed * F.col("again"))
    back = row("distrust", "dst", "src", passed * (1 - F.col("blocked")))
    edges = stored(both.select(F.explode(F.array(forth, back)).alias("e")).select("e.*").where("share > 0"))
    seed = lambda kind, mass: F.struct(F.lit(kind).alias("kind"), F.col("host"), mass.alias("mass"))
    seeds = F.array(seed("trust", (1 - damping) * F.col("allowed") * F.col("again")), seed("distrust", F.col("blocked")))
    return edges, stored(nodes.select(F.explode(seeds).alias("s")).select("s.*").where("mass > 0"))


def settled(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(kind, host, mass): start and all that edges pass on of it, until ROUNDS more rounds add less than CLOSE of the
    mass. Mass only ever grows towards its limit, so what is added is also how far hosts have moved, all together."""
    mass, before = start, start.agg(F.sum("mass")).first()[0] or 0.0
    while before:
        for _ in range(ROUNDS):
            # dealt out anew, so that the join shuffles both sides and Spark can split a host of very many edges
            of = dealt(mass.withColumnRenamed("host", "src"))
            passed = edges.join(of, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("mass") * F.col("share")).alias("mass"))
            mass = passed.union(start).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        mass = stored(mass)
        now = mass.agg(F.sum("mass")).first()[0]
        if now - before <= CLOSE * now:
            break
        before = now
    return mass


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple = RULES, damping: float = 0.85, share: float = SHARE) -> DataFrame:
    """id_col, host, path, rule (null if none fits), verdict, trust and distrust of each page's host.

    Trust is a personalised PageRank, to convergence: hosts are seeded with the share of their pages that a rule allows,
    and pass it on along links; a host that only refers to itself keeps its seed. Distrust goes against links, from hosts
    with pages that a rule blocks: 1 is a host that is blocked altogether, whatever it links to, and a host that links to
    it has less, by the share of these links among all that it refers to. Pages without a rule are blocked if their
    host's distrust exceeds its trust and is share at least; otherwise allowed.

    Null urls and those without :// have an empty host and path, which no rule fits and no graph holds: allowed. Links may
    go to hosts without a page here. Null html has no links; repeated rows count each; other columns are unused.
    """
    of = pages.select(F.col(id_col), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"), F.col(html_col).alias("_html"))
    of = of.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    hosts = stored(of.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("_rule.verdict") == "allow").alias("allowed"), F.count_if(F.col("_rule.verdict") == "block").alias("blocked")))
    links = stored(host_links(of, hosts, "_html"))
    mass = settled(*flows(links, hosts, damping))
    one = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0)).alias(kind)
    mass = stored(mass.groupBy("host").agg(one("trust"), one("distrust")))
    zero = F.lit(0.0)
    out = of.drop("_html").join(mass, "host", "left").withColumns({c: F.coalesce(c, zero) for c in ("trust", "distrust")})
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= share)
    verdict = F.coalesce("_rule.verdict", F.when(bad, "block").otherwise("allow"))
    return out.select(id_col, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")
