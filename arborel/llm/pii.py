"""Personal data: rule spans, and spans that boosted trees choose among candidates of high-recall generators.

All row work is in built-in functions, without a shuffle. Positions come from what lies between matches: the texts that
a split leaves and the matches themselves alternate, so a match ends where the sum of both reaches.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborel.functions.columns import let, running

#: The base rules. Where a rule's match always covers a whole run of its characters, the pattern starts only at a run's
#: beginning (or where the last match ended) and never gives characters back, so long runs cost no more than their length.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Candidates: anything around an at sign, runs of digits and their separators, long tokens with a digit. Each is a whole
#: run of any length: handles and secrets start only at a run's beginning and give nothing back, and of the starts of a
#: number only the few before its seventh character can fail, so a run costs a small multiple of its length.
GENERATORS = {
    "handle": r"(?<![^\s<>\"'(),;:@])[^\s<>\"'(),;:@]++@[^\s<>\"'(),;:@]{3,}+",
    "number": r"(?<![0-9A-Za-z])[+(]?[0-9][0-9 ().-]{5,}[0-9](?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+",
}
_NEEDS = {"email": "@", "handle": "@", "phone": "+"}
_ASSIGNED = r"[=:]\s?[\"']?$"
_CONTEXT = r"(?i)(password|passwd|secret|token|api.?key|access.?key|mail|phone|tel|card|address)\W{0,4}$"
FEATURES = ("generator", "length", "digits", "dots", "domain", "opening", "luhn", "letters", "context", "assigned", "hex")
#: What a weak label tests is no feature of its generator: trees learn how else such candidates look.
HIDDEN = {"handle": ("domain",), "number": ("opening", "luhn"), "secret": ("context", "assigned")}
#: Parts of the documents that calibrate in turn.
FOLDS = 5
TREES, RATE, PRECISION = 20, 0.4, 0.98
#: Fixed value: the mark that a decoder takes for the byte order.
_ORDER = "0000FEFF"


def _count(x: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(x, pattern, ""))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = _digits(x)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(d, F.length(d) - i, F.lit(1)).try_cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 0, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.length(d).between(16, 19) & (F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0)


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.coalesce(F.coalesce(F.nullif(F.ltrim(p, F.lit("0")), F.lit("")), F.lit("0")).try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return _luhn(x)
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


_SPANS = "array<struct<s:int,e:int,x:string,before:string>>"


def _spans(m: Column, gaps: Column) -> Column:
    """Spans of matches m with the end of what stands before each; gaps: the texts before them."""
    steps = F.zip_with(gaps, m, lambda g, x: F.struct((F.length(g) + F.length(x)).alias("n"), F.length(x).alias("own"), x.alias("x"), F.substring(g, -16, 16).alias("before")))
    found = let(steps, lambda rows: F.zip_with(rows, running(rows, F.lit(0), lambda r: r["n"], lambda a, n: a + n), lambda r, a: F.struct((a + r["n"] - r["own"]).alias("s"), (a + r["n"]).alias("e"), r["x"].alias("x"), r["before"].alias("before"))))
    return F.when(F.size(m) > 0, found).otherwise(F.array()).cast(_SPANS)


def _apart(found: Column, taken: Column) -> Column:
    """Those of found that overlap none of taken, by one sweep over both in the order of their starts."""

    def kept(rows: Column) -> Column:
        before = running(rows, F.lit(0), lambda r: F.when(r["i"] < 0, r["e"]).otherwise(0), F.greatest)
        after = let(F.reverse(rows), lambda back: F.reverse(running(back, F.lit(2**31 - 1), lambda r: F.when(r["i"] < 0, r["s"]).otherwise(2**31 - 1), F.least)))
        free = F.zip_with(rows, F.arrays_zip(before.alias("before"), after.alias("after")), lambda r, n: F.when((r["i"] >= 0) & (n["before"] <= r["s"]) & (n["after"] >= r["e"]), r["i"]))
        return F.transform(F.array_sort(F.array_compact(free)), lambda i: F.get(found, i))

    place = lambda c, i: F.struct(c["s"].alias("s"), c["e"].alias("e"), i.alias("i"))
    both = F.array_sort(F.concat(F.transform(taken, lambda c: place(c, F.lit(-1))), F.transform(found, place)))
    return F.when((F.size(found) > 0) & (F.size(taken) > 0), let(both, kept)).otherwise(found)


def _features(generator: str, c: Column) -> Column:
    x, before = c["x"], c["before"]
    d, n = F.length(_digits(x)), F.length(x)
    dots = n - _count(x, r"\.")
    lower, upper = x.rlike("[a-z]"), x.rlike("[A-Z]")
    bins = lambda v, *cuts: sum(((v >= k).cast("int") for k in cuts), F.lit(0))
    values = {
        "generator": F.lit(list(GENERATORS).index(generator)),
        "length": bins(n, 12, 16, 20, 28, 40),
        "digits": bins(d, 1, 4, 7, 8, 16, 20),
        "dots": F.least(dots, F.lit(4)),
        "domain": x.rlike(r"@(?:[^@.]++\.)++[A-Za-z]{2,}+$"),
        "opening": F.when(x.startswith("+"), 2).when(x.startswith("("), 1).otherwise(0),
        "luhn": _luhn(x),
        "letters": lower.cast("int") + 2 * upper.cast("int"),
        "context": before.rlike(_CONTEXT),
        "assigned": before.rlike(_ASSIGNED),
        "hex": x.rlike(r"^[0-9a-f]{12,}+$"),
    }
    return F.array(*(F.lit(0) if f in HIDDEN[generator] else values[f].cast("int") for f in FEATURES))


def _candidates(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with the base spans by kind and, for each generator, its candidates with their features. Names that begin
    with an underscore are its own."""
    both = BASE | GENERATORS
    df = docs.withColumn("_t", F.coalesce(text_col, F.lit("")))
    found = {}
    for kind, pattern in both.items():
        m = F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))
        found[f"_m_{kind}"] = F.when(F.contains("_t", F.lit(_NEEDS[kind])), m).otherwise(F.array().cast("array<string>")) if kind in _NEEDS else m
    df = df.withColumns(found)
    gaps = {f"_g_{k}": F.when(F.size(f"_m_{k}") > 0, F.slice(F.split("_t", pattern, -1), F.lit(1), F.size(f"_m_{k}"))).otherwise(F.array().cast("array<string>")) for k, pattern in both.items()}
    df = df.withColumns(gaps)
    spans = {f"_s_{k}": _spans(F.col(f"_m_{k}"), F.col(f"_g_{k}")) for k in both}
    df = df.withColumns(spans).withColumns({f"_s_{k}": F.filter(f"_s_{k}", lambda c: _valid(k, c["x"])) for k in BASE})
    df = df.withColumn("_base", F.concat(*(F.transform(f"_s_{k}", lambda c: F.struct(F.lit(k).alias("kind"), c["s"].alias("s"), c["e"].alias("e"))) for k in BASE)))
    scored = {}
    for k in GENERATORS:
        scored[f"_c_{k}"] = F.transform(f"_s_{k}", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["x"].alias("x"), c["before"].alias("before"), _features(k, c).alias("f")))
    return df.withColumns(scored)


def _weak_label(generator: str, c: Column) -> Column:
    """What training takes for personal: of handles and numbers what is mostly a valid e-mail, address, card or phone, of
    secrets what is assigned to a telling name, and cloud keys by their fixed opening. None of this is a feature."""
    if generator == "secret":
        return (c["before"].rlike(_CONTEXT) & c["before"].rlike(_ASSIGNED)) | c["x"].rlike(r"^AKIA[0-9A-Z]{16}$")
    rules = {"handle": ("email",), "number": ("ip", "card", "phone")}[generator]
    whole = lambda kind: F.regexp_extract_all(c["x"], F.lit(BASE[kind]), F.lit(0))
    return reduce(lambda a, b: a | b, (F.exists(whole(kind), lambda x: _valid(kind, x) & (2 * F.length(x) > F.length(c["x"]))) for kind in rules))


class Trees:
    """Boosted trees of two levels over small integer features: [(feature, cut, (feature, cut, low, high), (...))]."""

    def __init__(self, trees: list, bias: float, threshold: float):
        self.trees, self.bias, self.threshold = trees, bias, threshold
        self.thresholds: dict[str, float] = {}  # of generators; threshold holds for others

    def column(self, f: Column) -> Column:
        """The score of a feature array."""
        total = F.lit(self.bias)
        for a, cut, low, high in self.trees:
            leaf = lambda n: F.when(f[n[0]] <= n[1], n[2]).otherwise(n[3])
            total = total + F.when(f[a] <= cut, leaf(low)).otherwise(leaf(high))
        return total

    def scores(self, X: np.ndarray) -> np.ndarray:
        out = np.full(len(X), self.bias)
        for a, cut, low, high in self.trees:
            first = X[:, a] <= cut
            for n, at in ((low, first), (high, ~first)):
                out[at] += np.where(X[at, n[0]] <= n[1], n[2], n[3])
        return out


def boost(X: np.ndarray, count: np.ndarray, positive: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss on kinds of candidates (rows of X) with their counts and positives."""
    bias = float(np.log((positive.sum() + 1) / (count.sum() - positive.sum() + 1)))
    model = Trees([], bias, 0.0)

    def best(at: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
        top = (-1.0, 0, -1)
        whole = g[at].sum() ** 2 / (h[at].sum() + 1)
        for j in range(X.shape[1]):
            gj = np.bincount(X[at, j], weights=g[at], minlength=16).cumsum()
            hj = np.bincount(X[at, j], weights=h[at], minlength=16).cumsum()
            gain = gj**2 / (hj + 1) + (gj[-1] - gj) ** 2 / (hj[-1] - hj + 1) - whole
            k = int(gain[:-1].argmax())
            top = max(top, (float(gain[k]), j, k))
        return top

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-model.scores(X)))
        g, h = positive - count * p, count * p * (1 - p)
        _, a, cut = best(np.ones(len(X), bool), g, h)
        nodes = []
        for at in (X[:, a] <= cut, X[:, a] > cut):
            _, j, k = best(at, g, h)
            low = at & (X[:, j] <= k)
            high = at & ~low
            nodes.append((j, k, *(float(RATE * g[s].sum() / (h[s].sum() + 1)) for s in (low, high))))
        model.trees.append((a, cut, *nodes))
    model.threshold = calibrated(model.scores(X), count, positive)
    return model


def calibrated(score: np.ndarray, count: np.ndarray, positive: np.ndarray) -> float:
    """A score from which on a share of PRECISION is positive, halfway between the last such one and the next lower;
    infinite if there is none."""
    order = np.argsort(-score)
    s, right = score[order], positive[order].cumsum()
    last = np.append(s[1:] < s[:-1], True)[: len(s)]  # of equal scores all or none are chosen
    good = np.flatnonzero((right >= PRECISION * count[order].cumsum()) & last & (right > 0))
    return float((s[good[-1]] + s[min(good[-1] + 1, len(s) - 1)]) / 2) if len(good) else float("inf")


def fit(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> Trees:
    """Trees from the candidates of all documents, counted by their features, of which there are few kinds. Each generator
    has its own threshold, set on scores from trees that have not seen the document: each of FOLDS parts of the documents is
    scored by trees that the other parts give."""
    hashed = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("pii"))
    own = docs.select(F.col(text_col).alias("text"), F.pmod(F.xxhash64(hashed), F.lit(FOLDS)).alias("fold"))
    seen = F.concat(*(F.transform(f"_c_{k}", lambda c: F.struct(c["f"].alias("f"), _weak_label(k, c).cast("int").alias("y"))) for k in GENERATORS))
    kinds = _candidates(own, "text").select("fold", F.explode(seen).alias("c")).groupBy("c.f", "fold").agg(F.count("*").alias("n"), F.sum("c.y").alias("p")).orderBy("f", "fold").collect()
    if not kinds:
        return Trees([], 0.0, float("inf"))
    X, n, y = np.array([r["f"] for r in kinds], int), np.array([r["n"] for r in kinds], float), np.array([r["p"] for r in kinds], float)
    fold = np.array([r["fold"] for r in kinds])
    model, score = boost(X, n, y), np.zeros(len(X))
    for part in (fold == k for k in np.unique(fold)):
        score[part] = (boost(X[~part], n[~part], y[~part]) if not part.all() else model).scores(X[part])
    for i, k in enumerate(GENERATORS):
        of = X[:, FEATURES.index("generator")] == i
        model.thresholds[k] = calibrated(score[of], n[of], y[of])
    return model


def _found(docs: DataFrame, model: Trees, text_col: str) -> DataFrame:
    """docs' columns as c0, c1 and so on, with _base and _found."""
    df = _candidates(docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), f"c{docs.columns.index(text_col)}")
    spans = F.col("_base")
    for i, k in enumerate(GENERATORS):
        least = F.lit(model.thresholds.get(k, model.threshold))
        good = F.filter(f"_c_{k}", lambda c: model.column(c["f"]) >= least)
        df = df.withColumn(f"_good{i}", good)
        df = df.withColumn(f"_a{i}", F.concat(spans, F.transform(_apart(F.col(f"_good{i}"), spans), lambda c: F.struct(F.lit(k).alias("kind"), c["s"].alias("s"), c["e"].alias("e")))))
        spans = F.col(f"_a{i}")
    return df.withColumn("_found", spans)


def find(docs: DataFrame, model: Trees, *, text_col: str = "text") -> DataFrame:
    """docs with found: array of (kind, s, e), base spans first, by kind as listed, then start; and base, the base ones.

    A candidate is added under its generator's name if its score reaches the generator's threshold and it overlaps
    neither a base span nor an added one of an earlier generator. Offsets are code points, ends exclusive. Null and
    empty texts have no spans; repeated rows are searched each; no column but the text is read. Columns of the added
    names are replaced, all others kept, whatever their names. The work grows in proportion to a text's length.
    """
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ("base", "found")]
    return _found(docs, model, text_col).select(*kept, F.col("_base").alias("base"), F.col("_found").alias("found"))


def redact(docs: DataFrame, model: Trees, *, text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """docs, with each span that find gives replaced by its kind in square brackets; size_col, if docs has it, then holds
    the characters of a changed text. All columns stay, as do null texts."""
    at = docs.columns.index(text_col)
    df = _found(docs, model, text_col).withColumn("_clean", redacted(F.col(f"c{at}"), F.col("_found")))
    chars = lambda i: F.when(F.size("_found") > 0, F.length("_clean").cast("long")).otherwise(F.col(f"c{i}"))
    return df.select(*((F.col("_clean") if i == at else chars(i) if c == size_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat(c["kind"], F.lit(":"), c["s"].cast("string"), F.lit(":"), c["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in square brackets; overlapping spans become one. Pieces are cut from
    a form of four bytes a character, where no cut has to count from the start."""

    def cut(wide: Column, a: Column, b: Column) -> Column:
        return F.decode(F.concat(F.unhex(F.lit(_ORDER)), F.substring(wide, 4 * a + 1, 4 * (b - a))), "UTF-32")

    def done(t: Column) -> Column:
        wide, order, reach = t["wide"], t["order"], t["reach"]
        pieces = F.zip_with(order, reach, lambda c, r: F.when(c["s"] >= r, F.concat(cut(wide, r, c["s"]), F.lit("["), c["kind"], F.lit("]"))).otherwise(""))
        last = F.greatest(F.element_at(order, -1)["e"], F.element_at(reach, -1))
        return F.concat(F.array_join(pieces, ""), cut(wide, last, (F.octet_length(wide) / 4).cast("int")))

    order = F.array_sort(F.transform(spans, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"))))
    parts = let(order, lambda o: F.struct(F.encode(text, "UTF-32").alias("wide"), o.alias("order"), running(o, F.lit(0), lambda c: c["e"], F.greatest).alias("reach")))
    return F.when(F.size(spans) > 0, let(parts, done)).otherwise(text)
