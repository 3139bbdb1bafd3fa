"""Quality by a generalised additive model with pairwise interactions.

A text becomes a few numbers about its form. Shallow trees on one number at a time, boosted in turns, add up to one
lookup table for each; then trees on two numbers at a time to tables for the pairs that matter most. A text's log odds are
the sum of the entries of its bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborel.llm.common import as_bytes, drawn, text_chunks
from arborel.llm.shingles import mixed, stretches, word_hashes

#: Labelled documents of each label that training may use (about).
SAMPLE_PER_LABEL = 4_000
#: Bins of a feature, and of each of two in a pair; pairs that get a table.
BINS, PAIR_BINS, PAIRS = 48, 12, 8
#: Most turns over all features, and those without a gain after which they end.
TURNS, PATIENCE = 400, 25
RATE, LEAF_WEIGHT = 0.1, 2.0
#: Bytes that are looked at together.
_SLICE = 1 << 20

_KINDS = ("upper", "lower", "digit", "stop", "mark", "symbol", "space", "line", "wide", "continued")
_KIND = np.full(256, _KINDS.index("symbol"), np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 0, 1, 2
_KIND[list(b".,;:")], _KIND[list(b"!?'\"()-")] = 3, 4
_KIND[[9, 11, 12, 13, 32]], _KIND[10] = 6, 7
_KIND[192:], _KIND[128:192] = 8, 9
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
FEATURES = ("characters", "words", "upper", "digits", "stops", "marks", "symbols", "blanks", "wide", "letters", "word_length", "capitals", "mixed_words", "odd_ends", "distinct_words", "top_word", "twins", "distinct_pairs", "lines", "distinct_lines", "line_length", "sentence_words")


def _per(of: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(of, weights=weights, minlength=n)[:n].astype(float)


def _words_of(raw: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Of each text the number of its words, of their bytes, of those that begin with a capital, hold letters and other
    signs, end in a digit or an odd sign, and end in a stop."""
    total = np.zeros((n, 6))
    blank = _BLANK[raw]
    for a, b in stretches(blank):
        part = raw[a : b + 1]
        edge = np.flatnonzero(blank[a + 1 : b + 1] != blank[a:b]) + 1
        start, end = edge[::2], edge[1::2]
        of = np.searchsorted(first, start + a, side="right") - 1
        kind = _KIND[part]
        letters = np.append(0, np.cumsum(_LETTER[part], dtype=np.int64))
        inside = letters[end] - letters[start]
        traits = (None, end - start, kind[start] == 0, (inside > 0) & (inside < end - start - 1), np.isin(kind[end - 1], [2, 4, 5]), kind[end - 1] == 3)
        total += np.stack([_per(of, n, x) for x in traits], 1)
    return total


def _runs(of: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the number of distinct hashes, and how often the most frequent one occurs."""
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (h[1:] != h[:-1]))) if len(of) else np.zeros(0, int)
    most = np.zeros(n)
    np.maximum.at(most, of[new], np.diff(np.append(new, len(of))).astype(float))
    return _per(of[new], n), most


def features(texts: list[bytes]) -> np.ndarray:
    """A row of numbers for each whole text; all finite, those of shares 0 for a text that has nothing to share."""
    n = len(texts)
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    size = np.array([len(t) for t in texts], int)
    first = np.cumsum(np.append(1, size + 1))[:-1] if n else np.zeros(0, int)
    counts = np.zeros((n, len(_KINDS)))
    for i, (a, length) in enumerate(zip(first.tolist(), size.tolist(), strict=True)):
        for b in range(a, a + length, _SLICE):
            counts[i] += np.bincount(_KIND[raw[b : min(b + _SLICE, a + length)]], minlength=len(_KINDS))
    chars = counts.sum(1) - counts[:, 9]
    share = lambda x, whole: x / np.maximum(whole, 1)
    letters = counts[:, 0] + counts[:, 1] + counts[:, 8]
    words, length, capitals, mixed_words, odd_ends, stops = (_words_of(raw, first, n)).T

    of, h = word_hashes(texts)
    distinct, top = _runs(of, h, n)
    same = of[1:] == of[:-1]
    with np.errstate(over="ignore"):
        two = mixed(h[:-1] * np.uint64(3) + h[1:], 7)[same]
    pairs, _ = _runs(of[1:][same], two, n)
    twins = _per(of[1:][same & (h[1:] == h[:-1])], n)

    lines, lines_distinct = np.zeros(n), np.zeros(n)
    for i, t in enumerate(texts):
        rows = [x for x in t.split(b"\n") if x.strip()]
        lines[i], lines_distinct[i] = len(rows), len(set(rows))
    return np.stack(
        (
            np.log1p(chars),
            np.log1p(words),
            share(counts[:, 0], letters),
            share(counts[:, 2], chars),
            share(counts[:, 3], words),
            share(counts[:, 4], words),
            share(counts[:, 5], words),
            share(counts[:, 6] + counts[:, 7], chars),
            share(counts[:, 8], letters),
            share(letters, chars),
            share(length, words),
            share(capitals, words),
            share(mixed_words, words),
            share(odd_ends, words),
            share(distinct, words),
            share(top, words),
            share(twins, words),
            share(pairs, words - 1),
            np.log1p(lines),
            share(lines_distinct, lines),
            np.log1p(share(chars, lines)),
            np.log1p(share(words, stops)),
        ),
        1,
    )


def _bins(X: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, X[:, f], side="right") for f, c in enumerate(cuts)], 1)


def _cuts(X: np.ndarray, bins: int) -> list[np.ndarray]:
    """Of each feature the values that begin a bin: quantiles of its distinct places in the sample."""
    return [np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) for x in X.T]


def _leaf(g: float, h: float) -> float:
    return g / (h + LEAF_WEIGHT)


def tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A value for each bin: a tree of a depth on sums of slopes and curvatures, split where the loss falls most."""
    G, H = g.sum(), h.sum()
    if depth and len(g) > 1:
        a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = a**2 / (b + LEAF_WEIGHT) + (G - a) ** 2 / (H - b + LEAF_WEIGHT)
        at = int(gain.argmax())
        if gain[at] > G**2 / (H + LEAF_WEIGHT) + 1e-9:
            return np.concatenate((tree(g[: at + 1], h[: at + 1], depth - 1), tree(g[at + 1 :], h[at + 1 :], depth - 1)))
    return np.full(len(g), _leaf(G, H))


def quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of the tree on two features that cuts their table once each way where the loss falls most."""
    a, b = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    score = lambda p, q: p**2 / (q + LEAF_WEIGHT)
    m, n = g.shape
    corner = lambda s: (s[1:-1, 1:-1], s[1:-1, -1:] - s[1:-1, 1:-1], s[-1:, 1:-1] - s[1:-1, 1:-1], s[-1, -1] - s[1:-1, -1:] - s[-1:, 1:-1] + s[1:-1, 1:-1])
    if m < 2 or n < 2:
        return 0.0, np.zeros_like(g)
    G, H = corner(a), corner(b)
    gain = sum(score(p, q) for p, q in zip(G, H, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    low = np.where(np.arange(m)[:, None] <= i, 0, 2) + np.where(np.arange(n)[None] <= j, 0, 1)
    values = np.array([_leaf(p[i, j], q[i, j]) for p, q in zip(G, H, strict=True)])
    return float(gain[i, j] - score(g.sum(), h.sum())), values[low]


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _loss(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    p = np.clip(_chance(z), 1e-9, 1 - 1e-9)
    return float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum())


def _boost(places: list[np.ndarray], shapes: list[tuple[int, ...]], z: np.ndarray, y: np.ndarray, w: np.ndarray, fit: np.ndarray, test: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Tables of the given shapes, one for each list of places of the rows, by trees in turns; those of the turn with the
    least loss on the rows test, and the log odds z with them."""
    tables = [np.zeros(s) for s in shapes]
    best, kept, since = (_loss(z[test], y[test], w[test]), [t.copy() for t in tables], 0)
    for _ in range(TURNS):
        for at, table in zip(places, tables, strict=True):
            p = _chance(z[fit])
            g, h = (np.bincount(at[fit], weights=x, minlength=table.size).reshape(table.shape) for x in (w[fit] * (y[fit] - p), w[fit] * p * (1 - p)))
            step = RATE * (tree(g, h) if table.ndim == 1 else quarters(g, h)[1])
            table += step
            z = z + step.ravel()[at]
        now = _loss(z[test], y[test], w[test])
        if now < best - 1e-6:
            best, kept, since = now, [t.copy() for t in tables], 0
        else:
            since += 1
            if since >= PATIENCE:
                break
    return kept, sum((t.ravel()[at] for t, at in zip(kept, places, strict=True)), np.zeros(len(y)))


def train(X: np.ndarray, y: np.ndarray, share: float | None = None) -> dict:
    """The tables for rows of features and labels of 0 or 1. Each label weighs as much as its share (of label 1) among
    all documents; every fifth row is kept to tell when to stop. Pairs are those whose best tree would lower the loss
    most after the single features' tables."""
    y = y.astype(float)
    mean = y.mean()
    share = mean if share is None else share
    w = np.where(y > 0, share / max(mean, 1e-9), (1 - share) / max(1 - mean, 1e-9))
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.ones(len(y), bool)
    fit, test = np.flatnonzero(~held if not held.all() else held), np.flatnonzero(held)
    share = min(max(share, 1e-6), 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    cuts, coarse = _cuts(X, BINS), _cuts(X, PAIR_BINS)
    at, two = _bins(X, cuts), _bins(X, coarse)
    single, z = _boost(list(at.T), [(len(c) + 1,) for c in cuts], np.full(len(y), start), y, w, fit, test)
    z = z + start
    p = _chance(z[fit])

    def place(i: int, j: int) -> np.ndarray:
        return two[:, i] * (len(coarse[j]) + 1) + two[:, j]

    def gain(pair: tuple[int, int]) -> float:
        shape = tuple(len(coarse[f]) + 1 for f in pair)
        return quarters(*(np.bincount(place(*pair)[fit], weights=x, minlength=shape[0] * shape[1]).reshape(shape) for x in (w[fit] * (y[fit] - p), w[fit] * p * (1 - p))))[0]

    pairs = sorted(combinations(range(X.shape[1]), 2), key=lambda q: (-gain(q), q))[:PAIRS]
    double, _ = _boost([place(*q) for q in pairs], [tuple(len(coarse[f]) + 1 for f in q) for q in pairs], z, y, w, fit, test)
    return {"start": start, "cuts": cuts, "single": single, "coarse": coarse, "pairs": pairs, "double": double}


def chances(model: dict, X: np.ndarray) -> np.ndarray:
    at, two = _bins(X, model["cuts"]), _bins(X, model["coarse"])
    z = np.full(len(X), model["start"])
    for f, table in enumerate(model["single"]):
        z += table[at[:, f]]
    for (i, j), table in zip(model["pairs"], model["double"], strict=True):
        z += table[two[:, i], two[:, j]]
    return _chance(z)


def fit(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE_PER_LABEL) -> dict | None:
    """A model of the documents with a label of 0 or 1; None without any. About sample documents of either label are
    used, by a hash of their ids, each whole; a document with several labels has the largest."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    counts = dict(known.groupBy("_y").count().collect())
    share = F.when(F.col("_y") == 1, sample / max(1, counts.get(1, 0))).otherwise(sample / max(1, counts.get(0, 0)))
    draw = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    picked = known.select("_id", "_y", draw.alias("_draw")).where(F.col("_draw") < share)
    # twice sample ids at the most, so that they can be broadcast
    found = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).join(F.broadcast(picked), "_id").select("_text", "_y", "_draw")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "_text"):
            rows = features(as_bytes(batch.column(0)))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(list(rows), pa.list_(pa.float64()))], names=["draw", "y", "x"])

    rows = drawn(found.mapInArrow(measured, "draw double, y int, x array<double>"), ["x"])
    if not rows:
        return None
    return train(np.stack([x for _, (x,) in rows]), np.array([y for y, _ in rows]), counts.get(1, 0) / sum(counts.values()))


def score(docs: DataFrame, model: dict | None, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs without its text, with score (chance of label 1) and predicted (whether it reaches the threshold).

    Null texts count as empty; whole texts count, and repeated rows are judged each. Without a model all scores are 0.
    Columns of the added names are replaced, further ones kept, however they are named.
    """
    own = [f"_{i}" for i in range(len(docs.columns))]
    text = own[docs.columns.index(text_col)]
    kept = {o: c for o, c in zip(own, docs.columns, strict=True) if c not in (text_col, "score", "predicted")}
    of = docs.toDF(*own).select(text, *kept)
    schema = ", ".join([*(f"{c} {t}" for c, t in of.dtypes[1:]), "score double, predicted int"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in text_chunks(batches, text):
            q = chances(m, features(as_bytes(batch.column(0)))) if m else np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(q), pa.array((q >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"])

    return of.mapInArrow(run, schema).toDF(*kept.values(), "score", "predicted")
