"""A hidden Markov language model: Baum-Welch over the whole corpus, exact likelihoods by the scaled forward recursion.

A text is its words, lower-cased in A-Z, and an end. Each token belongs to one of CLASSES classes by a hash (the end to
one of its own). A state emits a class, and a class a word in proportion to its count in the training texts plus one;
each class also keeps the weight of one unseen word.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborel.llm.common import PARTS, added_up, as_bytes, pieces, stored, text_chunks

CLASSES, STATES = 4096, 6
#: Rounds of Baum-Welch on a bounded sample of documents, from which those over the corpus start.
SAMPLE_DOCS, SAMPLE_ROUNDS = 600, 25
#: Rounds over the corpus end when one gains less than so many nats a token.
CLOSE = 1e-3
#: The most frequent words, whose counts every task holds; the other words' counts are joined.
KNOWN_WORDS = 150_000
_HELD_WORDS = 150_000
#: Tokens of a text from which on it is cut into lanes, of a lane, and of all rows that are worked on together.
CUT, LANE, BLOCK = 4096, 512, 1_000_000
END = b"\n"


def word_class(word: bytes) -> int:
    return CLASSES if word == END else zlib.crc32(word) % CLASSES


def _words(text: bytes) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only, which is what the token rule asks for."""
    words = text.lower().split()
    words.append(END)
    return words


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, c) over all rows; tasks count what they read before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words = list(counts)
            for a in range(0, len(words), 20_000):
                part = words[a : a + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()).cast(pa.string()), pa.array([counts[w] for w in part], pa.int64())], names=["word", "c"])
            counts.clear()

        for batch in text_chunks(batches, text_col):
            for text in as_bytes(batch.column(0)):
                counts.update(_words(text))
            if len(counts) > _HELD_WORDS:
                yield from out()
        yield from out()

    return docs.select(text_col).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _encode(docs: DataFrame, text_col: str, known: dict[bytes, int]) -> DataFrame:
    """docs without its text, with n_tokens, the number and log10(c + 1) sum of the tokens whose counts are at hand, the
    other words, and the classes of all tokens."""
    kept = [c for c in docs.columns if c != text_col]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes if c != text_col), "n_tokens long, n_here long, base_here double, rare array<string>, classes binary"])
    # the last entry stands for a word that is not at hand
    logs = np.log10(np.fromiter((*known.values(), 0), np.int64, len(known) + 1) + 1)
    in_class = np.fromiter((*map(word_class, known), 0), np.uint16, len(known) + 1)
    shared = docs.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(known)}, logs, in_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, logs, in_class = shared.value
        for batch in text_chunks(batches, text_col):
            words, ends = [], []
            for text in as_bytes(batch.column(0)):
                words += _words(text)
                ends.append(len(words))
            ends = np.array(ends)
            starts = np.concatenate(([0], ends[:-1]))
            at = np.fromiter(map(number.get, words, repeat(-1)), np.int32, len(words))
            codes = in_class[at]
            miss = np.flatnonzero(at < 0)
            codes[miss] = [word_class(words[i]) for i in miss]
            raw = codes.tobytes()
            rare = pa.ListArray.from_arrays(np.append(0, np.searchsorted(miss, ends)).astype(np.int32), pa.array([words[i] for i in miss], pa.binary()).cast(pa.string()))
            classes = pa.array([raw[2 * a : 2 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
            here = np.add.reduceat(at >= 0, starts, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(ends - starts), pa.array(here), pa.array(np.add.reduceat(logs[at], starts)), rare, classes], names=[*kept, "n_tokens", "n_here", "base_here", "rare", "classes"])

    return docs.select(text_col, *kept).mapInArrow(run, schema)


class Lanes:
    """Rows of tokens of different lengths, longest first: at each step those that still run are the first rows. A row is a
    text, or a lane of one: then into has the distribution of states that enters it, and after the direction of the
    backward vector at its end."""

    def __init__(self, codes: list[np.ndarray], starts: np.ndarray, into: np.ndarray, after: np.ndarray):
        """In the order of the lengths; starts tells which rows begin a text."""
        lengths = np.array([len(c) for c in codes])
        self.starts, self.into, self.after = starts, into, after
        self.steps = int(lengths[0])
        self.active = np.searchsorted(-lengths, -np.arange(self.steps), side="left")
        self.first = np.concatenate(([0], np.cumsum(self.active)))
        self.tokens = np.empty(int(self.first[-1]), np.uint16)
        for row, c in enumerate(codes):
            self.tokens[self.first[: len(c)] + row] = c

    def _spans(self) -> list[tuple[int, int]]:
        return list(zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True))

    def products(self, model: dict) -> np.ndarray:
        """Of each row the product of its steps' matrices, each a transition (but none into a text's first token) and an
        emission; scaled, as only directions count."""
        E, A = np.ascontiguousarray(model["emit"].T), model["trans"]
        states = len(A)
        P = np.tile(np.eye(states), (len(self.starts), 1, 1))
        for t, (a, b) in enumerate(self._spans()):
            k = b - a
            e = E.take(self.tokens[a:b], axis=0)[:, None, :]
            if t:
                np.multiply((P[:k].reshape(-1, states) @ A).reshape(k, states, states), e, out=P[:k])
            else:
                P[:k] = np.where(self.starts[:k, None, None], np.eye(states), A) * e
            # eight emissions stay far within the range of numbers
            if t % 8 == 7:
                P[:k] /= P[:k].sum((1, 2), keepdims=True)
        return P / P.sum((1, 2), keepdims=True)

    def forward(self, model: dict, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Natural log likelihood of each row given what enters it, the scaled forward vectors and the scales."""
        E, A = np.ascontiguousarray(model["emit"].T), model["trans"]
        ones = np.ones(len(A))
        every = np.empty((len(self.tokens), len(A))) if keep else None
        scales = np.empty(len(self.tokens))
        v = None
        for a, b in self._spans():
            before = np.where(self.starts[:, None], model["start"], self.into @ A) if v is None else v[: b - a] @ A
            v = before * E.take(self.tokens[a:b], axis=0)
            z = np.dot(v, ones, out=scales[a:b])
            v /= z[:, None]
            if keep:
                every[a:b] = v
        logs = np.log(scales)
        logp = np.zeros(len(self.starts))
        for a, b in self._spans():
            logp[: b - a] += logs[a:b]
        return logp, every, scales

    def expected(self, model: dict) -> dict:
        """Expected counts of starts, transitions and emissions (forward-backward), and the rows' log likelihood. With
        both recursions scaled alike, a token's forward and backward vectors multiply to its states' probabilities."""
        logp, gamma, z = self.forward(model, keep=True)
        E, A = np.ascontiguousarray(model["emit"].T), model["trans"]
        back = np.ascontiguousarray(A.T)
        states = A.shape[0]
        start, trans = np.zeros(states), np.zeros_like(A)
        after, w = None, None
        for a, b in reversed(self._spans()):
            beta = np.empty((b - a, states))
            m = 0 if after is None else len(after)
            # rows that end here
            beta[m:] = self.after[m : b - a]
            beta[m:] /= (gamma[a + m : b] * beta[m:]).sum(1, keepdims=True)
            if m:
                trans += gamma[a : a + m].T @ w
                np.matmul(w, back, out=beta[:m])
            w = E.take(self.tokens[a:b], axis=0)
            w *= beta
            w /= z[a:b, None]
            gamma[a:b] *= beta
            after = beta
        start += gamma[: self.active[0]][self.starts].sum(0)
        trans += self.into[~self.starts].T @ w[~self.starts]
        emit = np.stack([np.bincount(self.tokens, weights=gamma[:, s], minlength=CLASSES + 1) for s in range(states)])
        return {"start": start, "trans": trans * A, "emit": emit, "logp": logp.sum()}


class Chains:
    """Texts as rows that advance together. A text of over CUT tokens is cut into lanes of LANE, and the products of the
    lanes' matrices tell what enters each from either side, so that all lanes advance together and every sum is that of
    the whole text. Rows go in blocks of about BLOCK tokens, which bounds what is held for a text of any length."""

    def __init__(self, codes: list[np.ndarray]):
        self.texts = len(codes)
        rows = [(i, a, c[a : a + size]) for i, c in enumerate(codes) for size in (LANE if len(c) > CUT else max(len(c), 1),) for a in range(0, len(c), size)]
        self.text = np.array([i for i, _, _ in rows], int)
        self.starts = np.array([a == 0 for _, a, _ in rows], bool)
        self.rows = [c for _, _, c in rows]

    def _blocks(self, at: np.ndarray) -> Iterator[np.ndarray]:
        """The rows at, longest first, in blocks."""
        size = np.array([len(self.rows[i]) for i in at], int)
        order = np.argsort(-size, kind="stable")
        cut = np.cumsum(size[order]) // BLOCK
        for part in np.split(at[order], np.flatnonzero(np.diff(cut)) + 1) if len(at) else ():
            yield part

    def _ends(self, model: dict) -> tuple[np.ndarray, np.ndarray]:
        """What enters each row: the states before it, and the direction of the backward vector after it."""
        states = len(model["trans"])
        into, after = np.zeros((len(self.rows), states)), np.ones((len(self.rows), states))
        cut = np.flatnonzero(~self.starts | np.append(~self.starts[1:], False))
        P = np.empty((len(self.rows) if len(cut) else 0, states, states))
        for part in self._blocks(cut):
            P[part] = self._lanes(part, into, after).products(model)
        v = None
        for i in cut.tolist():
            if not self.starts[i]:
                into[i] = v
            v = (model["start"] if self.starts[i] else v) @ P[i]
            v = v / v.sum()
        for i in cut[::-1].tolist():
            if not self.starts[i]:
                r = P[i] @ after[i]
                after[i - 1] = r / r.sum()
        return into, after

    def _lanes(self, part: np.ndarray, into: np.ndarray, after: np.ndarray) -> Lanes:
        return Lanes([self.rows[i] for i in part], self.starts[part], into[part], after[part])

    def log_likelihood(self, model: dict) -> np.ndarray:
        """Natural, of each text."""
        into, after = self._ends(model)
        out = np.zeros(self.texts)
        for part in self._blocks(np.arange(len(self.rows))):
            np.add.at(out, self.text[part], self._lanes(part, into, after).forward(model)[0])
        return out

    def expected(self, model: dict) -> dict:
        """Expected counts over all texts, and their log likelihood."""
        into, after = self._ends(model)
        states = len(model["trans"])
        total = {"start": np.zeros(states), "trans": np.zeros((states, states)), "emit": np.zeros((states, CLASSES + 1)), "logp": 0.0}
        for part in self._blocks(np.arange(len(self.rows))):
            for k, x in self._lanes(part, into, after).expected(model).items():
                total[k] = total[k] + x
        return total


def _codes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in column.to_pylist()]


def _slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    yield from text_chunks(batches, "classes", most_bytes)


def _flat(counts: dict) -> np.ndarray:
    return np.concatenate([np.ravel(counts[k]) for k in ("start", "trans", "emit", "logp")])


def _unflat(x: np.ndarray, states: int) -> dict:
    a, b = states, states + states * states
    return {"start": x[:a], "trans": x[a:b].reshape(states, states), "emit": x[b:-1].reshape(states, CLASSES + 1), "logp": float(x[-1])}


def maximized(counts: dict, mass: np.ndarray) -> dict:
    """The parameters that the expected counts give; a state keeps one token's weight of the classes' overall shares."""
    share = mass / mass.sum()
    emit = counts["emit"] + share + 1e-3 * share * counts["emit"].sum(1, keepdims=True)
    return {
        "start": (counts["start"] + 1) / (counts["start"] + 1).sum(),
        "trans": (counts["trans"] + 1) / (counts["trans"] + 1).sum(1, keepdims=True),
        "emit": emit / emit.sum(1, keepdims=True),
    }


def initial(mass: np.ndarray, states: int, seed: int = 5) -> dict:
    rng = np.random.default_rng(seed)
    emit = mass / mass.sum() * rng.uniform(0.5, 1.5, (states, len(mass)))
    trans = np.full((states, states), 0.2 / max(1, states - 1)) + np.eye(states) * (0.8 - 0.2 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    return {"start": np.full(states, 1 / states), "trans": trans / trans.sum(1, keepdims=True), "emit": emit / emit.sum(1, keepdims=True)}


def baum_welch_round(encoded: DataFrame, model: dict) -> dict:
    """Expected counts over all rows: each task sums those of its texts, and their sum is one vector of fixed
    length."""
    states = len(model["start"])
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in _slices(batches):
            x = _flat(Chains(_codes(batch.column(0))).expected(shared.value))
            total = x if total is None else total + x
        if total is not None:
            yield pieces(total)

    size = states + states * states + states * (CLASSES + 1) + 1
    return _unflat(added_up(encoded.select("classes").mapInArrow(run, PARTS), size), states)


def trained(train: DataFrame, model: dict, mass: np.ndarray, rounds: int | None = None) -> dict:
    """Baum-Welch over all rows of train, for some rounds or until one gains less than CLOSE nats a token."""
    before, done = None, 0
    while rounds is None or done < rounds:
        counts = baum_welch_round(train, model)
        tokens = counts["emit"].sum()
        if tokens == 0:
            break
        model, done = maximized(counts, mass), done + 1
        if rounds is None and before is not None and counts["logp"] - before < CLOSE * tokens:
            break
        before = counts["logp"]
    return model


def _frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The counts of the most frequent words, most at most: those over a level that a histogram of the counts'
    logarithms gives, so that no task sorts or merges the vocabulary."""
    level = F.floor(F.log("c") * 64).cast("int")
    left, least = most, None
    for k, words in counts.groupBy(level.alias("k")).count().orderBy(F.desc("k")).collect():
        if words > left:
            break
        left, least = left - words, k
    if least is None:
        return {}
    return {bytes(r["w"]): r["c"] for r in counts.where(level >= least).select(F.col("word").cast("binary").alias("w"), "c").toLocalIterator()}


def score(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int | None = None, known_words: int = KNOWN_WORDS) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram, log10) and score (log10
    probability of the text under the model) of every row; what held_out marks teaches nothing. Training starts with
    SAMPLE_ROUNDS rounds on about SAMPLE_DOCS documents of any length and then runs over all rows until it settles, or
    for some rounds.

    Null and empty texts are an end alone. Rows with a null id are scored too; repeated rows and rows that share an
    id each. An empty table gives no rows; without training rows every word is unseen. Other columns are not used.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), id_col, F.coalesce(held_out, F.lit(False)).alias("held_out"), text_col)
    counts = stored(word_counts(rows.where(~F.col("held_out")), text_col))
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    known = _frequent(counts, known_words)
    in_class = F.when(F.col("word") == END.decode(), CLASSES).otherwise(F.crc32(F.col("word").cast("binary")) % CLASSES).cast("int").alias("k")
    mass = np.ones(CLASSES + 1)
    for k, m in counts.groupBy(in_class).agg(F.sum(F.col("c") + 1)).collect():
        mass[k] += m

    encoded = stored(_encode(rows, text_col, known))
    train = encoded.where(~F.col("held_out"))
    size = train.count()
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("hmm")), F.lit(1 << 20)) / float(1 << 20)
    sample = stored(train.where(draw < SAMPLE_DOCS / max(size, 1)).select("classes").repartition(8))
    model = trained(train, trained(sample, initial(mass, states), mass, SAMPLE_ROUNDS), mass, rounds)

    rare = encoded.select("_row", F.explode("rare").alias("word")).groupBy("_row", "word").agg(F.count("*").alias("times"))
    rare = rare.join(counts, "word").groupBy("_row").agg(F.sum("times").alias("n_there"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("base_there"))
    log_mass = np.log10(mass)
    shared = docs.sparkSession.sparkContext.broadcast((model, log_mass))
    kept = ["_row", id_col, "held_out", "n_tokens", "n_here", "base_here"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, lm = shared.value
        for batch in _slices(batches):
            codes = _codes(batch.column(0))
            logp = Chains(codes).log_likelihood(m) / math.log(10) - np.array([lm[c].sum() for c in codes])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(logp)], names=[*kept, "chain"])

    kinds = dict(encoded.dtypes)
    scored = encoded.select("classes", *kept).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "chain double"]))
    out = scored.join(rare, "_row", "left")
    words = F.col("base_here") + F.coalesce("base_there", F.lit(0.0))
    return out.select(
        id_col,
        "held_out",
        "n_tokens",
        (F.col("n_here") + F.coalesce("n_there", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (words - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        (words + F.col("chain")).alias("score"),
    )
