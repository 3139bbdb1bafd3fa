"""Language identification: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborel.llm.common import as_bytes, dealt, drawn, stored, text_chunks

BUCKETS = 1 << 15
ORDERS = (2, 3, 4)
#: Labelled documents of each language that training may use.
SAMPLE_PER_LANGUAGE = 800
#: Languages whose shares are broadcast; more are joined by a shuffle.
HELD_LANGUAGES = 10_000
UNDETERMINED = "und"
_SEGMENT = 1 << 19

#: Letters lower-cased, bytes of longer characters kept, everything else a space.
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text's number, bucket) of every byte n-gram with one space at most, in segments of bounded size.

    Texts stand between spaces, so an n-gram never joins two of them.
    """
    joined = np.frombuffer(b"  " + b"  ".join(texts) + b"    ", np.uint8)
    ends = np.cumsum([2 + len(t) for t in texts])
    longest = max(ORDERS)
    for a in range(0, len(joined) - longest + 1, _SEGMENT):
        part = _LETTERS[joined[a : a + _SEGMENT + longest - 1]]
        n = min(_SEGMENT, len(part) - longest + 1)
        spaces = np.concatenate(([0], np.cumsum(part == 32, dtype=np.int32)))
        of = np.searchsorted(ends, np.arange(a, a + n), side="right")
        wide = part.astype(np.uint32)
        for order in ORDERS:
            h = np.full(n, 0x9E3779B1 * order & 0xFFFFFFFF, np.uint32)
            for j in range(order):
                h = (h ^ wide[j : j + n]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            ok = spaces[order : order + n] - spaces[:n] <= 1
            yield of[ok], (h[ok] * np.uint32(0x85EBCA6B)) >> np.uint32(17)


def gram_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(BUCKETS)
    for _, bucket in grams([text]):
        total += np.bincount(bucket, minlength=BUCKETS)
    idx = np.flatnonzero(total)
    return idx.astype(np.int32), (total[idx] / max(total.sum(), 1)).astype(np.float32)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], *, dim: int = 16, epochs: int = 12, batch: int = 64, rate: float = 0.5, precision: float = 0.99, seed: int = 7) -> dict:
    """Stochastic gradient descent with AdaGrad steps; every fifth row is kept for the temperature and the rejection
    threshold: the lowest confidence from which on accepted rows are right with the given precision."""
    langs = sorted({r[0] for r in rows})
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    y = np.array([langs.index(r[0]) for r in rows], int)
    E = rng.normal(0, 0.3, (BUCKETS, dim)).astype(np.float32)
    W, b = np.zeros((dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    gE, gW, gb = np.full((BUCKETS, 1), 1e-6, np.float32), np.full_like(W, 1e-6), np.full_like(b, 1e-6)
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 25 else np.zeros(len(rows), bool)
    fit = np.flatnonzero(~held)

    def embed(i: int) -> np.ndarray:
        return rows[i][2] @ E[rows[i][1]]

    for _ in range(epochs):
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // batch)):
            if not len(part):
                continue
            x = np.stack([embed(i) for i in part])
            z = x @ W + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            dW, db, dx = x.T @ p, p.sum(0), p @ W.T
            dE = np.zeros_like(E)
            for k, i in enumerate(part):
                dE[rows[i][1]] += rows[i][2][:, None] * dx[k]
            gW += dW**2
            gb += db**2
            gE += (dE**2).mean(1, keepdims=True)
            W -= rate * dW / np.sqrt(gW)
            b -= rate * db / np.sqrt(gb)
            E -= rate * 0.2 * dE / np.sqrt(gE)
    P = (E @ W).astype(np.float32)
    test = np.flatnonzero(held) if held.any() else fit
    z = np.stack([rows[i][2] @ P[rows[i][1]] + b for i in test])

    def probabilities(t: float) -> np.ndarray:
        p = np.exp((z - z.max(1, keepdims=True)) * t)
        return p / p.sum(1, keepdims=True)

    t = min(np.geomspace(0.2, 20, 41), key=lambda t: -np.log(probabilities(t)[np.arange(len(test)), y[test]] + 1e-12).sum())
    p = probabilities(t)
    confidence, right = p.max(1), p.argmax(1) == y[test]
    order = np.argsort(-confidence)
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    last = np.append(np.diff(confidence[order]) < 0, True)  # of equal confidences all or none are accepted
    good = np.flatnonzero((share >= precision) & last)
    return {"langs": langs, "P": P, "b": b, "t": float(t), "least": float(confidence[order[good[-1]]]) if len(good) else 1.0}


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE_PER_LANGUAGE) -> dict | None:
    """A model of the labelled rows; None if there are none. At most about sample rows of a language are used, by a
    hash of their ids; each is whole."""
    of = docs.select(F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("_id")).where(F.col("lang").isNotNull() & (F.length("_text") > 0))
    counts = stored(of.groupBy("lang").agg((sample / F.count("*")).alias("_share")))  # a row for each language
    counts = F.broadcast(counts) if counts.count() <= HELD_LANGUAGES else dealt(counts)
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit("lang")), F.lit(1 << 20)) / float(1 << 20)
    picked = of.withColumn("_draw", draw).join(counts, "lang").where("_draw < _share").select("_text", "lang", "_draw")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "_text"):
            found = [gram_counts(t) for t in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))], names=["draw", "lang", "bucket", "share"])

    rows = drawn(picked.mapInArrow(count, "draw double, lang string, bucket array<int>, share array<float>"), ["bucket", "share"])
    return train([(lang, *lists) for lang, lists in rows]) if rows else None


def predict(docs: DataFrame, model: dict | None, *, text_col: str = "text") -> DataFrame:
    """docs without its text, with lang_pred, score (calibrated probability) and accepted (score reaches the
    calibrated threshold).

    Null texts and texts without a letter: lang_pred und, score 0, not accepted; so all rows without a model. Whole
    texts count. Repeated rows are judged each. Columns of the added names are replaced, further ones kept,
    however they are named.
    """
    own = [f"_{i}" for i in range(len(docs.columns))]
    text = own[docs.columns.index(text_col)]
    kept = {o: c for o, c in zip(own, docs.columns, strict=True) if c not in (text_col, "lang_pred", "score", "accepted")}
    of = docs.toDF(*own).select(text, *kept)
    schema = ", ".join([*(f"{c} {t}" for c, t in of.dtypes[1:]), "lang_pred string, score double, accepted boolean"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in text_chunks(batches, text):
            texts = as_bytes(batch.column(0))
            lettered = np.array([any(map(str.isalpha, t.decode())) for t in texts], bool)
            if m is None:
                pred, score, good = [UNDETERMINED] * len(texts), np.zeros(len(texts)), lettered & False
            else:
                k = len(m["langs"])
                z, n = np.zeros((len(texts), k)), np.zeros(len(texts))
                for at, bucket in grams(texts):
                    n += np.bincount(at, minlength=len(texts) + 1)[: len(texts)]
                    w = m["P"][bucket]
                    for j in range(k):
                        z[:, j] += np.bincount(at, weights=w[:, j], minlength=len(texts) + 1)[: len(texts)]
                z = (z / np.maximum(n, 1)[:, None] + m["b"]) * m["t"]
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                pred = [m["langs"][i] if ok else UNDETERMINED for i, ok in zip(p.argmax(1), lettered, strict=True)]
                score = np.where(lettered, p.max(1), 0.0)
                good = lettered & (score >= m["least"])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(pred, pa.string()), pa.array(score), pa.array(good)], names=[*kept, "lang_pred", "score", "accepted"])

    return of.mapInArrow(run, schema).toDF(*kept.values(), "lang_pred", "score", "accepted")
