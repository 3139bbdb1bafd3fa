"""Topics of texts: clusters of their words, by spherical k-means on all texts.

Words fall into DIMS buckets by a hash. A bucket weighs the more the fewer of the texts have it; a text is the direction of
its weighted counts, and its topic the nearest of the centres. A sample only tells where the centres start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborel.llm.common import PARTS, added_up, as_bytes, drawn, pieces, stored, text_chunks
from arborel.llm.shingles import word_hashes

DIMS, TOPICS = 2048, 8
#: Texts that the centres start from (about), starts, and rounds of each, and of all texts at most.
SAMPLE, TRIALS, ROUNDS = 1_500, 4, 25
#: Share by which a round over all texts brings them nearer to their centres, if it is not the last.
GAIN = 1e-4
#: The topic of a text without words, or without any that weighs.
NO_TOPIC = "none"


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, bucket) of each word."""
    of, h = word_hashes(texts)
    return of, (h % np.uint64(DIMS)).astype(np.int64)


def train(rows: list[tuple[np.ndarray, np.ndarray]], topics: int = TOPICS, seed: int = 3) -> dict | None:
    """Weights of the buckets, and the centres by falling size, from rows of buckets and their counts. Of TRIALS starts the
    one counts after which texts are nearest to their centres; a start draws texts, the sooner the further they are from
    those drawn before."""
    rows = [r for r in rows if len(r[0])]
    X = np.zeros((len(rows), DIMS), np.float32)
    for i, (at, times) in enumerate(rows):
        X[i, at] = times
    weights = np.log((1 + len(X)) / (1 + (X > 0).sum(0))).astype(np.float32)
    X *= weights
    X = X[X.any(1)]
    if not len(X):
        return None
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    rng, best = np.random.default_rng(seed), None
    for _ in range(TRIALS):
        near, chosen = np.zeros(len(X)), []
        while len(chosen) < topics and near.min() < 1 - 1e-6:
            far = 1 - np.minimum(near, 1)
            chosen.append(int(rng.choice(len(X), p=far / far.sum())))
            near = np.maximum(near, X @ X[chosen[-1]])
        centres, before = X[chosen], None
        for _ in range(ROUNDS):
            of = (X @ centres.T).argmax(1)
            if before is not None and (of == before).all():
                break
            before = of
            for k in range(len(centres)):
                total = X[of == k].sum(0)
                if total.any():
                    centres[k] = total / np.linalg.norm(total)
        fit = (X @ centres.T).max(1).sum()
        if best is None or fit > best[0]:
            best = fit, centres
    centres = best[1]
    size = np.bincount((X @ centres.T).argmax(1), minlength=len(centres))
    return {"weights": weights, "centres": np.ascontiguousarray(centres[np.argsort(-size, kind="stable")].T * weights[:, None])}


def fit(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", topics: int = TOPICS, sample: int = SAMPLE) -> dict | None:
    """Topics of all texts, the largest first; None if none of them has a word. Centres start from about sample texts, drawn
    by a hash of their ids, and then move in rounds over all texts until these get hardly nearer. Words are counted once;
    a round sums each task's texts by their centres, in pieces, and the driver holds the centres only."""
    of = docs.select(F.col(text_col).alias("_text"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"))
    draw = F.pmod(F.xxhash64("_id", F.lit("topic")), F.lit(1 << 30)) / float(1 << 30)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "_text"):
            n = len(batch)
            word, bucket = buckets(as_bytes(batch.column(0)))
            key, times = np.unique(word.astype(np.int64) * DIMS + bucket, return_counts=True)
            ends = pa.array(np.searchsorted(key, np.arange(n + 1) * DIMS), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (key % DIMS, times)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([0] * n, pa.int32()), *lists], names=["draw", "y", "at", "times"])

    rows = of.select("_text", draw.alias("draw")).mapInArrow(counted, "draw double, y int, at array<int>, times array<int>")
    held = stored(rows.where(F.size("at") > 0))
    n = held.count()
    if not n:
        return None
    start = train([lists for _, lists in drawn(held.where(F.col("draw") < sample / max(1, n)), ["at", "times"])], topics)
    # of few texts the draw may hold none that weighs
    start = start or train([lists for _, lists in drawn(held.orderBy("draw").limit(sample), ["at", "times"])], topics)
    return None if start is None else _settled(held, start, n)


def _parts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, times) of a batch's counts."""
    at, times = (batch.column(batch.schema.get_field_index(c)) for c in ("at", "times"))
    return np.repeat(np.arange(len(batch)), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(float)


def _settled(held: DataFrame, start: dict, n: int) -> dict:
    """start with the weights of all texts, and the centres that rounds over all of them end at."""

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS)
        for batch in batches:
            total += np.bincount(_parts(batch)[1], minlength=DIMS)
        yield pieces(total)

    own = held.select("at", "times")
    weights = np.log((1 + n) / (1 + added_up(own.mapInArrow(having, PARTS), DIMS)))
    k = start["centres"].shape[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        unit = np.where(start["weights"][:, None] > 0, start["centres"] / start["weights"][:, None], 0.0)

    def nearest(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        shared = held.sparkSession.sparkContext.broadcast((weights, centres))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, c = shared.value
            total = np.zeros(k * DIMS + k + 1)
            for batch in batches:
                text, bucket, x = _parts(batch)
                x = x * w[bucket]
                size = np.sqrt(np.bincount(text, weights=x * x, minlength=len(batch)))
                x = x / np.where(size > 0, size, 1)[text]
                z = np.stack([np.bincount(text, weights=x * one[bucket], minlength=len(batch)) for one in c.T], 1)
                best = z.argmax(1)
                total[: k * DIMS] += np.bincount(best[text] * DIMS + bucket, weights=x, minlength=k * DIMS)
                total[k * DIMS : -1] += np.bincount(best[size > 0], minlength=k)
                total[-1] += z.max(1)[size > 0].sum()
            yield pieces(total)

        total = added_up(own.mapInArrow(run, PARTS), k * DIMS + k + 1)
        shared.unpersist()
        return total[: k * DIMS].reshape(k, DIMS).T, total[k * DIMS : -1], float(total[-1])

    before, size = -1.0, np.zeros(k)
    for _ in range(ROUNDS):
        sums, size, fit = nearest(unit)
        if fit <= before * (1 + GAIN):
            break
        before, length = fit, np.linalg.norm(sums, axis=0)
        unit = np.where(length > 0, sums / np.where(length > 0, length, 1), unit)
    return {"weights": weights.astype(np.float32), "centres": np.ascontiguousarray(unit[:, np.argsort(-size, kind="stable")] * weights[:, None])}


def with_topics(docs: DataFrame, model: dict | None, *, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with n_tokens (its words) and topic, t0 being the largest; texts that are null or without words
    that weigh have NO_TOPIC, as have all without a model. Further columns stay, however they are named; those of the added
    names are replaced."""
    own = [f"_{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    kept = {o: c for i, (o, c) in enumerate(zip(own, docs.columns, strict=True)) if c not in ("n_tokens", "topic") and (keep_text or i != at)}
    of = docs.toDF(*own)
    schema = ", ".join([*(f"{o} {dict(of.dtypes)[o]}" for o in kept), "n_tokens long, topic string"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in text_chunks(batches, own[at], 2 << 20):
            word, bucket = buckets(as_bytes(batch.column(at)))
            n = len(batch)
            best = np.full(n, -1)
            if m is not None:
                z = np.stack([np.bincount(word, weights=c[bucket], minlength=n)[:n] for c in m["centres"].T], 1)
                best = np.where(z.max(1) > 0, z.argmax(1), -1)
            names = pa.array([NO_TOPIC, *(f"t{k}" for k in range(0 if m is None else m["centres"].shape[1]))]).take(pa.array(best + 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(o)) for o in kept), pa.array(np.bincount(word, minlength=n)[:n].astype(np.int64)), names], names=[*kept, "n_tokens", "topic"])

    return of.mapInArrow(run, schema).toDF(*kept.values(), "n_tokens", "topic")
