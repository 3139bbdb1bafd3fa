"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborel.llm.common import PARTS, added_up, among, as_bytes, pieces, stored, text_chunks
from arborel.llm.shingles import INVERSE, ODD, powers, stretches

BUCKETS = 1 << 18
#: Lengths in bytes of a token's prefixes and of its suffix that are features beside the whole token.
PREFIXES, SUFFIX = (4, 5, 6), 4
#: Tokens of a chain, into which longer texts are cut for training, and tokens up to which all chains are summed over on
#: the driver.
CHAIN_TOKENS, SAMPLE_TOKENS = 20_000, 4_000_000
#: Nats a token that the last step over all chains may promise.
GAIN = 2.5e-4
#: Tokens that a step of training holds at once.
_BLOCK = 1_000_000
_STEPS = 256

_TOKEN = np.full(256, 32, np.uint8)
_TOKEN[97:123] = np.arange(97, 123)
_TOKEN[65:91] = np.arange(97, 123)
_TOKEN[48:58] = np.arange(48, 58)
_TOKEN[128:] = np.arange(128, 256)
_POWERS = powers(ODD, 64)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29)) ^ np.uint64(salt * 0x9E3779B9)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(8)).astype(np.int32) & (BUCKETS - 1)


def tokens(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Runs of letters and digits: the text's number, first and last byte (exclusive, in the text) and feature buckets."""
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    low = _TOKEN[raw]
    first = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1] if texts else np.zeros(0, int)
    starts, ends, features = [], [], []
    for a, b in stretches(low == 32):
        start, end, found = _stretch_tokens(low[a : b + 1])
        starts.append(start + a)
        ends.append(end + a)
        features.append(found)
    start, end = np.concatenate(starts), np.concatenate(ends)
    of = np.searchsorted(first, start, side="right") - 1
    return {"of": of, "start": start - first[of], "end": end - first[of], "features": np.concatenate(features)}


def _stretch_tokens(low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = low != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        wide = low.astype(np.uint64) + np.uint64(1)
        padded = np.concatenate((wide, np.zeros(64, np.uint64)))
        longest = max(PREFIXES)
        h = np.zeros(len(start), np.uint64)
        found = []
        for j in range(longest):
            h = h + np.where(start + j < end, padded[start + j], np.uint64(0)) * _POWERS[j + 1]
            if j + 1 in PREFIXES:
                found.append(_mixed(h, j + 1))
        tail = np.zeros(len(start), np.uint64)
        for j in range(SUFFIX):
            tail = tail + np.where(end - 1 - j >= start, padded[end - 1 - j], np.uint64(0)) * _POWERS[j + 1]
        found.append(_mixed(tail, 77))
        rolled = np.concatenate((np.zeros(1, np.uint64), np.cumsum(wide * powers(ODD, len(wide)), dtype=np.uint64)))
        whole = (rolled[end] - rolled[start]) * powers(INVERSE, len(wide))[start]
        found.append(_mixed(whole, 99))
    return start, end, np.stack(found, 1)


def marginals(emission: np.ndarray, new: np.ndarray, start: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """P(toxic) of each token of a row of chains, by the forward-backward recursion.

    emission: a token's score for toxic against clean; new: where a chain begins; start: log weights of a first
    label; trans: of a label after another. The row is cut into lanes of equal length; the product of a lane's 2 x 2
    matrices tells what enters the next, so that all lanes advance together and the sums are those of the whole
    chain. pairs: also the expected count of each pair of labels, and of first labels.
    """
    n = len(emission)
    if not n:
        return (np.zeros(0), np.zeros((2, 2)), np.zeros(2)) if pairs else np.zeros(0)
    lanes = -(-n // _STEPS)
    size = lanes * _STEPS
    e = np.zeros(size)
    e[:n] = np.clip(emission, -30, 30)
    fresh = np.zeros(size, bool)
    fresh[:n] = new
    fresh[n:] = True
    on = np.exp(e / 2).reshape(lanes, _STEPS).T
    off = 1 / on
    fresh = fresh.reshape(lanes, _STEPS).T
    A, S = np.exp(trans), np.exp(start)

    def step(t: int):
        f, x, y = fresh[t], off[t], on[t]
        return np.where(f, S[0], A[0, 0]) * x, np.where(f, S[1], A[0, 1]) * y, np.where(f, S[0], A[1, 0]) * x, np.where(f, S[1], A[1, 1]) * y

    p00, p01, p10, p11 = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for t in range(_STEPS):
        a, b, c, d = step(t)
        p00, p01, p10, p11 = p00 * a + p01 * c, p00 * b + p01 * d, p10 * a + p11 * c, p10 * b + p11 * d
        z = 1 / (p00 + p01 + p10 + p11)
        p00, p01, p10, p11 = p00 * z, p01 * z, p10 * z, p11 * z
    into, back = np.empty((lanes, 2)), np.empty((lanes, 2))
    u, v = 0.5, 0.5
    for k, (a, b, c, d) in enumerate(zip(p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist(), strict=True)):
        into[k] = u, v
        u, v = u * a + v * c, u * b + v * d
        u, v = u / (u + v), v / (u + v)
    u, v = 0.5, 0.5
    for k in range(lanes - 1, -1, -1):
        back[k] = u, v
        a, b, c, d = p00[k], p01[k], p10[k], p11[k]
        u, v = a * u + b * v, c * u + d * v
        u, v = u / (u + v), v / (u + v)
    forward = np.empty((_STEPS, 2, lanes))
    u, v = into[:, 0].copy(), into[:, 1].copy()
    for t in range(_STEPS):
        a, b, c, d = step(t)
        u, v = u * a + v * c, u * b + v * d
        z = 1 / (u + v)
        u, v = u * z, v * z
        forward[t, 0], forward[t, 1] = u, v
    u, v = back[:, 0].copy(), back[:, 1].copy()
    out, counts, firsts = np.empty((_STEPS, lanes)), np.zeros((2, 2)), np.zeros(2)
    real = (np.arange(size) < n).reshape(lanes, _STEPS).T
    for t in range(_STEPS - 1, -1, -1):
        x, y = forward[t, 0] * u, forward[t, 1] * v
        out[t] = y / (x + y)
        a, b, c, d = step(t)
        if pairs:
            q, r = (forward[t - 1, 0], forward[t - 1, 1]) if t else (into[:, 0], into[:, 1])
            w = np.stack((q * a * u, q * b * v, r * c * u, r * d * v))
            w /= w.sum(0)
            counts += w[:, real[t] & ~fresh[t]].sum(1).reshape(2, 2)
            f = real[t] & fresh[t]
            firsts += (1 - out[t][f]).sum(), out[t][f].sum()
        u, v = a * u + b * v, c * u + d * v
        z = 1 / (u + v)
        u, v = u * z, v * z
    p = out.T.reshape(size)[:n]
    return (p, counts, firsts) if pairs else p


def _summary(p: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Of each document: the log odds of its largest marginal, and the log of one plus the sum of those over a tenth."""
    most, total = np.full(n, 1e-5), np.zeros(n)
    np.maximum.at(most, of, p)
    some = p >= 0.1
    total += np.bincount(of[some], weights=p[some], minlength=n)[:n]
    most = np.clip(most, 1e-5, 1 - 1e-5)
    return np.stack((np.log(most / (1 - most)), np.log1p(total)), 1)


def chains(emission: np.ndarray, size: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """marginals with pairs, of whole chains of the sizes (at least one token each): a step advances all chains that have
    so many tokens, as the odds of the two labels."""
    order = np.argsort(-size, kind="stable")
    first, steps = (np.cumsum(size) - size)[order], int(size.max())
    on = len(size) - np.searchsorted(size[order][::-1], np.arange(steps), side="right")
    bound = np.append(0, np.cumsum(on))
    at = np.concatenate([first[:n] + t for t, n in enumerate(on.tolist())])
    odds = np.exp(np.clip(emission, -30, 30))[at]
    (a, b), (c, d) = np.exp(trans)
    forward, before, seen = np.empty(len(at)), np.empty(len(at)), np.empty(len(at))
    r = odds[: on[0]] * np.exp(start[1] - start[0])
    forward[: on[0]] = r
    ends = bound.tolist()
    for x, y in zip(ends[1:-1], ends[2:], strict=True):
        r = before[x:y] = r[: y - x]
        r = odds[x:y] * (b + d * r) / (a + c * r)
        forward[x:y] = r
    v = np.ones(0)
    for x, y in zip(ends[-2::-1], ends[:0:-1], strict=True):
        back = np.ones(y - x)
        back[: len(v)] = (c + d * v) / (a + b * v)
        forward[x:y] *= back
        v = seen[x:y] = odds[x:y] * back
    p = np.empty(len(at))
    p[at] = forward / (1 + forward)
    r, v = before[on[0] :], seen[on[0] :]
    z = 1 / (a + c * r + (b + d * r) * v)
    one, two, both = b * (v @ z), c * (r @ z), d * ((r * z) @ v)
    begun = p[np.cumsum(size) - size].sum()
    return p, np.array([[len(r) - one - two - both, one], [two, both]]), np.array([len(size) - begun, begun])


#: Chains of about _BLOCK tokens: labels, tokens of each, each token's place among the distinct ones, and their features.
_BLOCKS = "y binary, size binary, token binary, features binary"


def _read(y, size, token, features) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(y, np.int32), np.frombuffer(size, np.int32), np.frombuffer(token, np.int32), np.frombuffer(features, np.int32).reshape(-1, len(PREFIXES) + 2)


def _packed(y: np.ndarray, size: np.ndarray, features: np.ndarray) -> tuple[bytes, ...]:
    f = features.astype(np.int64)
    _, head = np.unique(f[:, 0] | f[:, 1] << 18 | f[:, 2] << 36, return_inverse=True)
    _, first, token = np.unique(head << 36 | f[:, 3] << 18 | f[:, 4], return_index=True, return_inverse=True)
    return tuple(x.astype(np.int32).tobytes() for x in (y, size, token, features[first]))


def _chains_of(batches: Iterator[pa.RecordBatch], longest: int, block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the texts (text, y); a text of over longest tokens is several chains."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    pack = lambda: pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in _packed(*map(np.concatenate, zip(*held, strict=True)))], names=["y", "size", "token", "features"])
    for batch in text_chunks(batches, "_text", 1 << 20):
        found = tokens(as_bytes(batch.column(0)))
        n = np.bincount(found["of"], minlength=len(batch))
        parts = -(-n // longest)
        size = np.full(parts.sum(), longest)
        size[np.cumsum(parts)[n > 0] - 1] = (n - (parts - 1) * longest)[n > 0]
        if len(size):
            held.append((np.repeat(batch.column(1).to_numpy(), parts), size, found["features"]))
        if sum(len(h[2]) for h in held) >= block:
            yield pack()
            held = []
    if held:
        yield pack()


def _total(blocks: DataFrame | list[tuple], of: Callable[..., np.ndarray], size: int) -> np.ndarray:
    """The sum of a vector of each block; over the tasks, or here over a list of blocks. There are as many tasks as cores at
    most, each with its blocks one after another, so the vectors that are shuffled don't grow with the blocks."""
    if isinstance(blocks, list):
        return sum((of(*b) for b in blocks), np.zeros(size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for i in range(len(batch)):
                total += of(*(c[i].as_buffer() for c in batch.columns))
        yield pieces(total)

    return added_up(blocks.coalesce(blocks.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, PARTS), size)


def _each(blocks: DataFrame | list[tuple], of: Callable[..., tuple[bytes, bytes]]) -> DataFrame | list[tuple]:
    """Two buffers (y, x) of each block."""
    if isinstance(blocks, list):
        return [of(*b) for b in blocks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in of(*(c[i].as_buffer() for c in batch.columns))], names=["y", "x"])

    return stored(blocks.mapInArrow(run, "y binary, x binary"))


def _logistic(rows: DataFrame | list[tuple], columns: int, n: int, weights: tuple[float, float], l2: float = 1e-2) -> np.ndarray:
    """Weights of the columns and of a constant, by Newton steps over n rows, which weigh what their label does."""
    k = columns + 1
    w, ridge = np.zeros(k), l2 * n**0.5

    def step(y, x) -> np.ndarray:
        y, x = np.frombuffer(y, np.int32), np.frombuffer(x).reshape(-1, columns)
        x, weight = np.hstack((x, np.ones((len(x), 1)))), np.where(y > 0, weights[1], weights[0])
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        return np.concatenate((((x * (weight * q * (1 - q))[:, None]).T @ x).ravel(), x.T @ (weight * (y - q))))

    for _ in range(50):
        s = _total(rows, step, k * k + k)
        move = np.linalg.solve(s[: k * k].reshape(k, k) + ridge * np.eye(k), s[k * k :] - ridge * w)
        w = w + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return w


def _seen(rows: Iterable[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """How many clean and toxic chains hold each feature, and how many there are."""
    seen = np.zeros((2, BUCKETS))
    for f, y in zip(rows, toxic, strict=True):
        seen[int(y), np.unique(f)] += 1
    return np.append(seen.ravel(), (len(toxic) - toxic.sum(), toxic.sum()))


def _marks(seen: np.ndarray) -> np.ndarray:
    """Of each feature whether it marks a toxic token: seen in several toxic documents and hardly in clean ones."""
    (clean, toxic), (n, m) = seen[:-2].reshape(2, -1), seen[-2:]
    return (toxic >= 3) & ((toxic + 0.5) / (m + 1) >= 20 * (clean + 0.5) / (n + 1)) & (toxic >= 10 * clean)


def _token_labels(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    return _marks(_seen(rows, toxic))


def train(blocks: DataFrame | list[tuple], toxic_share: float | None = None, *, first: list[tuple] | None = None, epochs: int = 30, rate: float = 0.5, l2: float = 1e-5) -> dict:
    """A model of all chains of the blocks (_BLOCKS). Tokens of toxic documents with a marking feature are labelled toxic,
    all others clean; AdaGrad on the conditional log likelihood of all chains at once; then a logistic score of a chain's
    summary, whose rows weigh as much as their label among all documents (toxic_share). Each count, gradient and Newton
    step is a sum over all blocks. The likelihood has one maximum only, so the steps may begin with those of the first
    blocks, if some are given; then steps over all blocks follow until one promises to gain less than GAIN."""
    width = len(PREFIXES) + 2

    def seen(*block) -> np.ndarray:
        y, size, token, features = _read(*block)
        ends = np.cumsum(size)
        return _seen((features[np.unique(token[b - n : b])] for b, n in zip(ends.tolist(), size.tolist(), strict=True)), y)

    found = _total(blocks, seen, 2 * BUCKETS + 2)
    marks, (clean, toxic) = _marks(found), found[-2:]
    w, start, trans = np.zeros(BUCKETS, np.float32), np.zeros(2), np.zeros((2, 2))
    gw, gs, gt, before = np.full(BUCKETS, 1e-3, np.float32), np.full(2, 1.0), np.full((2, 2), 1.0), 0

    def gradient(*block) -> np.ndarray:
        """Counted less expected: features, pairs of labels, first labels; and the tokens."""
        label, size, token, features = _read(*block)
        y = marks[features].any(1)[token] & (np.repeat(label, size) > 0)
        p, counts, begun = chains(w[features].sum(1, dtype=float)[token], size, start, trans)
        off = np.repeat(np.bincount(token, weights=y - p, minlength=len(features)), width)
        new = np.zeros(len(y), bool)
        new[np.cumsum(size) - size] = True
        inner = np.flatnonzero(~new)
        pairs = np.bincount(2 * y[inner - 1] + y[inner], minlength=4)
        firsts = (new & ~y).sum(), (new & y).sum()
        return np.concatenate((np.bincount(features.ravel(), weights=off, minlength=BUCKETS), pairs - counts.ravel(), firsts - begun, [len(y)]))

    for of in [blocks] if first is None else [first, blocks]:
        for _ in range(epochs):
            g = _total(of, gradient, BUCKETS + 7)
            size = max(1, g[-1])
            d, dt, ds = g[:BUCKETS] - size * l2 * w, g[BUCKETS:-3].reshape(2, 2) / size, g[-3:-1] / size
            if before and size != before:  # what steps were taken before counts as if they had been over as many tokens
                gw, gs, gt = gw * np.float32((size / before) ** 2), gs * size / before, gt * size / before
            before = size
            gw = (gw + d**2).astype(np.float32)
            gs = gs + ds**2 * size
            gt = gt + dt**2 * size
            move = rate * d / np.sqrt(gw), rate * ds * np.sqrt(size) / np.sqrt(gs), rate * dt * np.sqrt(size) / np.sqrt(gt)
            w, start, trans = (w + move[0]).astype(np.float32), start + move[1], trans + move[2]
            gain = (d @ move[0]) / size + ds @ move[1] + (dt * move[2]).sum()
            if first is not None and of is blocks and gain < GAIN:
                break

    def summary(*block) -> tuple[bytes, bytes]:
        y, size, token, features = _read(*block)
        p = chains(w[features].sum(1, dtype=float)[token], size, start, trans)[0]
        return y.tobytes(), _summary(p, np.repeat(np.arange(len(size)), size), len(size)).tobytes()

    mean = toxic / max(1, clean + toxic)
    share = mean if toxic_share is None else toxic_share
    weights = (1 - share) / max(1 - mean, 1e-9), share / max(mean, 1e-9)
    *top, bias = _logistic(_each(blocks, summary), 2, int(clean + toxic), weights)
    return {"w": w, "start": start, "trans": trans, "top": np.array(top), "bias": float(bias)}


def fit(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> dict | None:
    """A model of all documents with a label of 0 or 1; None without any. Each is used whole: those of over CHAIN_TOKENS
    tokens as several chains. Up to SAMPLE_TOKENS tokens in all are summed over on the driver. More are summed over in
    tasks, from blocks that are written once, and the driver has about so many for the steps to begin with. Texts without a
    label are left out before the texts are shuffled."""
    known = stored(labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y")))
    counts = dict(known.groupBy("_y").count().collect())
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    picked = among(texts, "_id", known.select(id_col)).join(known.select(F.col(id_col).alias("_id"), "_y"), "_id")
    longest, block = CHAIN_TOKENS, _BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _chains_of(batches, longest, block)

    made = stored(picked.select("_text", "_y").mapInArrow(run, _BLOCKS))
    size = made.agg(F.sum(F.octet_length("token") / 4)).first()[0]
    if not size:
        return None
    held = lambda df: [tuple(r) for r in df.toArrow().to_pandas().itertuples(index=False)]
    share = counts.get(1, 0) / sum(counts.values())
    if size <= SAMPLE_TOKENS:
        return train(held(made), share)
    mark = F.xxhash64("y", "size", "token")
    some = [r[0] for r in made.select(mark.alias("m")).orderBy("m").limit(max(1, SAMPLE_TOKENS // _BLOCK)).collect()]
    return train(made, share, first=held(made.where(mark.isin(some))))


def _scored(m: dict, t: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the tokens and scores of the n texts."""
    p = marginals(m["w"][t["features"]].sum(1, dtype=np.float64), np.diff(t["of"], prepend=-1) != 0, m["start"], m["trans"])
    return p, 1 / (1 + np.exp(-(_summary(p, t["of"], n) @ m["top"] + m["bias"])))


def clean(docs: DataFrame, model: dict | None, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score is under the threshold, with all their columns; all rows without a model."""
    at = docs.columns.index(text_col)
    own = [f"_{i}" for i in range(len(docs.columns))]
    of = docs.toDF(*own)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in text_chunks(batches, own[at], 2 << 20):
            if m is not None:
                texts = as_bytes(batch.column(at))
                batch = batch.filter(pa.array(_scored(m, tokens(texts), len(texts))[1] < threshold))
            yield batch

    return of.mapInArrow(run, of.schema).toDF(*docs.columns)


def score(docs: DataFrame, model: dict | None, *, text_col: str = "text", threshold: float = 0.3, spans: bool = True) -> DataFrame:
    """docs without its text, with score, predicted, and the offending offsets: span_starts and span_ends in code
    points (end exclusive) of tokens whose marginal is at least a half, neighbours joined.

    Null and empty texts get the score of a text without offence; without a model all scores are 0. Whole texts
    count; repeated rows are judged each. Columns of the added names are replaced, further ones kept, however they are
    named.
    """
    own = [f"_{i}" for i in range(len(docs.columns))]
    text = own[docs.columns.index(text_col)]
    added = ["score", "predicted", *(["span_starts", "span_ends"] if spans else [])]
    kept = {o: c for o, c in zip(own, docs.columns, strict=True) if c not in (text_col, "score", "predicted", "span_starts", "span_ends")}
    of = docs.toDF(*own).select(text, *kept)
    schema = ", ".join([*(f"{c} {t}" for c, t in of.dtypes[1:]), "score double, predicted int", *(["span_starts array<int>, span_ends array<int>"] if spans else [])])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in text_chunks(batches, text, 2 << 20):
            texts = as_bytes(batch.column(0))
            starts: list[list[int]] = [[] for _ in texts]
            ends: list[list[int]] = [[] for _ in texts]
            q = np.zeros(len(texts))
            if m is not None:
                t = tokens(texts)
                p, q = _scored(m, t, len(texts))
                bad = np.flatnonzero(p >= 0.5) if spans else np.zeros(0, int)
                of = t["of"][bad]
                for k in np.unique(of):
                    at = bad[slice(*np.searchsorted(of, (k, k + 1)))]
                    apart = np.flatnonzero(np.diff(at) > 1)
                    points = np.cumsum((np.frombuffer(texts[k], np.uint8) & 0xC0) != 0x80, dtype=np.int32)
                    place = lambda x, points=points: np.where(x > 0, points[x - 1], 0).tolist()
                    starts[k] = place(t["start"][at[np.append(0, apart + 1)]])
                    ends[k] = place(t["end"][at[np.append(apart, len(at) - 1)]])
            more = [pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))] if spans else []
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(q), pa.array((q >= threshold).astype(np.int32)), *more], names=[*kept, *added])

    return of.mapInArrow(run, schema).toDF(*kept.values(), *added)
