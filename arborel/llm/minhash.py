"""Near-duplicate documents: a multi-index Hamming join of MinHash signatures, confirmed on full shingle sets.

A signature has CHUNKS x CHUNK_SIZE symbols, each the low bits of a MinHash value. Two signatures that differ in fewer
than 2 * CHUNKS symbols have, by the pigeonhole principle, a chunk with one error at most; so each chunk is indexed
once for every place that may hold the error, and any such pair meets under one key at least. At a similarity of 0.8
a pair exceeds this distance with a probability of 4e-6, at 0.85 of 2e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborel.llm.common import as_bytes, dealt, grouped, stored, text_chunks
from arborel.llm.components import connected_components
from arborel.llm.shingles import mixed, shingle_sets

CHUNKS, CHUNK_SIZE = 12, 4
SYMBOLS = CHUNKS * CHUNK_SIZE
MOST_ERRORS = 2 * CHUNKS - 1
#: Members of a key, and of a family, that meet in one task; larger groups meet block by block.
KEY_BLOCK, FAMILY_BLOCK = 512, 128
#: Close pairs of a key's rows, for each of these rows, up to which they are written down.
DENSE = 8

_rng = np.random.default_rng(3)
_FACTOR = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.int64).astype(np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 16-bit symbols for each set; sets are not empty."""
    joined = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    first = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    out = np.zeros((len(sets), SYMBOLS), np.uint16)
    if len(sets):
        with np.errstate(over="ignore"):
            for k in range(SYMBOLS):
                out[:, k] = np.minimum.reduceat(joined * _FACTOR[k] + _PLUS[k], first).astype(np.uint16)
    return out


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each chunk and place of an error; its low six bits are the chunk and the place."""
    wide = sig.astype(np.uint64).reshape(len(sig), CHUNKS, CHUNK_SIZE)
    keys = np.zeros((len(sig), CHUNKS, CHUNK_SIZE), np.uint64)
    with np.errstate(over="ignore"):
        for place in range(CHUNK_SIZE):
            h = np.zeros((len(sig), CHUNKS), np.uint64)
            for j in range(CHUNK_SIZE):
                if j != place:
                    h = h * np.uint64(65599) + wide[:, :, j] + np.uint64(1)
            tag = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK_SIZE) + np.uint64(place)
            keys[:, :, place] = (mixed(h * np.uint64(64) + tag) << np.uint64(6)) | tag
    return keys.reshape(len(sig), SYMBOLS).view(np.int64)


def _signed(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n_shingles, two hashes of the set, signature) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text_col, 2 << 20):
            sets = shingle_sets(as_bytes(batch.column(1)), width)
            full = [s for s in sets if len(s)]
            sig = iter(signatures(full))
            with np.errstate(over="ignore"):
                h1 = [int(mixed(s, 11).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                h2 = [int(np.bitwise_xor.reduce(mixed(s, 23)).astype(np.int64)) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary())], names=["id", "n", "h1", "h2", "sig"])

    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, n long, h1 long, h2 long, sig binary")


def _keyed(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 4096):
                part = batch.slice(a, 4096)
                keys = chunk_keys(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column(0).take(pa.array(np.repeat(np.arange(len(part)), SYMBOLS)))], names=["key", "id"])

    return reps.select("id", "sig").mapInArrow(run, f"key long, id {dict(reps.dtypes)['id']}")


def _first_key(wrong: np.ndarray) -> np.ndarray:
    """Of pairs of signatures, given where they differ: the tag of the first key on which they agree."""
    wrong = wrong.reshape(-1, CHUNKS, CHUNK_SIZE)
    chunk = (wrong.sum(2) <= 1).argmax(1)
    return chunk * CHUNK_SIZE + wrong[np.arange(len(wrong)), chunk].argmax(1)


def _close_pairs(meeting: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) that connect all close signatures. A small group gives its close pairs, a larger one a spanning
    forest of them, each only those pairs whose first common key is the group's: what a forest leaves out is connected
    under an earlier key, so over all keys nothing is lost."""
    part, whole = similarity

    def near(S: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        fits = part * np.maximum(n[a], n[b]) <= whole * np.minimum(n[a], n[b])
        return fits & ((S[a] != S[b]).sum(1) <= MOST_ERRORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, b in grouped(batches, ["key", "bi", "bj"]):
            S = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            n, tag = t.column("n").to_numpy(), t.column("key").to_numpy() & 63
            size = np.diff(b)
            left, right = [], []
            small = size <= 12
            for off in range(1, int(size[small].max(initial=1))):
                spans = [np.arange(x, y - off) for x, y in zip(b[:-1][small & (size > off)], b[1:][small & (size > off)], strict=True)]
                for a in np.array_split(np.concatenate(spans), max(1, sum(map(len, spans)) // 50_000)) if spans else ():
                    c = a + off
                    wrong = S[a] != S[c]
                    ok = (wrong.sum(1) <= MOST_ERRORS) & (tag[a] == _first_key(wrong)) & (part * np.maximum(n[a], n[c]) <= whole * np.minimum(n[a], n[c]))
                    left.append(a[ok])
                    right.append(c[ok])
            for x, y in zip(b[:-1][~small], b[1:][~small], strict=True):
                rest = np.arange(x, y)
                while len(rest):
                    todo, rest = [rest[0]], rest[1:]
                    while todo and len(rest):
                        at = todo.pop()
                        hit = near(S, n, np.full(len(rest), at), rest)
                        if hit.any():
                            found = rest[hit]
                            own = found[_first_key(S[at] != S[found]) == tag[found]]
                            left.append(np.full(len(own), at))
                            right.append(own)
                            todo.extend(found.tolist())
                            rest = rest[~hit]
            ids = t.column("id").combine_chunks()
            a, c = (np.concatenate(z) if z else np.zeros(0, int) for z in (left, right))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(c))], names=["a", "b"])

    kind = dict(meeting.dtypes)["id"]
    return meeting.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj").mapInArrow(run, f"a {kind}, b {kind}")


def _asked_pairs(meeting: DataFrame, similarity: tuple[int, int], *, told: bool = False) -> DataFrame:
    """(family, a, b): pairs of close signatures, of which a is not linked yet, each under its first common key only. Rows
    of one block meet where both blocks are it, those of two where these two meet. told: (family, pairs) instead, how many
    a task has, null where more than DENSE times as many pairs as rows are close; no pair is written."""
    part, whole = similarity
    names = ["family", "pairs"] if told else ["family", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in grouped(batches, ["key", "bi", "bj"]):
            S = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            n, tag, own, linked = t.column("n").to_numpy(), t.column("key").to_numpy() & 63, t.column("own").to_numpy(), t.column("linked").to_numpy(zero_copy_only=False)
            crossed = t.column("bi").to_numpy() != t.column("bj").to_numpy()
            ids, families = t.column("id").combine_chunks(), t.column("family").combine_chunks().dictionary_encode()
            of, known = families.indices.to_numpy(), families.dictionary
            left, right, pairs, dense = [], [], np.zeros(len(known), np.int64), np.zeros(len(known), bool)
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                asks = x + np.flatnonzero(~linked[x:y])
                rows, met = np.arange(x, y), 0
                for a in np.array_split(asks, -(-len(asks) // 64)) if len(asks) else ():
                    fits = part * np.maximum(n[a][:, None], n[rows]) <= whole * np.minimum(n[a][:, None], n[rows])
                    # of two that are not linked the first asks
                    fits &= linked[rows] | (a[:, None] < rows)
                    if crossed[x]:
                        fits &= own[a][:, None] != own[rows]
                    i, j = np.nonzero(fits)
                    for k in range(0, len(i), 50_000):
                        q, r = a[i[k : k + 50_000]], rows[j[k : k + 50_000]]
                        wrong = S[q] != S[r]
                        ok = (wrong.sum(1) <= MOST_ERRORS) & (_first_key(wrong) == tag[q])
                        met += int(ok.sum())
                        if told:
                            pairs += np.bincount(of[q[ok]], minlength=len(known))
                        else:
                            left.append(q[ok])
                            right.append(r[ok])
                    if told and met > DENSE * len(rows):
                        dense[of[asks]] = True
                        break
            if told:
                some = np.flatnonzero(dense | (pairs > 0))
                yield pa.RecordBatch.from_arrays([known.take(pa.array(some)), pa.array(pairs[some], mask=dense[some])], names=names)
            else:
                a, b = (np.concatenate(z) if z else np.zeros(0, int) for z in (left, right))
                yield pa.RecordBatch.from_arrays([known.take(pa.array(of[a])), ids.take(pa.array(a)), ids.take(pa.array(b))], names=names)

    kind = dict(meeting.dtypes)["id"]
    schema = f"family {kind}, pairs long" if told else f"family {kind}, a {kind}, b {kind}"
    return meeting.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj").mapInArrow(run, schema)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", 2 << 20):
            sets = shingle_sets(as_bytes(batch.column(2)), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "family", "n", "shingles"])

    kind = dict(docs.dtypes)["id"]
    return docs.select("id", "family", "text").mapInArrow(run, f"id {kind}, family {kind}, n long, shingles array<long>")


def _rest_links(meeting: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links between unlinked members (asks) and any member of their family, a block of each at a time. Pairs that are
    already connected in the task are not compared."""
    part, whole = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in grouped(batches, ["family", "bi", "bj"]):
            left, right = [], []
            ids, asks, linked, n = (t.column(c).to_pylist() for c in ("id", "asks", "linked", "n"))
            column = t.column("shingles").combine_chunks()
            values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                root = {i: i for i in ids[x:y]}
                hub = next((ids[k] for k in range(x, y) if linked[k]), None)
                for k in range(x, y):
                    if linked[k]:
                        root[ids[k]] = hub

                def find(i, root=root):
                    while root[i] != i:
                        root[i] = i = root[root[i]]
                    return i

                answers = [k for k in range(x, y) if not asks[k]]
                for q in (k for k in range(x, y) if asks[k]):
                    mine = find(ids[q])
                    near = [k for k in answers if find(ids[k]) != mine and part * max(n[k], n[q]) <= whole * min(n[k], n[q])]
                    if not near:
                        continue
                    own = values[offsets[q] : offsets[q + 1]].view(np.uint64)
                    theirs = np.concatenate([values[offsets[k] : offsets[k + 1]] for k in near]).view(np.uint64)
                    at = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
                    both = np.add.reduceat(own[at] == theirs, np.cumsum([0, *(n[k] for k in near)])[:-1], dtype=np.int64)
                    for k, common in zip(near, both.tolist(), strict=True):
                        if whole * common >= part * (n[k] + n[q] - common):
                            left.append(ids[q])
                            right.append(ids[k])
                            root[find(ids[q])] = find(ids[k])
            kind = t.schema.field("id").type
            yield pa.RecordBatch.from_arrays([pa.array(left, kind), pa.array(right, kind)], names=["a", "b"])

    kind = dict(meeting.dtypes)["id"]
    return meeting.repartition("family", "bi", "bj").sortWithinPartitions("family", "bi", "bj").mapInArrow(run, f"a {kind}, b {kind}")


def _block(key: Column, blocks: Column, salt: str) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt)), blocks).cast("int")


def _met(rows: DataFrame) -> DataFrame:
    """rows (id, n, sig, further columns) by their keys that others have too, with key, own (a block of the key's rows) and
    bi and bj, a pair of blocks that meets."""
    keys = _keyed(rows)
    shared = dealt(keys.groupBy("key").count().where("count > 1"))
    met = keys.join(shared, "key").join(rows, "id").withColumn("blocks", F.ceil(F.col("count") / KEY_BLOCK).cast("int"))
    met = met.withColumn("own", _block(F.col("id"), F.col("blocks"), "key")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other")}).drop("count", "blocks", "other")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """id_col, n_shingles, component_id and kept of every row of docs.

    Documents are linked if whole * |A and B| >= part * |A or B| for their sets of distinct shingles of width words;
    component_id is the smallest id that links reach, kept whether it is the row's own. Copies of a set become one
    first. Candidates are joined by their signatures' chunks; connected candidates form families. Each member is
    compared with its family's first document; only members without this link are compared with others: with those whose
    signatures are close, or, where these pairs are so many that it is less work, with all of the family, block by block.
    What a key
    or a family adds up to is dealt out anew before it meets the rows it comes from, so that joins shuffle both sides
    and Spark can split a large one.

    Null and empty texts, and those of white space, have no shingles and no links. A row with a null id is linked
    with nothing and kept; its component is null. Rows with one id count as linked. Other columns are not used.
    """
    part, whole = similarity
    kind = dict(docs.dtypes)[id_col]
    signed = stored(_signed(docs, id_col, text_col, width))
    reps = stored(signed.where("n > 0 and id is not null").groupBy("n", "h1", "h2").agg(F.min("id").alias("id"), F.first("sig").alias("sig")))
    met = _met(reps.select("id", "n", "sig"))
    families = stored(connected_components(_close_pairs(met, similarity)).toDF("id", "family"))

    # families grow with the corpus: this join is a shuffle at every size
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(families.hint("merge"), "id")
    sets = stored(_sets(texts, width).where("n > 0"))
    hubs = stored(sets.where("id = family").groupBy("family").agg(F.min(F.struct("n", "shingles")).alias("hub")).select("family", F.col("hub.n").alias("hub_n"), F.col("hub.shingles").alias("hub")))
    common = F.size(F.array_intersect("shingles", "hub"))
    tried = sets.join(hubs, "family").withColumn("common", common)
    tried = tried.select("id", "family", ((F.col("id") == F.col("family")) | (whole * F.col("common") >= part * (F.col("n") + F.col("hub_n") - F.col("common")))).alias("linked"))
    # dealt by id: a sum over id and family would stay where the join is, and keep Spark from splitting a large family
    tried = stored(tried.repartition("id").groupBy("id", "family").agg(F.max("linked").alias("linked")))
    links = tried.where("linked and id <> family").select(F.col("id").alias("a"), F.col("family").alias("b"))

    blocks = lambda c: F.ceil(F.col(c) / FAMILY_BLOCK).cast("int")
    open_ = tried.groupBy("family").agg(F.count("*").alias("members"), F.count_if(~F.col("linked")).alias("askers")).where("askers > 0 and members > 2")
    open_ = stored(open_.withColumns({"ask_blocks": blocks("askers"), "all_blocks": blocks("members")}))
    opened = stored(tried.join(dealt(open_.select("family")), "family"))
    # sets that are sent, by pairs and by blocks; pairs are counted first, and written for the families that go by pairs only
    asked = reps.select("id", "n", "sig").join(opened, "id")
    counts = _asked_pairs(_met(asked), similarity, told=True).groupBy("family").agg(F.sum("pairs").alias("pairs"), F.max(F.col("pairs").isNull()).alias("dense"))
    fewer = 2 * F.coalesce("pairs", F.lit(0)) <= F.col("members") * F.col("ask_blocks") + F.col("askers") * F.col("all_blocks")
    open_ = stored(open_.join(counts, "family", "left").withColumn("by_pairs", fewer & ~F.coalesce("dense", F.lit(False))))
    by_pairs = dealt(open_.where("by_pairs and pairs > 0").select("family"))
    few = stored(_asked_pairs(_met(asked.join(by_pairs, "family")), similarity)).select("a", "b")
    mine = lambda side: sets.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("shingles").alias(f"s_{side}"))
    few = few.join(mine("a"), "a").join(mine("b"), "b").withColumn("common", F.size(F.array_intersect("s_a", "s_b")))
    links = links.union(few.where(whole * F.col("common") >= part * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b"))

    rest = sets.join(opened.join(dealt(open_.where("not by_pairs")), "family"), ["id", "family"])
    answers = rest.select("id", "family", "n", "shingles", "linked", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1)).alias("bi"), _block(F.col("id"), F.col("all_blocks"), "all").alias("bj"))
    asks = rest.where("not linked").select("id", "family", "n", "shingles", "linked", F.lit(True).alias("asks"), _block(F.col("id"), F.col("ask_blocks"), "ask").alias("bi"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("bj"))
    links = links.unionByName(_rest_links(answers.unionByName(asks), similarity))
    found = connected_components(links).toDF("rep", "found")

    has_set = F.expr("n > 0 and id is not null")
    low = reps.select("n", "h1", "h2", F.col("id").alias("rep")).join(found, "rep", "left").select("n", "h1", "h2", F.coalesce("found", "rep").alias("low"))
    of = signed.where(has_set).join(dealt(low), ["n", "h1", "h2"]).select("id", "n", "low").union(signed.where(~has_set).select("id", "n", "id"))
    return of.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("low").cast(kind).alias("component_id"), F.coalesce(F.col("low") == F.col("id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of docs of which one document of each group of near-duplicates is left: that with the smallest id.

    Of rows with one id the first by its text and then by its other columns stays; rows with a null id all do.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]
    of, at, text = docs.toDF(*own), own[docs.columns.index(id_col)], own[docs.columns.index(text_col)]
    kept = near_duplicates(of, id_col=at, text_col=text, width=width, similarity=similarity).where(F.col("kept") & F.col(at).isNotNull()).select(at)
    named = of.where(F.col(at).isNotNull()).join(kept.hint("merge"), at, "left_semi")
    hidden = [F.to_json(F.struct(F.col(c).alias("c"))) for c in own if c not in (at, text)]
    first = Window.partitionBy(at).orderBy(text, *hidden)
    named = named.withColumn("nth", F.row_number().over(first)).where("nth = 1").select(*own)
    return named.union(of.where(F.col(at).isNull())).toDF(*docs.columns)
