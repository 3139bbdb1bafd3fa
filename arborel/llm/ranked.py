"""Ranked lexical search for many queries: term at a time, with accumulators limited by bounds.

A query's terms are worked off from the rarest on. A document gets an accumulator when a term of the query occurs in it,
until what the terms left can add at most is less than the k-th largest sum so far: from then on no document without an
accumulator can be among the k best, and those that have one are only brought to their exact scores.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborel.llm.common import as_bytes, grouped, stored, text_chunks

#: Bits of the filter of the terms that are asked: a fixed size, whatever is asked.
FILTER_BITS = 1 << 24
_BUCKET = 1 << 15
#: Postings and documents of a block, and terms of a block of queries, which meet in one task.
POSTINGS, DOCUMENTS, ASKED = 1_000_000, 16_384, 200_000
#: Groups of a query's results that are ranked before all of them.
SHARES = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a term is made of: letters and digits of ASCII, and all bytes of other characters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(128)).lower() + bytes(range(128, 256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def asked_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term), distinct."""
    found = F.regexp_extract_all(F.translate(F.col(f"`{text_col}`"), _UPPER, _LOWER), F.lit(TERM), F.lit(0))
    return items.where(F.col(f"`{item_col}`").isNotNull()).select(F.col(f"`{item_col}`").cast("long").alias("item"), F.explode(found).alias("term")).distinct()


def term_filter(asked: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, of which those of the terms' hashes are set; the driver gets at most that many."""
    at = F.crc32(F.col("term").cast("binary")) % FILTER_BITS
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in asked.groupBy(F.floor(at / _BUCKET).cast("int").alias("b")).agg(F.bitmap_construct_agg(at % _BUCKET).alias("bits")).collect():
        bits[r["b"] * _BUCKET // 8 : (r["b"] + 1) * _BUCKET // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits


def postings(docs: DataFrame, id_col: str, text_col: str, bits: np.ndarray) -> DataFrame:
    """(id, n, terms, tf) of every document: its number of terms, and the terms that pass the filter with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    class Passed(dict):
        def __init__(self, bits: np.ndarray):
            self.bits = bits

        def __missing__(self, term: bytes) -> bool:
            h = zlib.crc32(term) % FILTER_BITS
            if len(self) >= 500_000:
                self.clear()
            self[term] = good = bool(self.bits[h >> 3] >> (h & 7) & 1)
            return good

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = Passed(shared.value)
        for batch in text_chunks(batches, "text"):
            n, ends, names, times = [], [0], [], []
            for text in as_bytes(batch.column(1)):
                words = terms(text)
                counts = [(w, c) for w, c in Counter(words).items() if passed[w]]
                n.append(len(words))
                names += [w for w, _ in counts]
                times += [c for _, c in counts]
                ends.append(len(names))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(names, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(times, pa.int64()))], names=["id", "n", "terms", "tf"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "id long, n long, terms array<string>, tf array<long>")


class Block:
    """Documents of a block by the terms that a block of queries asks for."""

    def __init__(self, docs: pa.Table, asks: pa.Table):
        names, weights = (asks.column(c).combine_chunks() for c in ("terms", "nums"))
        flat = names.flatten()
        vocabulary = flat.unique()
        #: Of each query its terms as places in the vocabulary, in their order.
        self.asked = pa.compute.index_in(flat, value_set=vocabulary).to_numpy()
        self.bounds = names.offsets.to_numpy() - names.offsets[0].as_py()
        self.items = asks.column("id").to_numpy()
        w = np.zeros(len(vocabulary), np.int64)
        w[self.asked] = weights.flatten().to_numpy()
        self.ids, self.m = docs.column("id").to_numpy(), docs.column("m").to_numpy()
        lists, tf = (docs.column(c).combine_chunks() for c in ("terms", "nums"))
        of = np.repeat(np.arange(len(docs)), np.diff(lists.offsets.to_numpy()))
        term = pa.compute.fill_null(pa.compute.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy()
        order = np.argsort(term, kind="stable")
        order = order[np.searchsorted(term[order], 0) :]
        self.doc, tf = of[order], tf.flatten().to_numpy()[order]
        self.part = w[term[order]] * (1_000_000_000 * tf // (1000 * tf + 20 * self.m[self.doc]))
        self.first = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
        self.most = np.zeros(len(vocabulary), np.int64)
        some = np.flatnonzero(np.diff(self.first))
        if len(some):
            self.most[some] = np.maximum.reduceat(self.part, self.first[some])

    def best(self, query: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the documents that may be among the query's k best, if k others have at least the score
        least."""
        of = self.asked[self.bounds[query] : self.bounds[query + 1]]
        left = np.append(np.cumsum(self.most[of][::-1])[::-1], 0)
        total, known, grows = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool), True
        for i, term in enumerate(of.tolist()):
            a, b = self.first[term], self.first[term + 1]
            # sums so far are left[0] - left[i] at most
            if grows and (left[i] < least or (2 * left[i] < left[0] and left[i] < kth(total, k))):
                grows = False
            doc, part = self.doc[a:b], self.part[a:b]
            if grows:
                total[doc] += part
                known[doc] = True
            else:
                at = known[doc]
                total[doc[at]] += part[at]
        # a document without an accumulator has a sum of 0
        at = np.flatnonzero(total >= max(1, least))
        return total[at], self.ids[at]


def kth(total: np.ndarray, k: int) -> int:
    """The k-th largest sum so far; 0 with fewer."""
    return int(np.partition(total, len(total) - k)[len(total) - k]) if len(total) >= k else 0


def first_k(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _dealt(of: Column, blocks: int, salt: str) -> Column:
    return F.pmod(F.xxhash64(of, F.lit(salt)), F.lit(blocks)).cast("int")


def search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 50) -> DataFrame:
    """item_col, rank (from 1), id_col and score of each item's k best documents of a score above 0.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. N documents have terms, L in all; a
    term that df of them hold weighs floor(1000 * ln((2 N + 2) / (2 df + 1))), and a document with n terms, tf of them
    this one, adds weight * (10 ** 9 * tf div (1000 * tf + 20 m)) for it, where m is 50 + 50 n N div L.

    Texts are read once: of each document only the terms that pass a filter of the asked ones are kept, and written.
    Documents and queries go in blocks, each pair of which meets once; a task carries a query's k best from one block of
    documents to the next, so that later blocks stop making accumulators early. Results are exact.

    Null texts have no terms and are not counted. Documents with a null id count in N, L and df, but are not ranked; rows
    that share an id are ranked each. Items with a null id, or without a term that a document holds, have no rows; rows
    of one item are one query. Ties go to the smaller id. Empty tables give no rows; other columns are not used.
    """
    asked = stored(asked_terms(items, item_col, item_text_col))
    index = stored(postings(docs, id_col, text_col, term_filter(asked)))
    sums = index.agg(F.count_if(F.col("n") > 0).alias("N"), F.sum("n").alias("L"), F.sum(F.size("terms")).alias("postings"), F.count_if(F.size("terms") > 0).alias("docs")).first()
    N, L = sums["N"] or 0, sums["L"] or 0
    # tasks count the terms of their documents before any are shuffled
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * N + 2) / (2 * F.col("df") + 1))).cast("long")
    rarest = F.array_sort(F.collect_list(F.struct("df", "term", weight.alias("w"))))
    asks = stored(asked.join(df, "term").groupBy("item").agg(rarest.alias("of")).select(F.col("item").alias("id"), F.col("of.term").alias("terms"), F.col("of.w").alias("nums")))
    size = asks.agg(F.sum(F.size("terms"))).first()[0] or 0
    rows, cols = max(1, -(-size // ASKED)), max(1, -(-(sums["postings"] or 0) // POSTINGS), -(-sums["docs"] // DOCUMENTS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    m = 50 + F.expr(f"(50 * n * {N}) div {max(L, 1)}")
    left = asks.select(_dealt(F.col("id"), rows, "q").alias("qb"), every(cols).alias("db"), F.lit(True).alias("ask"), "id", F.lit(0).cast("long").alias("m"), "terms", "nums")
    held = index.where(F.col("id").isNotNull() & (F.size("terms") > 0))
    right = held.select(every(rows).alias("qb"), _dealt(F.col("id"), cols, "d").alias("db"), F.lit(False).alias("ask"), "id", m.alias("m"), "terms", F.col("tf").alias("nums"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        row = None

        def out() -> pa.RecordBatch:
            item = np.repeat(np.fromiter(best, np.int64, len(best)), [len(s) for s, _ in best.values()])
            score, ids = (np.concatenate([x[i] for x in best.values()]) if best else np.zeros(0, np.int64) for i in (0, 1))
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids), pa.array(score)], names=["item", "id", "score"])

        for t, b in grouped(batches, ["qb", "db"]):
            for x, y in zip(b[:-1].tolist(), b[1:].tolist(), strict=True):
                part = t.slice(x, y - x)
                now = part.column("qb")[0].as_py()
                if row not in (None, now):
                    yield out()
                row = now
                ask = part.column("ask")
                asks, held = part.filter(ask), part.filter(pa.compute.invert(ask))
                if not len(asks) or not len(held):
                    continue
                block = Block(held, asks)
                for i, item in enumerate(block.items.tolist()):
                    scores, ids = best.get(item, (np.zeros(0, np.int64),) * 2)
                    more, new = block.best(i, k, int(scores[-1]) if len(scores) == k else 0)
                    best[item] = first_k(np.concatenate((scores, more)), np.concatenate((ids, new)), k)
        yield out()

    found = left.union(right).repartition("qb", "db").sortWithinPartitions("qb", "db").mapInArrow(run, "item long, id long, score long")
    # a task gives k rows of a query at most; those of a query are ranked by shares first
    order = [F.desc("score"), "id"]
    for by in (["item", F.pmod(F.xxhash64("id"), F.lit(SHARES))], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
        found = found if by == ["item"] else found.drop("rank")
    return found.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
