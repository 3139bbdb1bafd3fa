"""Hierarchical packing of tokenized documents into context windows of several lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from arborel.llm.common import as_bytes, text_chunks

TIERS = (64, 128, 256, 512, 1024, 2048, 4096)
#: Words of which a worker keeps the ids; the others are tokenized each time.
CACHED_WORDS = 400_000
#: Ids that one round of packing holds in a task.
BLOCK_IDS = 2_000_000
_SUFFIX = b".,;:!?*$%&#"


class WordEncoder:
    """Ids of whole texts, word by word.

    The vocabulary's rule set never joins what white space separates, so a text's ids are those of its words; ASCII
    letters are lower-cased first, as its normalizer does. Texts with the opening of a special token or with one of
    the controls that Python but not the normalizer takes for white space go through the tokenizer whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}

    def _plain(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _word(self, word: bytes) -> bytes:
        """Closing punctuation after a letter is a token run of its own."""
        stem = word.rstrip(_SUFFIX)
        if stem and len(stem) < len(word) and 97 <= stem[-1] <= 122:
            return self._kept(stem) + self._kept(word[len(stem) :])
        return self._plain(word.decode())

    def _kept(self, word: bytes) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = self._plain(word.decode())
            if len(self.words) < CACHED_WORDS:
                self.words[word] = found
        return found

    def encode(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids."""
        if b"<|" in text or any(x in text for x in (b"\x1c", b"\x1d", b"\x1e", b"\x1f")):
            return self._plain(text.decode())
        words = text.lower().decode().split() if not text.isascii() else text.lower().split()
        if not text.isascii():
            words = [w.encode() for w in words]
        known = self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        new: dict[bytes, bytes] = {}
        for word in set(words).difference(known):
            new[word] = ids = self._word(word)
            if len(known) < CACHED_WORDS:
                known[word] = ids
        return b"".join([known[w] if w in known else new[w] for w in words])


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Pool:
    """What is left of documents, by length: items are (length, order, key, start)."""

    def __init__(self, items: list[tuple[int, int, object, int]]):
        self.items = sorted(items)

    def __bool__(self) -> bool:
        return bool(self.items)

    def longest(self):
        return self.items.pop()

    def fitting(self, gap: int):
        """The longest item of at most gap ids, or None."""
        at = bisect_right(self.items, (gap, 1 << 62))
        return self.items.pop(at - 1) if at else None

    def next_longer(self):
        """The shortest item, to be cut when none fits."""
        return self.items.pop(0) if self.items else None

    def put(self, item) -> None:
        insort(self.items, item)


def tier_of(length: int, tiers: tuple[int, ...]) -> int:
    """The shortest window that holds a document."""
    return next(t for t in tiers if length <= t)


def windows(pool: Pool, tiers: tuple[int, ...], last: bool) -> Iterator[tuple[int, list[tuple[object, int, int]]]]:
    """Full windows (tier, [(key, start, length)]) of the pool's items, longest first.

    An item opens a window of its tier; longer items are cut into whole windows of the longest tier. A gap takes the
    longest shorter item that fits, again and again, and at last a piece of the shortest one. When the pool runs dry
    in an open window, its pieces go back (last: they are dealt to windows of powers of two, down to one id, so that
    nothing is padded).
    """
    top = tiers[-1]
    while pool:
        length, order, key, start = pool.longest()
        if length > top:
            yield top, [(key, start, top)]
            pool.put((length - top, order, key, start + top))
            continue
        tier = tier_of(length, tiers)
        opened, gap = [(length, order, key, start)], tier - length
        while gap and pool:
            item = pool.fitting(gap)
            if item is None:
                n, order, key, start = pool.next_longer()
                item = (gap, order, key, start)
                pool.put((n - gap, order, key, start + gap))
            opened.append(item)
            gap -= item[0]
        if not gap:
            yield tier, [(key, start, n) for n, _, key, start in opened]
        elif not last:
            for item in opened:
                pool.put(item)
            return
        else:
            opened.reverse()
            left = sum(x[0] for x in opened)
            while left:
                room = size = 1 << (left.bit_length() - 1)
                left -= size
                pieces = []
                while room:
                    n, order, key, start = opened.pop()
                    take = min(n, room)
                    pieces.append((key, start, take))
                    room -= take
                    if take < n:
                        opened.append((n - take, order, key, start + take))
                yield size, pieces


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, tiers: tuple[int, ...] = TIERS, group_windows: int = 8, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document in a window: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    tier (the window's length), step_group, and with with_ids the piece's ids.

    Each task packs the documents that it reads: nothing is shuffled, and what a task holds is bounded by BLOCK_IDS
    and its longest document. A step group has as many ids as group_windows windows of the longest tier: windows of a
    tier fill a group together, and what is left of all tiers fills groups too, the longest windows first. As windows are
    powers of two, every group is full but a task's last. Windows carry the task's number, so a repeated task gives the
    same ones.

    A null text is empty and has the end id alone; a row with a null id keeps it; repeated rows are packed each; an
    empty table gives no rows; further columns are left out.
    """
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, tier int, step_group long"
    schema += ", ids array<int>" if with_ids else ""
    end, group_ids = end_id.to_bytes(4, "little"), group_windows * tiers[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path)
        base, made = TaskContext.get().partitionId() << 33, 0
        open_groups: dict[int, list[list[tuple]]] = {}  # windows of a tier that do not fill a group yet
        groups = 0
        held: dict[int, tuple[object, bytes, int]] = {}
        pool, size, count = Pool([]), 0, 0
        out_type = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(cols[0], out_type), *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array(cols[7], pa.int32())]
            arrays.append(pa.array(cols[-1], pa.int64()))
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<i4") for x in cols[8]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group", *(["ids"] if with_ids else [])])

        def grouped(closed: list[list[tuple]]) -> list[tuple]:
            """The rows of windows that make up a group."""
            nonlocal groups
            groups += 1
            return [(*row, base + groups - 1) for window in closed for row in window]

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made, size
            rows = []
            for tier, pieces in windows(pool, tiers, last):
                at, window = 0, []
                for key, start, n in pieces:
                    doc, ids, total = held[key]
                    part = ids[4 * start : 4 * (start + n)]
                    window.append((doc, start, n, zlib.crc32(part), total, base + made, at, tier, *([part] if with_ids else [])))
                    at += n
                made += 1
                waiting = open_groups.setdefault(tier, [])
                waiting.append(window)
                if len(waiting) * tier >= group_ids:
                    rows += grouped(waiting)
                    open_groups[tier] = []
            if last:
                rest, full = [], 0
                for tier in sorted(open_groups, reverse=True):
                    for window in open_groups[tier]:
                        rest.append(window)
                        full += tier
                        if full >= group_ids:
                            rows += grouped(rest)
                            rest, full = [], 0
                rows += grouped(rest) if rest else []
            left = {item[2] for item in pool.items}
            for key in [k for k in held if k not in left]:
                del held[key]
            size = sum(x[0] for x in pool.items)
            for a in range(0, len(rows), 20_000):
                yield batch_of(rows[a : a + 20_000])

        for batch in text_chunks(batches, text_col):
            keys = batch.column(0)
            out_type = keys.type
            for doc, text in zip(keys.to_pylist(), as_bytes(batch.column(1)), strict=True):
                ids = words.encode(text) + end
                held[count] = (doc, ids, len(ids) // 4)
                pool.items.append((len(ids) // 4, -count, count, 0))
                size += len(ids) // 4
                count += 1
            if size >= BLOCK_IDS:
                pool.items.sort()
                yield from emit(False)
        pool.items.sort()
        yield from emit(True)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
