"""Arrow batches inside tasks: whole groups of sorted rows, and the largest entries of a block of scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401


def grouped(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables that hold whole groups, with the groups' bounds; one group at least is held at a time."""
    rest: pa.Table | None = None

    def bounds(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t) - 1, bool)
        for c in by:
            x = t.column(c).to_numpy()
            new |= x[1:] != x[:-1]
        return np.concatenate(([0], np.flatnonzero(new) + 1, [len(t)]))

    for batch in batches:
        if not len(batch):
            continue
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        b = bounds(t)
        rest = t.slice(b[-2])
        if len(b) > 2:
            yield t.slice(0, b[-2]), b[:-1]
    if rest is not None:
        yield rest, np.array([0, len(rest)])


def largest(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the entries above minus infinity that are among the k largest of their column, ties included."""
    n = len(scores)
    least = np.partition(scores, n - k, axis=0)[n - k] if n > k else np.full(scores.shape[1], -np.inf)
    return np.nonzero((scores >= least) & (scores > -np.inf))


def best_rows(t: pa.Table, k: int) -> pa.Table:
    """Of each query the k rows of the highest score, ties by id."""
    t = t.sort_by([("query", "ascending"), ("raw", "descending"), ("id", "ascending")]).combine_chunks()
    if not len(t):
        return t
    query = pa.compute.fill_null(t["query"].combine_chunks().dictionary_encode().indices, -1).to_numpy()
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
    nth = np.arange(len(t)) - np.repeat(first, np.diff(np.append(first, len(t))))
    return t.filter(pa.array(nth < k))
