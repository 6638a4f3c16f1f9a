"""Groups of neighbouring rows in a stream of Arrow batches, and clusters of linked rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def starts(table: pa.Table | pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Places where a new group of equal (integer) keys begins."""
    fresh = np.zeros(table.num_rows, bool)
    fresh[:1] = True
    for key in keys:
        x = table.column(key).to_numpy()
        fresh[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(fresh)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int) -> Iterator[pa.Table]:
    """Tables of some ``rows`` rows that hold whole groups; rows of a group must stand side by side.

    What may go on in the next batch waits, so memory holds ``rows`` rows and
    the longest group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held)
        last = int(starts(table, keys)[-1])
        if last:
            yield table.slice(0, last)
            held = table.slice(last).to_batches()
        else:
            held = table.to_batches()
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def pairs_within(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places in each group of neighbouring places."""
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    later = np.repeat(size, size) - 1 - place
    left = np.repeat(np.repeat(first, size) + place, later)
    step = np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later)
    return left, left + 1 + step


def spanning_stars(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An edge from each linked id to the least id of its cluster; ``i`` and ``j`` are places of linked rows."""
    values, rank = np.unique(ids, return_inverse=True)
    i, j, least = rank[i], rank[j], np.arange(len(values))
    while True:
        before = least.copy()
        np.minimum.at(least, i, before[j])
        np.minimum.at(least, j, before[i])
        least = least[least]
        if (least == before).all():
            break
    moved = np.flatnonzero(least != np.arange(len(values)))
    return values[moved], values[least[moved]]
