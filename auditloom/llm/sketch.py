"""Counts of hashes in a table of fixed size, over a whole corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import U64

#: Cells of the table, and the pieces that it travels in.
CELLS, PIECES = 1 << 18, 64
_SHIFT = U64(64 - 18)


def cell(hashes: np.ndarray) -> np.ndarray:
    """Cell of each 64-bit hash."""
    return (hashes >> _SHIFT).astype(np.int64)


def count_cells(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """How many hashes of all batches fall into each cell.

    Tasks send their tables in pieces, which are summed as a stream; the driver
    gets ``PIECES`` rows, two megabytes, whatever the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for h in hashes(batch):
                total += np.bincount(cell(h), minlength=CELLS)
        yield _pieces(total, range(PIECES))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(packed, np.int64)
        if sums:
            yield _pieces(np.concatenate([sums[p] for p in sorted(sums)]), sorted(sums))

    kind = "piece int, counts binary"
    counted = rows.mapInArrow(count, kind).repartition(PIECES, "piece").mapInArrow(add, kind)
    total = np.zeros((PIECES, CELLS // PIECES), np.int64)
    for row in counted.collect():
        total[row["piece"]] += np.frombuffer(row["counts"], np.int64)
    return total.ravel()


def _pieces(counts: np.ndarray, names) -> pa.RecordBatch:
    parts = counts.reshape(len(names), -1)
    return pa.RecordBatch.from_arrays([pa.array(list(names), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["piece", "counts"])
