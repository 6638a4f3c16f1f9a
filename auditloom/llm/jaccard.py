"""N-gram Jaccard join by blocked sparse products of the document x n-gram matrix.

Documents with equal shingle sets are one class and one row of the matrix. All
candidates go through products of blocks:

1. *Columns.* Of each row only the prefix enters: the rarest ``n - ceil(t n) +
   1`` columns, of which two sets of similarity ``t`` share one at least.
   Columns are ordered by the rarest of their words (from a word-count sketch of
   fixed size over the whole corpus) and then by hash, so common wording stays
   out of the prefixes. A column's rows, in order of size, fall into stretches
   whose neighbours are near enough in size; a row alone in its stretch goes.
   The product of a stretch keeps pairs whose sizes allow the bound and whose
   overlap can reach it: the smaller counts of hash cells, of which a set has
   one for each ``CELL_SHINGLES`` shingles, add up to no less than the overlap. Columns of more than ``COLUMN_ROWS`` rows pair
   each row with the least of its size band instead.
2. *Components of the candidates.* A component of one block's size is
   multiplied whole: exact overlaps of all its pairs accumulate over strips of
   shared columns, and pairs below the bound go.
3. *Larger ones.* Of larger components the candidate pairs are multiplied
   first, a block for each centre. Where that, or a column of step 1 that was
   not multiplied whole, leaves several components of links, the documents are
   dealt into blocks by size and by component, and all pairs of blocks that can
   still connect two components are compared: by cells first, and those that may
   link by the product of their sets.

A block sends spanning stars of what it linked, never pairs. Nothing is
sampled: every pair that may link is compared, unless it is connected already.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, let_go, materialize
from .grouping import pairs_within, spanning_stars, starts, whole_groups
from .sketch import cell, count_cells
from .textkit import U64, Words, as_long, gram_hashes, mix, split_words, text_slices

#: Rows of a column that are multiplied as one block.
COLUMN_ROWS = 48
#: Documents and shingles of a block, at most.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1_000_000
#: Shingles of a hash cell, on average; least number of cells; and the count from which on a cell bounds nothing.
CELL_SHINGLES, LEAST_CELLS, MANY = 8, 128, 255
#: Columns that a dense product takes at a time, rows that are worked on together, and pairs whose bounds are.
STRIP, ROWS, PAIRS = 4096, 2048, 20_000
EDGE = "a long, b long"


def word_ranks(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How common each sketch cell's words are, as half binary logarithms of counts over all documents."""

    def words(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in text_slices(batch.column(0)):
            yield split_words(data, offsets, lower=True).hash

    return np.floor(2 * np.log2(count_cells(docs.select(text_col), words) + 1)).astype(np.uint8)


def prefix_size(n: int, num: int, den: int) -> int:
    """Columns of a set of ``n`` of which a set of similarity ``num / den`` or more shares one."""
    return n - -(-num * n // den) + 1 if n else 0


def shingle_sets(words: Words, n: int, ranks: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Distinct shingle hashes of each text, ascending, and their ranks.

    A text of fewer than ``n`` words has its whole sequence as one shingle; one
    without words has none.
    """
    grams = gram_hashes(words.hash, n)
    common = None
    if ranks is not None:
        word = ranks[cell(words.hash)]
        common = word[: len(grams)].copy()
        for i in range(1, n):
            np.minimum(common, word[i : len(grams) + i], out=common)
    for lo, hi in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if hi - lo >= n:
            s, at = np.unique(grams[lo : hi - n + 1], return_index=True)
            yield s, None if common is None else common[lo + at]
        elif hi > lo:
            s = gram_hashes(words.hash[lo:hi], hi - lo)
            yield s, None if common is None else np.zeros(1, np.uint8)
        else:
            yield np.zeros(0, U64), None if common is None else np.zeros(0, np.uint8)


def cell_counts(s: np.ndarray) -> np.ndarray:
    """Counts of a set's hash cells; their number is a power of two that grows with the set."""
    cells = max(LEAST_CELLS, 1 << max(len(s) // CELL_SHINGLES, 1).bit_length())
    return np.bincount((s & U64(cells - 1)).astype(np.int64), minlength=cells).clip(max=MANY).astype(np.uint8)


def _rows(docs: DataFrame, n: int, num: int, den: int, ranks: np.ndarray) -> DataFrame:
    """``id, n, f1, f2, prefix, cells``: size, 128-bit fingerprint, prefix columns and cell counts of each row's set."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a byte for each sketch cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            size, f1, f2, prefix, cells = [], [], [], [], []
            for _, _, data, offsets in text_slices(batch.column(1)):
                for s, r in shingle_sets(split_words(data, offsets, lower=True), n, shared.value):
                    size.append(len(s))
                    f1.append(np.add.reduce(mix(s + U64(1)), dtype=U64))
                    f2.append(np.add.reduce(mix(s ^ U64(0x5851F42D4C957F2D)), dtype=U64))
                    order = np.lexsort((s, r))[: prefix_size(len(s), num, den)]
                    prefix.append(as_long(s[order]))
                    cells.append(cell_counts(s).tobytes())
            f1, f2 = (pa.array(as_long(np.array(f, U64)), pa.int64()) for f in (f1, f2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), f1, f2, pa.array(prefix, pa.list_(pa.int64())), pa.array(cells, pa.binary())], ["id", "n", "f1", "f2", "prefix", "cells"])

    return docs.mapInArrow(run, "id long, n long, f1 long, f2 long, prefix array<long>, cells binary")


def _sets(texts: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """``id, n, s``: the whole set of each row whose id is needed, packed; texts travel compressed.

    The needed texts are written in between, so that no task holds two Python
    workers.
    """

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        write = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            zipped = pa.array([write((t.as_py() or "").encode()) for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), zipped], ["id", "z"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            size, packed = [], []
            texts = pa.array([read(z.as_py()) for z in batch.column(1)], pa.large_binary()).view(pa.large_string())
            for _, _, data, offsets in text_slices(texts):
                for s, _ in shingle_sets(split_words(data, offsets, lower=True), n):
                    size.append(len(s))
                    packed.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(packed, pa.binary())], ["id", "n", "s"])

    zipped = texts.where("id is not null").mapInArrow(shrink, "id long, z binary").join(needed, "id")
    zipped = materialize(zipped.select("id", "z"), "ngram-texts")
    return materialize(zipped.mapInArrow(run, "id long, n long, s binary"), "ngram-sets", replaces=zipped)


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _near(n: Column, other: Column, num: int, den: int) -> Column:
    """Whether sets of these sizes can link."""
    return den * F.least(n, other) >= num * F.greatest(n, other)


def _band(num: int, den: int) -> Column:
    """Band of sizes: sets that may link lie in one band or in neighbouring ones (a little wider, for rounding)."""
    return F.floor(F.log(F.col("n").cast("double")) / (math.log(den / num) * (1 + 1e-9)) if num < den else F.col("n")).cast("long")


class Cells:
    """Cell counts of many sets, by number of cells; the finer of a pair is folded to the other's."""

    def __init__(self, packed: list[bytes]):
        self.size = np.array([len(x) for x in packed], np.int64)
        self._packed, self._level = packed, {}

    def at(self, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """Place of each set in the matrix of the sets that have so many cells or more, and that matrix."""
        if cells not in self._level:
            rows = np.flatnonzero(self.size >= cells)
            matrix = np.empty((len(rows), cells), np.uint8)
            for k, i in enumerate(rows.tolist()):
                x = np.frombuffer(self._packed[i], np.uint8).reshape(-1, cells)
                matrix[k] = np.where((x == MANY).any(0), MANY, np.minimum(x.sum(0, dtype=np.int64), MANY)) if len(x) > 1 else x[0]
            place = np.full(len(self.size), -1, np.int64)
            place[rows] = np.arange(len(rows))
            self._level[cells] = place, matrix
        return self._level[cells]


def _may_link(n: np.ndarray, cells: Cells, x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the pairs link unless their overlap stays below its upper bound."""
    out = np.zeros(len(x), bool)
    shared = np.minimum(cells.size[x], cells.size[y])
    for count in np.unique(shared).tolist():
        pairs = np.flatnonzero(shared == count)
        place, matrix = cells.at(count)
        step = max(1, PAIRS * LEAST_CELLS // count)
        for lo in range(0, len(pairs), step):
            at = pairs[lo : lo + step]
            i, j = x[at], y[at]
            least = np.minimum(matrix[place[i]], matrix[place[j]])
            most = np.where((least == MANY).any(1), np.minimum(n[i], n[j]), least.sum(1, dtype=np.int64))
            out[at] = den * most >= num * (n[i] + n[j] - most)
    return out


def _column_products(postings: DataFrame, kept: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate edges ``a, b`` from columns of few rows: spanning stars of the pairs that pass the bounds."""
    by_size = Window.partitionBy("col").orderBy("n", "id")
    before, after = F.lag("n").over(by_size), F.lead("n").over(by_size)
    joins = F.coalesce(_near(F.col("n"), before, num, den), F.lit(False))
    goes_on = F.coalesce(_near(F.col("n"), after, num, den), F.lit(False))
    rows = postings.withColumns({"joins": joins, "goes_on": goes_on}).withColumn("stretch", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(by_size))
    rows = rows.where("joins or goes_on").select("col", "stretch", "id").join(kept.select("id", "n", "cells"), "id")
    rows = rows.repartition("col", "stretch").sortWithinPartitions("col", "stretch").select("col", "stretch", "id", "n", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["col", "stretch"], ROWS):
            ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
            cells = Cells(table.column("cells").to_pylist())
            first = starts(table, ["col", "stretch"])
            x, y = pairs_within(first, np.diff(np.append(first, len(ids))))
            near = (ids[x] != ids[y]) & (den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y]))
            x, y = x[near], y[near]
            may = _may_link(n, cells, x, y, num, den)
            yield _edges(*spanning_stars(ids, x[may], y[may]))

    return rows.mapInArrow(run, EDGE)


def _pairs_of_leaders(hot: DataFrame, kept: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate edges from columns of many rows: each with the least of its size band that passes the bounds."""
    hot = hot.withColumn("band", _band(num, den))
    leaders = hot.groupBy("col", "band").agg(F.min(F.struct("id", "n")).alias("x")).select("col", "band", F.col("x.id").alias("b"), F.col("x.n").alias("nb"))
    pairs = hot.join(leaders, ["col", "band"]).where(_near(F.col("n"), F.col("nb"), num, den) & (F.col("id") != F.col("b"))).select(F.col("id").alias("a"), "b").distinct()
    left = kept.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("cells").alias("ca"))
    right = kept.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("cells").alias("cb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_rows
            cells = Cells(batch.column("ca").to_pylist() + batch.column("cb").to_pylist())
            n = np.concatenate([batch.column(c).to_numpy() for c in ("na", "nb")])
            may = _may_link(n, cells, np.arange(k), np.arange(k, 2 * k), num, den)
            yield batch.select(["a", "b"]).filter(pa.array(may))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ca", "cb").mapInArrow(run, EDGE)


def block_links(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> np.ndarray:
    """Which rows of the two blocks link, ``[left, right]``; of one block with itself if ``right`` is None.

    A strip of shared columns at a time, dense 0/1 rows are multiplied and the
    overlaps added up.
    """
    other = left if right is None else right
    sides = (left,) if right is None else (left, other)  # a block with itself is laid out once
    sizes = [np.array([len(x) for x in side], np.int64) for side in (left, other)]
    columns = [np.concatenate(side) if len(side) else np.zeros(0, U64) for side in sides]
    if right is None:
        values, times = np.unique(columns[0], return_counts=True)
        shared = values[times > 1]
    else:
        shared = np.intersect1d(np.unique(columns[0]), np.unique(columns[1]), assume_unique=True)
    overlap = np.zeros((len(left), len(other)), np.float32)
    places = []
    for side, size in zip(columns, sizes, strict=False):
        row = np.repeat(np.arange(len(size)), size)
        at = np.minimum(np.searchsorted(shared, side), max(len(shared) - 1, 0))
        hit = shared[at] == side if len(shared) else np.zeros(len(side), bool)
        row, at = row[hit], at[hit]
        order = np.argsort(at, kind="stable")
        places.append((row[order], at[order]))
    for lo in range(0, len(shared), STRIP):
        dense = []
        for (row, at), size in zip(places, sizes, strict=False):
            i, j = np.searchsorted(at, [lo, lo + STRIP])
            block = np.zeros((len(size), min(STRIP, len(shared) - lo)), np.float32)
            block[row[i:j], at[i:j] - lo] = 1
            dense.append(block)
        overlap += dense[0] @ dense[-1].T
    both = np.rint(overlap).astype(np.int64)
    if right is None:
        np.fill_diagonal(both, 0)  # an only-own column is not shared; itself is no partner
    link = den * both >= num * (sizes[0][:, None] + sizes[1][None, :] - both)
    return link & (both > 0)


def _unpacked(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), U64) for x in column]


def _whole_products(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links ``a, b`` within groups ``g`` of one block's size, each multiplied whole."""
    rows = members.select("id", "g").join(sets, "id").repartition("g").sortWithinPartitions("g", "id").select("g", "id", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["g"], ROWS // 8):
            ids, s, first = table.column("id").to_numpy(), _unpacked(table.column("s")), starts(table, ["g"])
            left, right = [], []
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(ids)], strict=True):
                i, j = np.nonzero(block_links(s[lo:hi], None, num, den))
                left.append(lo + i)
                right.append(lo + j)
            yield _edges(*spanning_stars(ids, np.concatenate(left), np.concatenate(right)))

    return rows.mapInArrow(run, EDGE)


def _star_products(edges: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the edges ``a, b`` that link; the blocks are ``b`` by stretches of its partners."""
    parts = edges.groupBy("b").agg(F.ceil(F.count("*") / BLOCK_DOCS).alias("parts"))
    edges = edges.join(parts, "b").select(F.col("b").alias("centre"), F.pmod(F.xxhash64("a"), "parts").alias("part"), F.col("a").alias("id"))
    rows = edges.union(edges.select("centre", "part", "centre").distinct()).join(sets, "id")
    rows = rows.repartition("centre", "part").sortWithinPartitions("centre", "part").select("centre", "part", "id", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["centre", "part"], ROWS // 8):
            ids, centre, s = table.column("id").to_numpy(), table.column("centre").to_numpy(), _unpacked(table.column("s"))
            first = starts(table, ["centre", "part"])
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(ids)], strict=True):
                inner = [k for k in range(lo, hi) if ids[k] == centre[k]]
                outer = [k for k in range(lo, hi) if ids[k] != centre[k]]
                linked = block_links([s[k] for k in outer], [s[k] for k in inner], num, den).any(1)
                mine = ids[outer][linked]
                yield _edges(mine, np.full(len(mine), centre[lo]))

    return rows.mapInArrow(run, EDGE)


def _dealt(members: DataFrame) -> DataFrame:
    """``lo, hi, id, component, block``: members ``id, component, g, n`` dealt to all pairs of blocks that can connect two components.

    Blocks hold documents of one size band; those of a large component keep to
    themselves, so that pairs of blocks that are connected already are told
    from the blocks alone and never travel.
    """
    parts = lambda docs, shingles: F.greatest(F.ceil(F.sum(docs) / BLOCK_DOCS), F.ceil(F.sum(shingles) / BLOCK_SHINGLES))
    own = members.groupBy("g", "band", "component").agg(F.count("*").alias("m"), F.sum("n").alias("total"), parts(F.lit(1), F.col("n")).alias("own"))
    pooled = own.where("own = 1").groupBy("g", "band").agg(parts("m", "total").alias("pool"))
    own = own.join(pooled, ["g", "band"], "left").select("g", "band", "component", "own", "pool")
    # A large component has blocks of its own, the others go to a block whole.
    place = F.when(F.col("own") > 1, F.struct(F.col("component").alias("c"), F.pmod(F.xxhash64("id"), "own").alias("k"))).otherwise(F.struct(F.lit(None).cast("long").alias("c"), F.pmod(F.xxhash64("component"), "pool").alias("k")))
    members = materialize(members.join(own, ["g", "band", "component"]).select("id", "component", "g", "band", F.xxhash64("g", "band", place).alias("block")), "ngram-blocks")
    blocks = members.groupBy("g", "band", "block").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
    above = blocks.select("g", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), F.col("band").alias("at"), F.col("block").alias("hi"), F.col("c0").alias("d0"), F.col("c1").alias("d1"))
    pairs = blocks.join(above, ["g", "band"]).where("(at > band or block <= hi) and not (c0 = c1 and d0 = d1 and c0 = d0)").select(F.col("block").alias("lo"), "hi")
    ends = pairs.select("lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"))
    return members.select("id", "component", "block").join(ends, "block").select("lo", "hi", "id", "component", "block")


def _between(rows: DataFrame, linked: Callable[[pd.DataFrame, np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Spanning stars ``a, b`` of what ``linked`` finds between different components in each pair of blocks."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lo, hi = frame["lo"].iloc[0], frame["hi"].iloc[0]
        ids, part, block = (frame[c].to_numpy() for c in ("id", "component", "block"))
        a = np.flatnonzero(block == lo)
        i, j = linked(frame, a, None if lo == hi else np.flatnonzero(block == hi))
        apart = part[i] != part[j]
        x, y = spanning_stars(ids, i[apart], j[apart])
        return pd.DataFrame({"a": x, "b": y})

    return rows.groupBy("lo", "hi").applyInPandas(run, EDGE)


def _block_products(groups: DataFrame, reached: DataFrame, texts: DataFrame, kept: DataFrame, n: int, num: int, den: int) -> DataFrame | None:
    """Links between different components of links among documents that share a group ``col``; None if nothing may link.

    Blocks of cell counts tell first who may link at all; only those come with
    their sets.
    """
    known = groups.join(reached.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = known.groupBy("col").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("id").alias("hub")).where("c0 <> c1")
    known = materialize(known.join(mixed.select("col", "hub"), "col").select("id", "hub", "component").distinct(), "ngram-mixed")
    hubs = connected_components(known.select(F.col("id").alias("a"), F.col("hub").alias("b")))
    members = known.select("id", "component").distinct().join(hubs.select(F.col("node").alias("id"), F.col("component").alias("g")), "id")
    members = members.join(kept.select("id", "n").distinct(), "id").withColumn("band", _band(num, den))

    def may_link(frame: pd.DataFrame, a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        size, part, cells = frame["n"].to_numpy(), frame["component"].to_numpy(), Cells(frame["cells"].tolist())
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in a.tolist():
            other = a[a > i] if b is None else b
            near = (part[other] != part[i]) & (den * np.minimum(size[other], size[i]) >= num * np.maximum(size[other], size[i]))
            other = other[near]
            other = other[_may_link(size, cells, np.full(len(other), i), other, num, den)]
            left.append(np.full(len(other), i))
            right.append(other)
        return np.concatenate(left), np.concatenate(right)

    candidates = materialize(_between(_dealt(members).join(kept.select("id", "n", "cells"), "id"), may_link), "ngram-candidates")
    if candidates.isEmpty():
        return None
    narrowed = connected_components(candidates).select(F.col("node").alias("id"), F.col("component").alias("g"))
    members = members.drop("g").join(narrowed, "id")
    sets = _sets(texts, narrowed.select("id"), n)

    def link(frame: pd.DataFrame, a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        s = [np.frombuffer(x, U64) for x in frame["s"]]
        i, j = np.nonzero(block_links([s[k] for k in a], None if b is None else [s[k] for k in b], num, den))
        return a[i], (a if b is None else b)[j]

    return _between(_dealt(members).join(sets.select("id", "s"), "id"), link)


def components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    A-Z are lowered; words are runs of other than white space; two documents
    link when ``den * intersection >= num * union`` of their sets of distinct
    ``n``-word shingles. ``component_id`` is the smallest id reachable. A null
    or wordless text has an empty set and links with nothing; so does a row
    without an id, whose component is null. Rows with equal ids are one node.
    An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = materialize(_rows(texts, n, num, den, word_ranks(texts)), "ngram-rows")
    sound = rows.where("n > 0 and id is not null")
    classes = materialize(sound.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep")), "ngram-classes")
    kept = sound.join(classes.withColumnRenamed("rep", "id"), ["f1", "f2", "n", "id"]).dropDuplicates(["f1", "f2", "n", "id"])
    postings = kept.select("id", "n", F.explode("prefix").alias("col"))
    often = postings.groupBy("col").agg(F.count("*").alias("m")).where("m > 1")
    postings = materialize(postings.join(often, "col"), "ngram-postings")
    hot = postings.where(F.col("m") > COLUMN_ROWS).drop("m")
    edges = _column_products(postings.where(F.col("m") <= COLUMN_ROWS), kept, num, den).union(_pairs_of_leaders(hot, kept, num, den))
    edges = materialize(edges.distinct(), "ngram-edges")
    members = connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("g"))
    sets = _sets(texts, members.select("id"), n)
    sizes = members.join(sets.select("id", "n"), "id").groupBy("g").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    members = materialize(members.join(sizes, "g").withColumn("large", (F.col("m") > BLOCK_DOCS) | (F.col("total") > BLOCK_SHINGLES)).select("id", "g", "large"), "ngram-members")
    large = members.where("large")
    spokes = edges.join(large.select(F.col("id").alias("a")), "a", "left_semi")
    links = materialize(_whole_products(members.where("not large"), sets, num, den).union(_star_products(spokes, sets, num, den)), "ngram-links")
    reached = connected_components(links)
    groups = hot.select("col", "id").union(large.select(F.xxhash64(F.lit("component"), "g").alias("col"), "id"))
    if not groups.isEmpty():
        more = _block_products(groups, reached, texts, kept, n, num, den)
        if more is not None:
            more = materialize(more, "ngram-links")
            stars = reached.select(F.col("node").alias("a"), F.col("component").alias("b"))
            reached = connected_components(stars.union(more))
    joined = classes.join(reached.withColumnRenamed("node", "rep"), "rep", "left")
    joined = joined.select("f1", "f2", "n", F.coalesce("component", "rep").alias("component"))
    linked = sound.join(joined, ["f1", "f2", "n"]).select("id", "n", "component")
    alone = rows.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component"))
    return linked.union(alone).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
