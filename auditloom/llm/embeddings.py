"""Embedding near-duplicates: Euclidean p-stable hashing, then exact cosines.

Vectors are normalised; a table's key is the tuple of ``HASHES`` random
projections quantised by ``WIDTH``, and there are ``TABLES`` tables. At cosine
0.93 a pair shares a key of one table with probability 0.076, of any with
0.998; closer pairs do nearly always, unrelated ones hardly ever. Equal vectors
(of equal label) are one class from the start and never paired.

1. A task looks for buckets among its own vectors first. Of one that is crowded
   there it sends one vector to the bucket, and those that ``SIGNS`` random signs
   tell apart from it; the rows of the others lie under their ids. So a bucket
   that holds a third of all vectors arrives as few rows. What is sent is a key
   and an id.
2. Buckets of two or more give candidate edges, by signs alone; large ones a part
   at a time, where the least vector comes to every part.
3. Of buckets that were crowded or parted, those that still hold several
   components of candidates are taken whole: every vector meets all those of
   other components, in blocks. So any two vectors that share a bucket and most
   signs end in one component, however many others lie there.
4. Components of the candidates get their vectors, once. All pairs of a
   component are multiplied, in blocks of ``BLOCK`` vectors: every link of a
   pair that is connected by candidates counts, whether it shared a bucket or
   not. Tasks send a count for each vector and spanning stars, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, materialize
from .grouping import pairs_within, spanning_stars, starts, whole_groups
from .textkit import U64, as_long, mix

HASHES, TABLES, WIDTH, SEED = 16, 80, 2.0, 5
#: Random signs of a vector, and most that may differ: at cosine 0.93, 15 do on average and more than 36 once in 10**8 pairs.
SIGNS, DIFFER = 128, 36
#: Rows that are worked on together; vectors of a block, on average; of a group whose pairs are listed.
ROWS, BLOCK, SMALL = 4096, 512, 48
#: Vectors of a bucket in one task from which on one of them speaks for those like it.
CROWD = 8
_KEY_BITS = U64(48)


@lru_cache(maxsize=8)
def _projections(d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, d])
    return rng.normal(size=(d, TABLES * HASHES)), rng.uniform(0, WIDTH, TABLES * HASHES), rng.normal(size=(d, SIGNS))


def keys(unit: np.ndarray) -> np.ndarray:
    """Key of each unit vector in each table, ``[vector, TABLES]``."""
    directions, shifts, _ = _projections(unit.shape[1])
    # Rounded first: a vector must fall into the same cell in whatever batch it is projected.
    cells = np.floor(np.round((unit @ directions + shifts) / WIDTH, 9)).astype(np.int64).view(np.uint64)
    cells = cells.reshape(len(unit), TABLES, HASHES)
    out = np.full((len(unit), TABLES), unit.shape[1], U64) + np.arange(TABLES, dtype=U64) * U64(0xD6E8FEB86659FD93)
    for k in range(HASHES):
        out = mix(out * U64(0x9E3779B97F4A7C15) + cells[:, :, k])
    return out


def signs(unit: np.ndarray) -> np.ndarray:
    """Signs of each unit vector's random projections, packed, ``[vector, SIGNS / 64]``."""
    bits = np.round(unit @ _projections(unit.shape[1])[2], 9) > 0
    return np.packbits(bits, axis=1).view("<u8")


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1) <= DIFFER


def _unit(packed: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(float)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _bucket_rows(ids: np.ndarray, label: np.ndarray, unit: np.ndarray) -> pa.RecordBatch:
    """``h, id, near, crowd``: a row for each bucket and vector.

    Where another vector, ``near``, speaks for it here, the bucket stands in
    ``crowd`` and ``h`` is the vector's id.
    """
    h = mix(keys(unit) + label.view(U64)[:, None] * U64(0x9E3779B97F4A7C15)) >> (U64(64) - _KEY_BITS)
    row = np.repeat(np.arange(len(ids)), TABLES)
    h = h.ravel()
    order = np.lexsort((ids[row], h))
    h, row = h[order].astype(np.int64), row[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(first, len(h)))
    speaker = np.repeat(row[first], size)
    packed = signs(unit)
    other = np.flatnonzero((ids[speaker] != ids[row]) & (np.repeat(size, size) >= CROWD))
    spoken = other[(label[row[other]] == label[speaker[other]]) & _alike(packed[row[other]], packed[speaker[other]])]
    alone = np.ones(len(h), bool)
    alone[spoken] = False
    there, quiet = ids[row[alone]], ids[row[spoken]]
    crowd = pa.array(np.concatenate([np.zeros(len(there), np.int64), h[spoken]]), mask=np.arange(len(h)) < len(there))
    columns = [np.concatenate([h[alone], quiet]), np.concatenate([there, quiet]), np.concatenate([there, ids[speaker[spoken]]])]
    return pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), crowd], ["h", "id", "near", "crowd"])


def _near_pairs(unit: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, block: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of the same group, one of each block if it is a group of two; groups lie together."""
    size = np.diff(np.append(first, len(unit)))
    small = (size <= SMALL) & (low[first] == high[first])
    for lo in range(0, int(small.sum()), 4096):
        x, y = pairs_within(first[small][lo : lo + 4096], size[small][lo : lo + 4096])
        for k in range(0, len(x), 50_000):
            i, j = x[k : k + 50_000], y[k : k + 50_000]
            near = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
            yield i[near], j[near]
    for start, n in zip(first[~small].tolist(), size[~small].tolist(), strict=True):
        rows = np.arange(start, start + n)
        same = low[start] == high[start]
        a, b = (rows, rows) if same else (rows[block[rows] == low[start]], rows[block[rows] == high[start]])
        for lo in range(0, len(a), 256):
            part = a[lo : lo + 256]
            close = unit[part] @ unit[b].T >= threshold
            if same:
                close &= part[:, None] < b[None, :]
            i, j = np.nonzero(close)
            for k in range(0, len(i), 50_000):
                yield part[i[k : k + 50_000]], b[j[k : k + 50_000]]


def _count_links(table: pa.Table, threshold: float, kind: str) -> pa.RecordBatch:
    """``id, links, root``: counts of links and spanning stars of whole groups."""
    ids, weight, label = (table.column(c).to_numpy() for c in ("id", "n", "l"))
    low, high, block, group = (table.column(c).to_numpy() for c in ("low", "high", "block", "g"))
    packed = table.column("x").to_pylist()
    links, pairs = np.zeros(len(ids), np.int64), []
    for d in sorted({len(x) for x in packed}):
        at = np.array([i for i, x in enumerate(packed) if len(x) == d])
        fresh = np.flatnonzero(np.concatenate([[True], (group[at][1:] != group[at][:-1]) | (low[at][1:] != low[at][:-1]) | (high[at][1:] != high[at][:-1])]))
        for x, y in _near_pairs(_unit([packed[i] for i in at], kind), fresh, low[at], high[at], block[at], threshold):
            same = label[at[x]] == label[at[y]]
            x, y = at[x[same]], at[y[same]]
            np.add.at(links, x, weight[y])
            np.add.at(links, y, weight[x])
            pairs.append((x, y))
    i, j = (np.concatenate([p[k] for p in pairs] or [np.zeros(0, np.int64)]) for k in (0, 1))
    node, root = spanning_stars(ids, i, j)
    counted = links > 0
    none = np.zeros(len(node), np.int64)
    columns = [np.concatenate([ids[counted], node]), np.concatenate([links[counted], none]), np.concatenate([ids[counted], root])]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["id", "links", "root"])


def _between_components(rows: DataFrame, signed: DataFrame) -> DataFrame:
    """Candidate edges ``a, b`` between different components ``c`` of the same bucket, of rows ``h, id, c`` of whole buckets.

    All but a bucket's largest component are guests; each guest meets every
    other vector of the bucket, in blocks of some ``BLOCK`` guests and vectors.
    """
    parts = rows.groupBy("h", "c").agg(F.count("*").alias("m")).groupBy("h").agg(F.max(F.struct("m", "c")).alias("most"), F.sum("m").alias("n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    parts = parts.where("most.m < n").select("h", F.col("most.c").alias("host"), blocks(F.col("n") - F.col("most.m")).alias("guests"), blocks(F.col("n")).alias("all"))
    rows = rows.join(parts, "h").join(signed, "id")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["id", "l", "s", "c"]
    guests = rows.where("c <> host").withColumn("i", own("guests")).select("h", "i", every("all").alias("j"), F.lit(True).alias("guest"), *kept)
    others = rows.withColumn("j", own("all")).select("h", every("guests").alias("i"), "j", F.lit(False).alias("guest"), *kept)
    rows = guests.union(others).repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["h", "i", "j"], ROWS):
            ids, label, component = (table.column(c).to_numpy() for c in ("id", "l", "c"))
            guest = table.column("guest").to_numpy()
            packed = np.frombuffer(b"".join(table.column("s").to_pylist()), "<u8").reshape(len(ids), -1)
            first = starts(table, ["h", "i", "j"])
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(ids)], strict=True):
                x, y = lo + np.flatnonzero(guest[lo:hi]), lo + np.flatnonzero(~guest[lo:hi])
                for k in range(0, len(x), 64):
                    some = x[k : k + 64, None]
                    near = (np.bitwise_count(packed[some] ^ packed[y]).sum(2) <= DIFFER) & (label[some] == label[y]) & (component[some] != component[y])
                    i, j = np.nonzero(near)
                    left.append(some[i, 0])
                    right.append(y[j])
            a, b = spanning_stars(ids, np.concatenate(left), np.concatenate(right))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _candidate_components(classes: DataFrame, kind: str) -> DataFrame:
    """``node, component`` of candidate edges: any two vectors that share a bucket and most of their signs are in one component."""

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def rows() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            packed, ids, label = table.column("x").to_pylist(), table.column("id").to_numpy(), table.column("l").to_numpy()
            for d in sorted({len(x) for x in packed}):
                at = np.array([i for i, x in enumerate(packed) if len(x) == d])
                yield _bucket_rows(ids[at], label[at], _unit([packed[i] for i in at], kind))

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                yield from rows()
                held.clear()
        if sum(b.num_rows for b in held):
            yield from rows()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, out = batch.column("x").to_pylist(), np.zeros((batch.num_rows, SIGNS // 64), "<u8")
            for d in sorted({len(x) for x in packed}):
                at = np.array([i for i, x in enumerate(packed) if len(x) == d])
                out[at] = signs(_unit([packed[i] for i in at], kind))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("l"), pa.array([r.tobytes() for r in out], pa.binary())], ["id", "l", "s"])

    # Rows of vectors that another speaks for lie under the vector's id, apart from the buckets.
    entries = classes.select("id", "l", "x").mapInArrow(buckets, "h long, id long, near long, crowd long")
    bucket = Window.partitionBy("h", F.col("crowd").isNull())
    entries = entries.withColumns({"least": F.min("id").over(bucket), "size": F.count("*").over(bucket)}).where("crowd is not null or size > 1")
    entries = materialize(entries, "vector-buckets")
    sent, spoken = entries.where("crowd is null"), entries.where("crowd is not null")
    parts = F.ceil(F.col("size") / SMALL).cast("int")
    places = F.when(F.col("id") == F.col("least"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), parts.cast("long")).cast("int")))
    with_signs = classes.select("id", "l", "x").mapInArrow(signed, "id long, l long, s binary")
    shared = sent.select("h", F.explode(places).alias("part"), "id").join(with_signs, "id")
    shared = shared.repartition("h", "part").sortWithinPartitions("h", "part").select("h", "part", "id", "l", "s")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["h", "part"], ROWS):
            ids, label = table.column("id").to_numpy(), table.column("l").to_numpy()
            packed = np.frombuffer(b"".join(table.column("s").to_pylist()), "<u8").reshape(len(ids), -1)
            first = starts(table, ["h", "part"])
            size = np.diff(np.append(first, len(ids)))
            left, right = [], []
            for lo in range(0, len(first), 512):
                x, y = pairs_within(first[lo : lo + 512], size[lo : lo + 512])
                near = (label[x] == label[y]) & _alike(packed[x], packed[y])
                left.append(x[near])
                right.append(y[near])
            a, b = spanning_stars(ids, np.concatenate(left), np.concatenate(right))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    found = shared.mapInArrow(pairs, "a long, b long")
    near = connected_components(spoken.select(F.col("id").alias("a"), F.col("near").alias("b")).union(found).distinct())
    # What speakers and parts kept from meeting: whole buckets, where they hold several components.
    crowds = spoken.select(F.col("crowd").alias("h"), "id")
    if crowds.isEmpty() and sent.where(F.col("size") > SMALL).isEmpty():
        return near
    small = sent.where(F.col("size") <= SMALL).select("h", "id").join(crowds.select("h").distinct(), "h", "left_semi")
    whole = crowds.union(sent.where(F.col("size") > SMALL).select("h", "id")).union(small).distinct()
    whole = whole.join(near.select(F.col("node").alias("id"), "component"), "id", "left").select("h", "id", F.coalesce("component", "id").alias("c"))
    more = materialize(_between_components(whole, with_signs), "vector-guests")
    if more.isEmpty():
        return near
    return connected_components(near.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", embedding_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Two rows link when their labels are equal and not null, their vectors have
    equal length and their cosine, in double precision, is ``threshold`` or
    more. A vector that is null, empty, zero, or holds null or non-finite
    components links with nothing, and so does a row without an id; such a row
    is its own component. Repeated rows are vectors in their own right, but rows
    of one id are one node, whose counts of links add up. An empty table gives an empty result; only the three named columns are read.
    Tables and signs are laid out for thresholds of 0.93 or more.
    """
    element = vectors.schema[embedding_col].dataType.elementType.simpleString()
    element, kind = ("float", "<f4") if element == "float" else ("double", "<f8")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(embedding_col).cast(f"array<{element}>").alias("v"), F.col(label_col).alias("label"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda c: c != 0), F.lit(False))
    rows = rows.withColumn("sound", sound)
    # -0.0 and 0.0 are one value to the grouping and to the cosine.
    classes = rows.where("sound").groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("n"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column("v").flatten()).astype(kind)
            ends = np.cumsum(batch.column("v").value_lengths().to_numpy())
            x = pa.array([r.tobytes() for r in np.split(values, ends[:-1])], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "l", "id", "n")), x], ["label", "l", "id", "n", "x"])

    label = rows.schema["label"].dataType.simpleString()
    classes = classes.select("label", F.xxhash64("label").alias("l"), "id", "n", "v").mapInArrow(packed, f"label {label}, l long, id long, n long, x binary")
    classes = materialize(classes, "vectors")
    near = _candidate_components(classes, kind).select(F.col("node").alias("id"), F.col("component").alias("g"))
    sizes = near.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    members = near.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    members = members.select("g", "id", "block", other).select("g", "id", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    members = members.join(classes.select("id", "l", "n", "x"), "id").repartition("g", "low", "high").sortWithinPartitions("g", "low", "high")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["g", "low", "high"], ROWS):
            yield _count_links(table, threshold, kind)

    found = materialize(members.select("g", "low", "high", "block", "id", "l", "n", "x").mapInArrow(count, "id long, links long, root long"), "vector-links")
    direct = found.groupBy("id").agg(F.sum("links").alias("links"))
    stars = connected_components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    linked = direct.join(stars.withColumnRenamed("node", "id"), "id", "left")
    # Back to rows: every row of a class has its representative's links and its class mates.
    mates = materialize(rows.where("sound").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "vector-mates")
    classed = rows.where("sound").join(mates, ["label", "v"], "left").select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("n", F.lit(1)).alias("n"))
    classed = classed.join(linked.withColumnRenamed("id", "rep"), "rep", "left")
    joined = classed.select("id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = rows.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = joined.union(alone)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
