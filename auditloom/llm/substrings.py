"""Substring dedup by seed and extend.

**Seeds** are winnowed anchors: of every ``length - k + 1`` neighbouring
``k``-word grams the one of least hash (leftmost on ties). Two places that agree
on ``length`` words choose the same anchor inside them, so no repeat of that
length goes without a seed. The windows of ``length`` words that choose one
anchor form its run.

**Join.** Occurrences meet by anchor in one exchange, which carries the anchor,
a fingerprint of the run's words, and 16 bits each of the words on its left and
on its right.

**Extend both ways.** Occurrences whose whole runs agree (anchor and run
fingerprint, by independent hashes) are one class: every document but its least
loses the run. A class's least document goes on only if another class of the
same anchor agrees with it on the left or on the right half of the extension,
without which no window can agree; it goes on with the windows of that side,
which are compared by 128-bit fingerprints.

**Maximal repeats.** Removed windows that overlap or touch merge into the
longest stretches; these are what is cut out.

A window over an anchor gathers its occurrences. Anchors that hold more than
one part in 65,536 of all occurrences, as a sketch of fixed size over the whole
corpus bounds them, do not go through it but through aggregates with map-side
combination and joins that Spark can split. That share is below an average
partition's, at any size of the corpus. No pairs of documents are formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .sketch import cell, count_cells
from .textkit import U64, Words, as_long, gram_hashes, mix, span_hashes, split_words, text_slices, window_minimum

#: Words of an anchor, and most words that a window may have beside it.
ANCHOR, MOST_BESIDE = 5, 60
#: A sketch cell is frequent from this many times the mean count, plus this many.
FREQUENT_TIMES, FREQUENT_PLUS = 4, 1000
# A run in one long: sides to compare (2 bits), first window (36), the anchor's place in it (6), number of windows (6).
_LEFT, _RIGHT, _START, _OFFSET = 1 << 48, 1 << 49, 12, 6
LONGS = pa.list_(pa.int64())
_RESULT = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_repeats", pa.int64()), ("kept", pa.string())]


def _sizes(length: int) -> tuple[int, int, int]:
    """Words of an anchor, and of the halves of its extension to the left and to the right.

    A window has ``j`` words left of its anchor and ``length - k - j`` right of
    it, so it holds the whole left half or the whole right one.
    """
    k = min(length, max(ANCHOR, length - MOST_BESIDE))
    left = (length - k + 1) // 2
    return k, left, length - k + 1 - left


def _anchors(words: Words, length: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, its place, first window, number of windows, and text of every run."""
    k, _, _ = _sizes(length)
    grams = gram_hashes(words.hash, k)
    at = window_minimum(grams, length - k + 1)
    doc = words.doc
    start = np.arange(len(at))
    whole = doc[start] == doc[start + length - 1]  # windows never leave their text
    start, at, doc = start[whole], at[whole], doc[start[whole]]
    if not len(start):
        none = np.zeros(0, np.int64)
        return grams[:0], none, none, none, none
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    count = np.diff(np.append(first, len(start)))
    return grams[at[first]], at[first], start[first], count, doc[first]


def _runs(words: Words, length: int, wanted: np.ndarray | None, sought: bool) -> tuple[np.ndarray, ...]:
    """Anchor, fingerprint with its side bits, text and packed run; of the frequent cells, or of the others."""
    k, left, right = _sizes(length)
    anchor, at, start, count, doc = _anchors(words, length)
    if wanted is not None:
        mine = wanted[cell(anchor)] == sought
        anchor, at, start, count, doc = anchor[mine], at[mine], start[mine], count[mine], doc[mine]
    offset, other = at - start, words.hashes(1)
    run = span_hashes(other, start, start + count - 1 + length)
    # A run without a window that holds a whole side gets bits of its own words instead.
    sides = [mix(run + U64(1)), mix(run + U64(2))]
    has = offset >= left
    sides[0][has] = span_hashes(other, at[has] - left, at[has])
    has = length - k - offset + count - 1 >= right
    sides[1][has] = span_hashes(other, at[has] + k, at[has] + k + right)
    run = run & ~U64(0xFFFFFFFF) | (sides[0] >> U64(48)) << U64(16) | sides[1] >> U64(48)
    return anchor, run, doc, (start - words.bounds[doc]) << _START | offset << _OFFSET | count


def _occurrences(texts: DataFrame, length: int, frequent: np.ndarray, sought: bool) -> DataFrame:
    """``a, r, id, x, p`` of every run of the frequent cells, or of the others."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)  # a byte for each sketch cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, _, data, offsets in text_slices(batch.column(2)):
                words = split_words(data, offsets)
                if len(words.hash) < length:
                    continue
                a, r, doc, p = _runs(words, length, shared.value, sought)
                columns = [as_long(a), as_long(r), ids[first + doc], versions[first + doc], p]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "r", "id", "x", "p"])

    return texts.mapInArrow(run, "a long, r long, id long, x long, p long")


def _frequent_cells(texts: DataFrame, length: int) -> np.ndarray:
    """Whether each cell may hold an anchor of more occurrences than a window should gather."""

    def anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in text_slices(batch.column(0)):
            words = split_words(data, offsets)
            if len(words.hash) >= length:
                yield _anchors(words, length)[0]

    counts = count_cells(texts.select("text"), anchors)
    return counts > FREQUENT_TIMES * counts.mean() + FREQUENT_PLUS


def _side(shift: int) -> Column:
    return F.shiftrightunsigned("r", shift).bitwiseAND(F.lit(0xFFFF))


def _extended(rare: DataFrame, often: DataFrame) -> DataFrame:
    """``id, x, gone, open``: runs that go whole, and runs whose windows are to be compared.

    ``least`` is the least document of the run's class; ``more_left`` tells
    whether other classes of the anchor agree with the run on the left.
    """
    over = lambda *by: Window.partitionBy("a", *by)
    several = lambda side: F.min("r").over(over(side)) != F.max("r").over(over(side))
    rare = rare.withColumns({"m": F.min("id").over(over()), "n": F.max("id").over(over())}).where("m < n").drop("m", "n")
    rare = rare.withColumns({"sl": _side(16), "sr": _side(0)}).withColumn("least", F.min("id").over(over("r")))
    rare = rare.withColumn("more_left", several("sl")).withColumn("more_right", several("sr"))
    classes = materialize(often.groupBy("a", "r").agg(F.min("id").alias("least"), F.max("id").alias("most")).withColumns({"sl": _side(16), "sr": _side(0)}), "repeat-classes")
    shared = classes.groupBy("a").agg(F.min("least").alias("m"), F.max("most").alias("n")).where("m < n").select("a")
    sides = [classes.groupBy("a", s).agg((F.count("*") > 1).alias(name)) for s, name in (("sl", "more_left"), ("sr", "more_right"))]
    classes = classes.join(shared, "a").join(sides[0], ["a", "sl"]).join(sides[1], ["a", "sr"]).select("a", "r", "least", "more_left", "more_right")
    often = often.join(classes, ["a", "r"])
    both = [rows.select("id", "x", "p", "least", "more_left", "more_right") for rows in (rare, often)]
    found = both[0].union(both[1]).where("id > least or more_left or more_right")
    gone = F.col("id") > F.col("least")
    sides = F.when(F.col("more_left"), F.lit(_LEFT)).otherwise(F.lit(0)) + F.when(F.col("more_right"), F.lit(_RIGHT)).otherwise(F.lit(0))
    return found.groupBy("id", "x").agg(F.collect_list(F.when(gone, F.col("p"))).alias("gone"), F.collect_list(F.when(~gone, F.col("p") + sides)).alias("open"))


def _unpack(runs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run, of the sides that are named if any is."""
    k, left, _ = _sizes(length)
    start, offset, count = runs >> _START & (1 << 36) - 1, runs >> _OFFSET & 63, runs & 63
    on_left, on_right = runs & _LEFT > 0, runs & _RIGHT > 0
    # Windows with ``left`` words or more left of the anchor come first.
    first = np.clip(offset - left + 1, 0, count)
    lo = np.where(on_right & ~on_left, first, 0)
    hi = np.where(on_left & ~on_right, first, count)
    return start + lo, hi - lo


def _expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The rows of a column of lists; null is empty."""
    offsets, values = column.offsets.to_numpy(), np.asarray(column.values)
    return [values[lo:hi] for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _window_hashes(texts: list[bytes], places: list[np.ndarray], length: int) -> list[list[np.ndarray]]:
    """Two hashes of the windows of each text that start at ``places``."""
    out: list[list[np.ndarray]] = [[], []]
    for first, last, data, offsets in text_slices(pa.array(texts, pa.large_binary()).view(pa.large_string())):
        words = split_words(data, offsets)
        size = np.array([len(x) for x in places[first:last]])
        start = np.concatenate(places[first:last]) + np.repeat(words.bounds[:-1], size)
        for column, h in zip(out, (words.hash, words.hashes(1)), strict=True):
            column += np.split(as_long(span_hashes(h, start, start + length)), np.cumsum(size)[:-1])
    return out


def maximal_repeats(n_words: int, starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Longest stretches ``[start, end)`` of words that the runs' windows cover, as rows of two."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts[counts > 0], 1)
    np.add.at(edge, (starts + counts - 1 + length)[counts > 0], -1)
    covered = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
    return np.flatnonzero(np.diff(covered)).reshape(-1, 2)


def _result(text: bytes, starts: np.ndarray, counts: np.ndarray, length: int, with_text: bool) -> tuple[int, int, int, str]:
    """Words, removed words, maximal repeats, and kept text (or its digest) of one text."""
    words = text.split()  # of bytes: at space and 0x09-0x0D
    n, kept = len(words), words
    stretches = maximal_repeats(n, starts, counts, length) if len(starts) else np.zeros((0, 2), np.int64)
    if len(stretches):
        keep = np.ones(n, bool)
        for lo, hi in stretches.tolist():
            keep[lo:hi] = False
        kept = list(compress(words, keep.tolist()))
    joined = b" ".join(kept)
    return n, n - len(kept), len(stretches), joined.decode() if with_text else sha256(joined).hexdigest()


def _columns(results: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] for r in results], t) for i, (_, t) in enumerate(_RESULT)]


def remove_repeats(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, n_repeats`` and ``kept`` (or ``kept_sha256``) for every row.

    A word is removed when a window of ``length`` words that covers it also
    starts in a document of smaller id; ``n_repeats`` counts the maximal
    stretches that go. Windows are judged on the input. Rows of equal ids don't
    remove each other's words; a row without an id neither loses words nor
    takes them. A null text has no words. Kept words are joined by one space.
    An empty table gives an empty result. Only the two named columns are read,
    so other columns' names don't matter.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named, nameless = texts.where("id is not null"), texts.where("id is null")
    # Different texts of one id are told apart by a part of their digest; as a rule there are none.
    twice = named.groupBy("id").count().where("count > 1").select("id")
    if twice.isEmpty():
        named = named.select("id", F.lit(0).cast("long").alias("x"), "text")
    else:
        marked = named.join(twice.withColumn("twice", F.lit(True)), "id", "left")
        digest = F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("long")
        named = materialize(marked.select("id", F.when(F.col("twice"), digest).otherwise(F.lit(0)).alias("x"), "text"), "repeat-texts")
    frequent = _frequent_cells(named, length)
    found = _extended(*(_occurrences(named, length, frequent, sought) for sought in (False, True)))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            zipped = pa.array([write(t.as_py().encode()) for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), zipped], ["id", "x", "z"])

    result = ", ".join(f"{name} {'string' if name == 'kept' else 'long'}" for name, _ in _RESULT)
    names = ["id", "x", "z", "gone", "w1", "w2", "p", *(name for name, _ in _RESULT)]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = [read(z.as_py()) for z in batch.column("z")]
            gone = [_unpack(runs, length) for runs in _lists(batch.column("gone"))]
            results = [_result(t, *g, length, with_text) for t, g in zip(texts, gone, strict=True)]
            places = [_expand(*_unpack(runs, length)) for runs in _lists(batch.column("open"))]
            keep = np.array([len(x) > 0 for x in places], bool)
            at, windows = np.flatnonzero(keep).tolist(), [[None] * batch.num_rows for _ in range(3)]
            hashes = _window_hashes([texts[i] for i in at], [places[i] for i in at], length)
            for i, w1, w2 in zip(at, *hashes, strict=True):
                windows[0][i], windows[1][i], windows[2][i] = w1, w2, places[i] << _START | 1
            z, left = (pa.compute.if_else(pa.array(keep), batch.column(c), pa.scalar(None, batch.column(c).type)) for c in ("z", "gone"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), z.cast(pa.binary()), left.cast(LONGS), *(pa.array(w, LONGS) for w in windows), *_columns(results)], names)

    fields = f"id long, x long, z binary, gone array<long>, w1 array<long>, w2 array<long>, p array<long>, {result}"
    zipped = named.mapInArrow(shrink, "id long, x long, z binary")
    # One pass over the texts settles all; those with windows to compare go on with their text.
    state = materialize(zipped.join(found, ["id", "x"], "left").select("id", "x", "z", "gone", "open").mapInArrow(settle, fields), "repeats")
    windows = state.where("z is not null").select("id", "x", F.explode(F.arrays_zip("w1", "w2", "p")).alias("w")).select("id", "x", "w.*")
    least = windows.groupBy("w1", "w2").agg(F.min("id").alias("m"), F.max("id").alias("n")).where("m < n").select("w1", "w2", "m")
    more = windows.join(least, ["w1", "w2"]).where("id > m").groupBy("id", "x").agg(F.collect_list("p").alias("more"))

    names_out = ["id", *(name for name, _ in _RESULT)]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            settled = list(zip(*(batch.column(name).to_pylist() for name, _ in _RESULT), strict=True))
            gone = _lists(batch.column("gone"))
            for i, more in enumerate(_lists(batch.column("more"))):
                if len(more):
                    runs = np.concatenate([gone[i], more])
                    settled[i] = _result(read(batch.column("z")[i].as_py()), *_unpack(runs, length), length, with_text)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *_columns(settled)], names_out)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            results = [_result(t.as_py().encode(), none, none, length, with_text) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(results)], names_out)

    waiting = state.where("z is not null").select("id", "x", "z", "gone", *names_out[1:]).join(more, ["id", "x"], "left")
    out = state.where("z is null").select(*names_out).union(waiting.mapInArrow(finish, f"id long, {result}")).union(nameless.mapInArrow(alone, f"id long, {result}"))
    return out.select(F.col("id").alias("doc_id"), *names_out[1:-1], F.col("kept").alias("kept" if with_text else "kept_sha256"))
