"""Vectorised word splitting and hashing of Arrow text columns.

Words are maximal runs of bytes other than space and 0x09-0x0D; these are ASCII,
so splitting UTF-8 bytes and splitting code points agree. Word and n-gram
hashes are 64-bit; every hash is a pure function of the words, never of the
document or the batch. Another seed gives another, independent hash, so two of
them make 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Bytes of text that are handled together; a longer text is handled alone.
SLICE_BYTES = 2 << 20
#: Bytes up to which words are hashed side by side, eight bytes at a time; longer ones go one by one.
LONG_WORD = 64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Keeps the first n of eight little-endian bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
_P, _Q = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of ``x`` (a bijection of 64-bit values)."""
    x = x ^ (x >> U64(32))
    x = x * _Q
    x = x ^ (x >> U64(32))
    x = x * _Q
    return x ^ (x >> U64(32))


def fold(state: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One step of a hash chain: a bijection of either argument, linear in neither."""
    out = (state ^ x) * _P
    out ^= out >> U64(29)
    out *= _Q
    return out ^ (out >> U64(32))


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, bytes, offsets)`` for runs of rows of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1
        last = min(n, max(last, first + 1))
        lo, hi = int(offsets[first]), int(offsets[last])
        yield first, last, data[lo:hi], offsets[first : last + 1] - lo
        first = last


@dataclass
class Words:
    """Words of several texts: byte spans, hashes, and where each text's words start."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray  # of len(texts) + 1

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def hashes(self, seed: int) -> np.ndarray:
        """Another hash of each word."""
        return word_hashes(self.data, self.start, self.end, seed)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span, chained over its bytes eight at a time."""
    size = end - start
    salt = (int(_P) * (2 * seed + 1)) & ((1 << 64) - 1)
    out = mix(size.astype(U64) + U64(salt))
    if not len(size):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    short = size <= LONG_WORD
    at = np.arange(len(size)) if short.all() else np.flatnonzero(short)
    for lane in range(0, int(size[at].max(initial=0)), 8):
        if lane:
            at = at[size[at] > lane]
        left = np.minimum(size[at] - lane, 8)
        out[at] = fold(out[at], eight[start[at] + lane] & _FIRST[left])
    out = mix(out)
    for i in np.flatnonzero(~short).tolist():
        out[i] = xxhash.xxh3_64_intdigest(padded[start[i] : end[i]], salt)
    return out


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``."""
    if lower:
        data = _LOWER[data]
    gap = _SPACE[data]
    word = ~gap
    begins = word.copy()
    begins[1:] &= gap[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    begins[inner] = word[inner]  # a text's first byte never continues the text before
    ends = word.copy()
    ends[:-1] &= gap[1:]
    last = inner[inner > 0] - 1
    ends[last] = word[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, word_hashes(data, start, end), np.searchsorted(start, offsets))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words; the last ``n - 1`` places hold none."""
    if len(h) < n:
        return np.zeros(0, U64)
    size = len(h) - n + 1
    out = np.full(size, n, U64)
    for i in range(n):
        out = fold(out, h[i : size + i])
    return mix(out)


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words of each span; spans are short."""
    size = end - start
    out = size.astype(U64)
    at = np.arange(len(size))
    for i in range(int(size.max(initial=0))):
        at = at[size[at] > i]
        out[at] = fold(out[at], h[start[at] + i])
    return mix(out)


def window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost least value of each window of ``w`` values."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, width = x, np.arange(len(x)), 1
    while width < w:  # doubling: a window is two shorter ones that may overlap
        step = min(width, w - width)
        left, right = best[: len(best) - step], best[step:]
        take = right < left
        best = np.where(take, right, left)
        at = np.where(take, at[step:], at[: len(at) - step])
        width += step
    return at


def as_long(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as signed values, for Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)
