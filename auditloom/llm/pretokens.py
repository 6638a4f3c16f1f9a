"""Cutting texts into cacheable chunks without changing how they tokenize.

A byte-level pre-tokenizer looks at most one white-space run ahead, so a text
may be cut before a space that has a non-white neighbour. Chunks and, below
them, pre-tokens repeat across a corpus; both are cached, in tables of bounded
bytes. Many texts at once are cut by Arrow, which also finds the distinct chunks,
so that Python sees each of them once.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The byte-level pre-tokenizer's pattern, white space spelled out as the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_PIECES = regex.compile(PATTERN)
_UNSAFE = re.compile(r"\s (?:\s|\Z)")

#: Below this character, which are letters has long been settled, so any two libraries agree.
_OLD = "\u0500"

#: Entries of the two tables, and characters of a key from which on nothing is kept: with ids, 1 KB an entry at most.
CHUNKS, PIECES, LONGEST = 800_000, 400_000, 32
#: Entries of the table of words for many texts at once, which needs no table of chunks beside it.
WORDS = 800_000
#: Neither letters, numbers nor white space: a run of them behind a word is one pre-token. Apostrophes may begin a contraction.
_SIGNS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")


def read_spec(path: str) -> dict:
    """The tokenizer file at ``path``; ``ValueError`` if it isn't plain byte-level BPE, which is all that is cut here."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    byte_level = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and (spec.get("decoder") or {}).get("type") == "ByteLevel"
    added = not any(t.get(x) for t in spec.get("added_tokens", []) for x in ("single_word", "lstrip", "rstrip", "normalized"))
    if not (plain and byte_level and added) or spec.get("normalizer"):
        raise ValueError(f"{path}: only byte-level BPE without a normalizer, a prefix space or stripping added tokens")
    return spec


class Known(dict):
    """Values of keys seen lately; others are made on the spot. Starts afresh when full; long keys are never kept."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self._make, self._most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self._make(key)
        if len(key) <= LONGEST:
            if len(self) >= self._most:
                self.clear()
            self[key] = value
        return value


class Recent(dict):
    """Values of keys seen lately, for many keys at a time; when it is full, the half asked for last stays."""

    def __init__(self, make_all: Callable[[list[str]], list[bytes]], most: int):
        super().__init__()
        self._make_all, self._half, self._older = make_all, max(1, most // 2), {}

    def all(self, keys: list[str]) -> list[bytes]:
        """The values of different ``keys``, made at once as far as they lack. One call's keys stay together, however many they are."""
        values = list(map(self.get, keys))
        lacking = [i for i, v in enumerate(values) if v is None]
        if self and len(self) + len(lacking) > self._half:
            older, self._older = self._older, dict(self)
            self.clear()
        else:
            older = self._older
        new = []
        for i in lacking:
            if (value := older.get(keys[i])) is None:
                new.append(i)
            else:
                values[i] = self[keys[i]] = value
        for i, value in zip(new, self._make_all([keys[i] for i in new]), strict=True):
            values[i] = value
            if len(keys[i]) <= LONGEST:
                self[keys[i]] = value
        return values


def packed(ids: Sequence[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class ChunkEncoder:
    """Encodes whole texts; ``encode_piece`` does the work for a pre-token not seen lately.

    Results are ids packed as little-endian unsigned 32-bit integers. Memory is
    bounded whatever the corpus. ``encode_words`` does the same for many words of
    letters at once, each taken with a space before it.
    """

    def __init__(self, encode_piece: Callable[[str], bytes], special: dict[str, int], chunks: int = CHUNKS, pieces: int = PIECES, words: int = WORDS, encode_words: Callable | None = None):
        self._special = special
        longest_first = sorted(special, key=len, reverse=True)
        self._split = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if special else None
        self._piece = Known(encode_piece, pieces)
        self._after = Known(self._chunk, chunks)
        self._word = Recent(encode_words or (lambda found: [encode_piece(" " + w) for w in found]), words)

    def __call__(self, text: str) -> bytes:
        if self._split is None or not any(s in text for s in self._special):
            return self._segment(text)
        return b"".join(self._special[x].to_bytes(4, "little") if x in self._special else self._segment(x) for x in self._split.split(text))

    def _segment(self, text: str) -> bytes:
        if not text:
            return b""
        if _UNSAFE.search(text):
            return self._by_piece(text)
        head, *rest = text.split(" ")
        return self._by_piece(head) + b"".join(map(self._after.__getitem__, rest))

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha() and (chunk.isascii() or max(chunk) < _OLD):  # one pre-token
            return self._piece[" " + chunk]
        return self._by_piece(" " + chunk)

    def _by_piece(self, text: str) -> bytes:
        return b"".join(map(self._piece.__getitem__, _PIECES.findall(text)))

    def many(self, texts: pa.Array) -> Iterator[bytes]:
        """What a call gives for each of ``texts``, an array of strings without nulls; a distinct chunk is encoded once.

        Memory goes with the bytes of ``texts``.
        """
        cut = pc.split_pattern(texts, " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = cut.flatten().dictionary_encode()
        chunks, at = coded.dictionary, coded.indices.to_numpy().copy()
        heads = strings(chunks.take(pa.array(at[bounds[:-1]])))
        whole = self._uncut(texts, chunks, at, bounds)
        at[np.repeat(whole, np.diff(bounds))] = none = len(chunks)
        at[bounds[:-1]] = none  # no space before them
        place = np.zeros(none + 1, np.int64)
        place[at] = 1
        used = np.flatnonzero(place[:none])
        place[:] = len(used)
        place[used] = np.arange(len(used))
        taken = self._spaced(chunks.take(pa.array(used))).take(pa.array(place[at]))
        _, offsets, data = taken.buffers()
        ends = np.frombuffer(offsets, np.int64, len(at) + 1)[bounds].tolist()
        body = memoryview(data) if data else b""
        for i, (head, alone) in enumerate(zip(heads, whole.tolist(), strict=True)):
            if alone:
                yield self(texts[i].as_py())
            else:
                yield self._by_piece(head) + body[ends[i] : ends[i + 1]]

    def _uncut(self, texts: pa.Array, chunks: pa.Array, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which texts hold a special token, or a space that ``_UNSAFE`` finds between the chunks numbered ``at``."""
        whole = np.zeros(len(texts), bool)
        for s in self._special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        offsets, data = _parts(chunks)
        opens, closes = np.zeros((2, len(chunks)), bool)
        some = np.flatnonzero(np.diff(offsets) > 0)
        opens[:] = closes[:] = np.diff(offsets) == 0
        for edge, end, where in ((opens, 0, data[offsets[some]]), (closes, -1, data[offsets[some + 1] - 1])):
            maybe = some[(where <= 0x20) | (where >= 0x80)]
            edge[maybe] = [c[end].isspace() for c in strings(chunks.take(pa.array(maybe)))]
        unsafe = closes[at[:-1]] & opens[at[1:]]
        found = np.searchsorted(bounds, np.flatnonzero(unsafe), "right") - 1
        inside = np.flatnonzero(unsafe) + 1 < bounds[found + 1]  # both chunks are the same text's
        whole[found[inside]] = True
        return whole

    def _spaced(self, chunks: pa.Array) -> pa.Array:
        """Ids of different chunks behind a space and, last, of none; by their words as far as they show without a pattern."""
        n, piece = len(chunks), self._piece
        more, second, third = [b""], np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)  # what follows a chunk's word, as places in ``more``
        broken = np.flatnonzero(pc.match_substring(chunks, "\n").to_numpy(zero_copy_only=False))
        if len(broken):
            lines, mask = [], np.zeros(n, bool)
            for i, c in zip(broken.tolist(), strings(chunks.take(pa.array(broken))), strict=True):
                line, feed, rest = c.partition("\n")
                if line and rest and not line[-1].isspace() and not rest[0].isspace():  # the line feed is a pre-token
                    lines.append(line)
                    mask[i], third[i] = True, len(more)
                    more.append(piece[feed] + (piece[rest] if _is_word(rest) else self._by_piece(rest)))
            chunks = pc.replace_with_mask(chunks, pa.array(mask), pa.array(lines, chunks.type))
        stems = pc.ascii_rtrim(chunks, _SIGNS)
        plain = _are_words(stems)
        coded = stems.filter(pa.array(plain)).dictionary_encode()
        words = self._word.all(strings(coded.dictionary))
        first = np.full(n + 1, len(words))
        first[:n][plain] = coded.indices.to_numpy()
        sizes = pc.binary_length(stems).to_numpy()
        tailed = np.flatnonzero(plain & (pc.binary_length(chunks).to_numpy() > sizes))
        seen: dict[str, int] = {}
        for i, c, k in zip(tailed.tolist(), strings(chunks.take(pa.array(tailed))), pc.utf8_length(stems.take(pa.array(tailed))).to_pylist(), strict=True):
            if (at := seen.get(tail := c[k:])) is None:
                at = seen[tail] = len(more)
                more.append(piece[tail])
            second[i] = at
        other = np.flatnonzero(~plain)
        second[other] = np.arange(len(more), len(more) + len(other))
        more += [self._by_piece(" " + c) for c in strings(chunks.take(pa.array(other)))]
        word, rest = pa.array([*words, b""], pa.large_binary()), pa.array(more, pa.large_binary())
        return pc.binary_join_element_wise(word.take(pa.array(first)), rest.take(pa.array(second)), rest.take(pa.array(third)), pa.scalar(b"", pa.large_binary()))


def strings(array: pa.Array) -> list[str]:
    """What ``to_pylist`` gives, much faster."""
    return array.to_numpy(zero_copy_only=False).tolist()


def _parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of strings."""
    array = array.cast(pa.large_binary())
    _, offsets, data = array.buffers()
    return np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1], np.frombuffer(data or b"", np.uint8)


def _is_word(text: str) -> bool:
    """Letters only, and those old ones: one pre-token, with or without a space before it."""
    return text.isalpha() and (text.isascii() or max(text) < _OLD)


def _are_words(array: pa.Array) -> np.ndarray:
    """``_is_word`` of strings; the first byte of newer letters is beyond those of the old."""
    plain = pc.utf8_is_alpha(array).to_numpy(zero_copy_only=False).copy()
    offsets, data = _parts(array)
    newer = np.flatnonzero(data >= _OLD.encode()[0])
    plain[np.searchsorted(offsets, newer[(newer >= offsets[0]) & (newer < offsets[-1])], "right") - 1] = False
    return plain
