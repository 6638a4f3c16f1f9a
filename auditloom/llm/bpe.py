"""Byte-level BPE encoding and decoding from a vocabulary file.

Encoding keeps a priority queue of merge ranks over a doubly linked list of
symbols: the least rank (leftmost on ties) is merged first, its neighbours'
new pairs are queued, and entries whose symbols have changed since are skipped.
Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pretokens import ChunkEncoder, packed, read_spec


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class BytePairTokenizer:
    """Reads a tokenizer file of byte-level BPE kind; its path is the only parameter."""

    def __init__(self, path: str):
        spec = read_spec(path)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        self.byte_id = [vocab[alphabet[b]] for b in range(256)]
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in s)
        for s, i in self.special.items():
            self.strings[i] = s.encode()
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self._encoder = ChunkEncoder(lambda piece: packed(self.merge(piece.encode())), self.special)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        find = self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            pair = ids[i] << 32 | ids[i + 1]
            if (found := find(pair)) is not None:
                queue.append((found[0], i, pair, found[1]))
        heapify(queue)
        while queue:
            _, i, pair, merged = heappop(queue)
            j = after[i]
            if j >= n or ids[i] << 32 | ids[j] != pair:
                continue  # stale: one of its symbols was merged meanwhile
            ids[i], ids[j] = merged, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                pair = merged << 32 | ids[k]
                if (found := find(pair)) is not None:
                    heappush(queue, (found[0], i, pair, found[1]))
            h = before[i]
            if h >= 0:
                pair = ids[h] << 32 | merged
                if (found := find(pair)) is not None:
                    heappush(queue, (found[0], h, pair, found[1]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; special tokens' strings become their ids."""
        return np.frombuffer(self._encoder(text), "<u4")

    def decode(self, ids) -> str:
        """Concatenated vocabulary strings as text, special tokens included."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> BytePairTokenizer:
    """One tokenizer for each Python worker and path."""
    return BytePairTokenizer(path)


def encode_decode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids array<int>`` and ``decoded string`` added in place of the text.

    Null texts count as empty; an empty text has no ids. Columns named ``ids``
    or ``decoded`` are replaced. Every row is handled by itself, so repeated
    rows, null ids and ties need no rule.
    """
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(kept.index(text_col)).to_pylist()]
            ids = [model.encode(t) for t in texts]
            decoded = [model.decode(x.tolist()) for x in ids]
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], [*kept, "ids", "decoded"])

    return docs.select(*kept).mapInArrow(run, f"{fields}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` without shipping the ids to the JVM.

    A null text counts as empty, with no ids. Every row is handled by itself,
    null ids and repeated rows included; other columns are not read.
    """
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        decimal = [str(i) for i in range(len(model.strings))]
        for batch in batches:
            n, coded, decoded = [], [], []
            for text in batch.column(1):
                ids = model.encode(text.as_py() or "").tolist()
                n.append(len(ids))
                coded.append(sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(sha256(model.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
