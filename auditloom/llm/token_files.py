"""Token-id files: every document compressed alone against one shared dictionary.

A container holds a run of documents in ascending id order:

    "ALTK1" | id width (1 byte) | SHA-256 of the dictionary (32 bytes)
    | number of documents (u32) | doc ids (i64 each) | offsets (u64, one more)
    | one zstandard frame a document

Integers are little-endian. The offset index and the dictionary give any short
document without touching its neighbours. Containers are rows of a Parquet
table in the shared folder, so any file system Spark writes to will do, and
tasks that are run again write whole containers or nothing.
"""

from __future__ import annotations

import math
import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_alphabet
from .common import least_hashed, temporary_path
from .pretokens import ChunkEncoder, packed, read_spec

MAGIC = b"ALTK1"
#: Bytes of packed ids after which a container is closed.
CONTAINER_BYTES = 1 << 18
#: Bytes of text in a range of ids, on average, once there are more ranges than shuffle partitions.
RANGE_BYTES = 64 << 20
#: Stands for a null id in a container.
NULL_ID = -(1 << 63)
#: Documents that the dictionary is trained on (those with the least hashes), and its size.
SAMPLE_DOCS, DICT_BYTES = 400, 64 << 10
#: A sampled text of more characters than PIECES * PIECE_CHARS gives so many pieces at hashed positions, a shorter one all of it.
PIECES, PIECE_CHARS = 8, 2000
#: Words that the tokenizers library gets in one call, and in one string of it.
WORDS_AT_ONCE, LINE = 10_000, 100
#: Bytes of text that are cut and looked up together, unless one text has more.
GROUP_BYTES = 8 << 20
TABLE = "part int, before long, n_docs long, n_tokens long, data binary"

_encoders: dict[str, ChunkEncoder] = {}


def library_encoder(path: str) -> ChunkEncoder:
    """The tokenizers library behind the chunk cache; one for each worker and path."""
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        spec = read_spec(path)
        model = Tokenizer.from_file(path)
        special = {t.content: i for i, t in model.get_added_tokens_decoder().items()}
        alphabet = byte_alphabet()  # the library's model takes pre-tokens in its byte alphabet
        core, space = model.model.tokenize, alphabet[32]

        def encode(piece: str) -> bytes:
            if piece[0] == " " and piece.isascii() and piece[1:].isalnum():
                return packed([t.id for t in core(space + piece[1:])])
            return packed([t.id for t in core(piece.encode().decode("latin-1").translate(alphabet))])

        # No merge knows the character of byte 255, which no UTF-8 holds, so words may stand in one string with it between them.
        bare, end = Tokenizer(model.model), model.model.token_to_id(alphabet[255])
        apart = end is not None and not any(alphabet[255] in x for pair in spec["model"]["merges"] for x in pair)
        between = alphabet | {0: alphabet[255]}

        def encode_words(words: list[str]) -> list[bytes]:
            if not apart:
                return [encode(" " + w) for w in words]
            out = []
            for i in range(0, len(words), WORDS_AT_ONCE):
                found = words[i : i + WORDS_AT_ONCE]
                strings = ["".join([f" {w}\0" for w in found[k : k + LINE]]) for k in range(0, len(found), LINE)]
                coded = bare.encode_batch_fast([s.encode().decode("latin-1").translate(between) for s in strings], add_special_tokens=False)
                ids = np.concatenate([np.array(c.ids, "<u4") for c in coded])
                ends, data = (4 * np.flatnonzero(ids == end)).tolist(), ids.tobytes()
                out += [data[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends, strict=False)]
            return out

        _encoders[path] = ChunkEncoder(encode, special, encode_words=encode_words)
    return _encoders[path]


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary from serialized id arrays; a raw-content one when they are too few to train on."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def pack(docs: list[tuple[int, np.ndarray]], dictionary: bytes, width: int, compressor: zstandard.ZstdCompressor) -> bytes:
    """One container."""
    frames = [compressor.compress(ids.astype(f"<u{width}").tobytes()) for _, ids in docs]
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8")
    head = MAGIC + bytes([width]) + sha256(dictionary).digest() + struct.pack("<I", len(docs))
    return head + np.array([d for d, _ in docs], "<i8").tobytes() + offsets.tobytes() + b"".join(frames)


@dataclass
class Container:
    """A container opened for reading; ``self[i]`` reads one document only."""

    data: bytes
    dictionary: bytes

    def __post_init__(self):
        if self.data[:5] != MAGIC or self.data[6:38] != sha256(self.dictionary).digest():
            raise ValueError("not a token container, or another dictionary's")
        self.width = self.data[5]
        (n,) = struct.unpack_from("<I", self.data, 38)
        self.doc_ids = np.frombuffer(self.data, "<i8", n, 42)
        self.offsets = np.frombuffer(self.data, "<u8", n + 1, 42 + 8 * n)
        self._body = 42 + 8 * n + 8 * (n + 1)
        d = _dictionary(self.dictionary)
        self._reader = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, i: int) -> np.ndarray:
        lo, hi = self._body + int(self.offsets[i]), self._body + int(self.offsets[i + 1])
        return np.frombuffer(self._reader.decompress(self.data[lo:hi]), f"<u{self.width}").astype("<u4")


def sample_pieces(rows: DataFrame) -> DataFrame:
    """``doc_id, text``: what the dictionary is trained on, from everywhere in the sampled texts.

    At most SAMPLE_DOCS * PIECES * PIECE_CHARS characters. Each of PIECES equal
    stretches of a long text gives one piece, at a place that its id hashes to.
    """
    n = F.length("text").cast("long")

    def piece(i: Column) -> Column:
        begin, end = F.floor(i * n / PIECES), F.floor((i + 1) * n / PIECES)
        shift = F.pmod(F.xxhash64("doc_id", i), F.greatest(end - begin - PIECE_CHARS + 1, F.lit(1)))
        return F.substr("text", (begin + shift + 1).cast("int"), F.lit(PIECE_CHARS))

    long = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), piece)
    pieces = F.when(n > PIECES * PIECE_CHARS, long).otherwise(F.array("text"))
    return least_hashed(rows.select("doc_id", pieces.alias("pieces")), "doc_id", SAMPLE_DOCS).select("doc_id", F.explode("pieces").alias("text"))


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in groups of up to ``most`` bytes of the strings in ``column``; a longer string is alone."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, base = 0, 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, base + most - size, "right"))
            if not held:
                upto = max(upto, at + 1)
            if upto > at:
                held.append(batch.slice(at, upto - at))
                size += int(ends[upto - 1]) - base
                at, base = upto, int(ends[upto - 1])
            if at < batch.num_rows:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def write_token_files(docs: DataFrame, path: str, where: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """Tokenize ``docs`` into containers under ``where``; returns the dictionary, also kept there.

    Documents lie in ascending id order (null ids first), ``end_id`` closes
    each. Null texts count as empty. Rows with equal ids stand side by side,
    ordered by a hash of the text and the text, and may lie in several ranges.
    A range holds about ``RANGE_BYTES`` of text, whatever the corpus. An empty
    table leaves an empty table of containers. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The dictionary only shapes the compression, so pieces of the sampled texts will do.
    encode, width = library_encoder(path), 2 if _largest_id(path) < 1 << 16 else 4
    serialized = [np.frombuffer(encode(r["text"]), "<u4").astype(f"<u{width}").tobytes() for r in sample_pieces(rows).collect()]  # SAMPLE_DOCS * PIECES rows at most
    dictionary = train_dictionary(serialized)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, d = library_encoder(path), _dictionary(dictionary)
        compressor = zstandard.ZstdCompressor(level=3, dict_data=d) if d else zstandard.ZstdCompressor(level=3)
        end = np.array([end_id], "<u4")
        held, size, part, before = [], 0, 0, 0

        def close() -> pa.RecordBatch:
            data = pack([(NULL_ID if d is None else d, x) for d, x in held], dictionary, width, compressor)
            row = (part, before, len(held), sum(len(x) for _, x in held), data)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _ARROW, strict=True)], [*_NAMES])

        for group in by_bytes(batches, "text", GROUP_BYTES):
            parts, ids = group.column("part").to_pylist(), group.column("doc_id").to_pylist()
            for doc_id, coded in zip(ids, encoder.many(group.column("text")), strict=True):
                part = parts[0]
                tokens = np.concatenate([np.frombuffer(coded, "<u4"), end])
                held.append((doc_id, tokens))
                size += 4 * len(tokens)
                if size >= CONTAINER_BYTES:
                    yield close()
                    before += size // 4
                    held, size = [], 0
        if held:
            yield close()

    bytes_ = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(bytes_ / RANGE_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc()]
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order, "text").select(F.spark_partition_id().alias("part"), "doc_id", "text")
    ordered.mapInArrow(run, TABLE).write.parquet(f"{where}/containers")
    spark.range(1).select(F.lit(bytearray(dictionary)).alias("dictionary")).write.parquet(f"{where}/dictionary")
    return dictionary


_NAMES = ("part", "before", "n_docs", "n_tokens", "data")
_ARROW = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())


def _largest_id(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) - 1


def read_token_files(spark: SparkSession, where: str, fields: str = "doc_id long, start long, ids array<int>", row: Callable | None = None) -> DataFrame:
    """Every document of the files under ``where``; ``start`` counts the ids of all documents before it.

    ``row(doc_id, start, ids)`` makes the ``fields`` of a document, so digests
    need not ship the ids. The driver gathers one sum for each written
    partition, nothing for containers or documents.
    """
    table = spark.read.schema(TABLE).parquet(f"{where}/containers")
    dictionary = bytes(spark.read.parquet(f"{where}/dictionary").first()["dictionary"])
    starts, total = {}, 0
    for r in table.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        starts[r["part"]] = total
        total += r["n"]
    make = row or (lambda doc_id, start, ids: (doc_id, start, ids.astype(np.int32)))
    names = [f.name for f in T._parse_datatype_string(fields).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                box = Container(batch.column(2)[i].as_py(), dictionary)
                start, rows = starts[batch.column(0)[i].as_py()] + batch.column(1)[i].as_py(), []
                for k in range(len(box)):
                    ids, doc_id = box[k], int(box.doc_ids[k])
                    rows.append(make(None if doc_id == NULL_ID else doc_id, start, ids))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)

    return table.select("part", "before", "data").mapInArrow(run, fields)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Write ``docs`` to token files, read them back, and digest each document's ids.

    A null text counts as empty, and a null id comes first; repeated rows keep a
    place each.
    """
    spark = docs.sparkSession
    where = temporary_path(spark, "tokens")
    write_token_files(docs, path, where)
    row = lambda doc_id, start, ids: (doc_id, start, len(ids), crc32(ids.astype("<u4").tobytes()))
    return read_token_files(spark, where, "doc_id long, start long, n_tokens long, ids_crc32 long", row)
