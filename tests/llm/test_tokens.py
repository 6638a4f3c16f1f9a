"""BPE and token files against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from auditloom.llm import bpe, token_files
from auditloom.llm.common import temporary_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = ["a", "B", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "　", "​", "é", "漢", "½", "٣", "1", "'s", "'LL", "!?", "😀", "<|endoftext|>", " the", "\0"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join) | st.text(max_size=30))
def test_ids_are_the_librarys(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    own = bpe.load(PATH)
    assert own.encode(text).tolist() == want
    assert np.frombuffer(token_files.library_encoder(PATH)(text), "<u4").tolist() == want
    assert own.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


def test_small_tables_forget_nothing():
    from auditloom.llm.pretokens import ChunkEncoder, packed

    own = bpe.load(PATH)
    tiny = ChunkEncoder(lambda piece: packed(own.merge(piece.encode())), own.special, chunks=3, pieces=2)
    for text in ("one two three four one two", "two five six one, two", "one two three seven"):
        assert np.frombuffer(tiny(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_digests(docs, texts, nothing):
    got = sorted(tuple(r) for r in bpe.digests(docs.where("doc_id is not null"), PATH).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((i, len(ids_of(t)), sha(",".join(map(str, ids_of(t)))), sha(t or "")) for i, t in texts if i is not None)
    assert got == want and bpe.digests(nothing, PATH).count() == 0


def test_encode_decode_replaces_clashing_columns(docs):
    out = bpe.encode_decode(docs.withColumnRenamed("lang", "ids"), PATH)
    assert out.columns == ["doc_id", "text", "source", "n_chars", "ids", "decoded"]
    assert out.where("coalesce(text, '') <> decoded").count() == 0


def test_files_round_trip(spark, docs, texts, nothing):
    got = [tuple(r) for r in token_files.digests(docs, PATH).collect()]
    assert len(got) == len(texts)
    rows = sorted(got, key=lambda r: r[1])
    assert [r[0] for r in rows] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i or 0))
    start = 0
    pool = {}
    for i, t in texts:
        pool.setdefault(i, []).append(np.array([*ids_of(t), 0], "<u4"))
    for doc_id, at, n, crc in rows:
        assert at == start
        start += n
        assert (n, crc) in {(len(x), zlib.crc32(x.tobytes())) for x in pool[doc_id]}
    assert token_files.digests(nothing, PATH).count() == 0
    where = temporary_path(spark, "tokens-test")
    token_files.write_token_files(docs, PATH, where)
    back = token_files.read_token_files(spark, where).where("doc_id = 127").first()
    assert back["ids"] == [*ids_of(dict(texts)[127]), 0]


def test_container_checks_its_dictionary():
    import zstandard

    data = token_files.pack([(7, np.arange(5))], b"", 2, zstandard.ZstdCompressor())
    assert token_files.Container(data, b"")[0].tolist() == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        token_files.Container(data, b"other")
