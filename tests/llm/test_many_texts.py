"""Texts encoded together: each distinct word once, ids as the tokenizers library gives them."""

import json

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from auditloom.llm import bpe, token_files
from auditloom.llm.pretokens import LONGEST, ChunkEncoder, packed

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = ["a", "B", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "　", "​", "é", "ñandú", "漢", "ª", "½", "٣", "1", "'s", "'LL", "'", "!?", "***", "...", "😀", "<|endoftext|>", " the", " word.", ".\nIs", "\0", "ÿ", "x" * 40]


def want(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join) | st.text(max_size=30), max_size=5))
def test_many_texts_are_the_librarys(texts):
    got = token_files.library_encoder(PATH).many(pa.array(texts, pa.string()))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [want(t) for t in texts]


def test_distinct_words_are_encoded_once_whatever_the_tables_hold():
    own, made = bpe.load(PATH), []

    def encode(piece):
        made.append(piece)
        return packed(own.merge(piece.encode()))

    texts = [" ".join(f"start {w}, {w}" for w in ("alder", "birch", "cedar", "elder", "fir", "hazel", "y" * (LONGEST + 1))) + "." for _ in range(20)]
    tiny = ChunkEncoder(encode, own.special, chunks=3, pieces=4, words=6)
    assert [np.frombuffer(x, "<u4").tolist() for x in tiny.many(pa.array(texts))] == [want(t) for t in texts]
    words = [x for x in made if x[1:].isalpha() and x[0] == " " and len(x) <= LONGEST]
    assert sorted(words) == sorted(f" {w}" for w in ("start", "alder", "birch", "cedar", "elder", "fir", "hazel"))
    assert len(made) < 20
    before = len(made)
    for text in ("alder oak", "oak ash elm yew", "alder birch, oak.\nAsh", "ash elm yew larch pine alder"):
        assert [np.frombuffer(x, "<u4").tolist() for x in tiny.many(pa.array([text]))] == [want(text)]
    assert len(made) > before and len(tiny._word) + len(tiny._word._older) <= 6 + 7


def test_a_merge_with_the_dividing_character_is_respected(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    dividing, space = bpe.byte_alphabet()[255], bpe.byte_alphabet()[32]
    spec["model"]["vocab"][dividing + space] = len(spec["model"]["vocab"]) + len(spec["added_tokens"])
    pair = spec["model"]["merges"][0]
    spec["model"]["merges"].append([dividing, space] if isinstance(pair, list) else f"{dividing} {space}")
    path = str(tmp_path / "odd.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    text = "one two three, four"
    (got,) = token_files.library_encoder(path).many(pa.array([text]))
    assert np.frombuffer(got, "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("most", [1, 5, 9, 1000])
def test_groups_keep_rows_and_order(most):
    texts = ["abc", "", "défg", "x" * 30, "", "hi", "", "last"]
    table = pa.table({"n": range(8), "text": texts})
    groups = list(token_files.by_bytes(iter(table.to_batches(max_chunksize=3)), "text", most))
    assert [x for g in groups for x in g.column("text").to_pylist()] == texts
    sizes = [[len(x.encode()) for x in g.column("text").to_pylist()] for g in groups]
    assert all(sum(s) <= most or sum(1 for x in s if x) == 1 for s in sizes)
    assert most < 1000 or len(groups) == 1
