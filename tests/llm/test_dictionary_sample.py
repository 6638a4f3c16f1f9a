"""What op5's dictionary is trained on comes from everywhere in long texts."""

import numpy as np
import public_tokenizers
import pytest

from auditloom.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
LATE = "the harbour lantern keeps an amber promise beneath seventeen frozen bridges "


@pytest.fixture(scope="module")
def long_docs(spark):
    """Texts whose wording changes for good after 20,000 characters, and a short one."""
    rng = np.random.default_rng(2)
    head = ["".join(rng.choice(list("abcdefgh "), 20_000)) for _ in range(40)]
    return spark.createDataFrame([(i, h + LATE * 300) for i, h in enumerate(head)] + [(99, "short"), (100, None)], "doc_id long, text string")


def test_late_wording_reaches_the_dictionary(spark, tmp_path, long_docs):
    dictionary = token_files.write_token_files(long_docs, PATH, f"file://{tmp_path}/files")
    ids = np.frombuffer(token_files.library_encoder(PATH)(LATE * 2), "<u4").astype("<u2")
    assert ids[2:12].tobytes() in dictionary
    back = {r["doc_id"]: len(r["ids"]) for r in token_files.read_token_files(spark, f"file://{tmp_path}/files").collect()}
    assert len(back) == 42 and back[100] == 1


def test_pieces_lie_in_every_eighth_and_are_bounded(long_docs):
    texts = {r["doc_id"]: r["text"] or "" for r in long_docs.collect()}
    rows = long_docs.fillna("")
    pieces = [tuple(r) for r in token_files.sample_pieces(rows).collect()]
    assert pieces == [tuple(r) for r in token_files.sample_pieces(rows).collect()]
    assert sum(len(t) for _, t in pieces) <= token_files.SAMPLE_DOCS * token_files.PIECES * token_files.PIECE_CHARS
    for doc, text in texts.items():
        mine = [t for d, t in pieces if d == doc]
        if doc in (99, 100):
            assert mine == [text]
            continue
        assert len(mine) == 8 and all(len(t) == 2000 for t in mine)
        n = len(text)
        assert all(t in text[i * n // 8 : (i + 1) * n // 8] for i, t in enumerate(mine))
