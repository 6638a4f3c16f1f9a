"""Word hashes: words made to collide under polynomial hashes stay apart, and no batch changes one."""

import numpy as np
import pyarrow as pa

from auditloom.llm import jaccard, substrings, textkit


def thue_morse(n, swap=False):
    return "".join("ba"[(bin(i).count("1") + swap) % 2] for i in range(n))


LONG, OTHER = thue_morse(4096), thue_morse(4096, True)


def test_long_words_differ():
    words = [thue_morse(n, s) for n in (1, 7, 8, 9, 63, 64, 65, 1024, 2048, 4096) for s in (False, True)] + ["a\0", "a\0\0"]
    for _, _, data, offsets in textkit.text_slices(pa.array(words)):
        split = textkit.split_words(data, offsets)
        for seed in (0, 1, 2):
            assert len(np.unique(split.hashes(seed))) == len(words)


def test_hashes_do_not_depend_on_neighbours():
    texts = ["alpha beta gamma-delta-epsilon", "", "x " + "y" * 100, "beta"]
    one = [h for t in texts for _, _, d, o in textkit.text_slices(pa.array([t])) for h in textkit.split_words(d, o).hash]
    (_, _, data, offsets), *_ = textkit.text_slices(pa.array(texts))
    assert textkit.split_words(data, offsets).hash.tolist() == one


def test_repeats_and_links_of_long_words(spark):
    tail = " ".join(f"t{i}" for i in range(12))
    rows = [(1, f"{LONG} {tail}"), (2, f"{OTHER} {tail}"), (3, f"{LONG} {tail}"), (4, LONG), (5, OTHER), (6, LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(docs).collect()}
    assert gone == {1: 0, 2: 0, 3: 13, 4: 0, 5: 0, 6: 0}
    linked = {r["doc_id"]: r["component_id"] for r in jaccard.components(docs, 3, 90, 100).collect()}
    assert linked == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 4}
