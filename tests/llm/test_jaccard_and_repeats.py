"""N-gram Jaccard join and substring dedup against brute force."""

import re
from collections import defaultdict

import numpy as np
import pytest

from auditloom.llm import jaccard, substrings
from auditloom.llm.common import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_sets(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n, num, den):
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, brute_sets(t, n)) for i, t in rows if i is not None]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and den * len(a & b) >= num * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in root}


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_components(docs, texts, n, num, den, monkeypatch):
    want = brute_components(texts, n, num, den)
    # Columns and components fit into blocks; columns don't; components don't either.
    for rows, block in ((48, 1024), (2, 1024), (2, 4), (48, 4)):
        monkeypatch.setattr(jaccard, "COLUMN_ROWS", rows)
        monkeypatch.setattr(jaccard, "BLOCK_DOCS", block)
        got = jaccard.components(docs, n, num, den).collect()
        assert len(got) == len(texts)
        assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"]) for r in got) == sorted((i is None, i or 0, len(brute_sets(t, n))) for i, t in texts)


def test_block_product():
    rng = np.random.default_rng(4)
    make = lambda k: [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(k)]
    a, b = make(30), make(25)
    a[3] = b[4]
    exact = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 60 * len(np.union1d(x, y))
    got = jaccard.block_links(a, b, 60, 100)
    assert got.tolist() == [[exact(x, y) for y in b] for x in a]
    inner = jaccard.block_links(a, None, 60, 100)
    assert all(inner[i, j] == (i != j and exact(a[i], a[j])) for i in range(30) for j in range(30))


def test_cells_never_understate_an_overlap():
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 63, 60_000).astype(np.uint64)
    sets = [np.unique(pool[rng.integers(0, top, size)]) for size, top in ((5, 9), (900, 1200), (1100, 1200), (9000, 12_000), (12_000, 14_000), (40_000, 60_000))]
    cells, n = jaccard.Cells([jaccard.cell_counts(s).tobytes() for s in sets]), np.array([len(s) for s in sets])
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            num = both * 1000 // (n[i] + n[j] - both)
            assert jaccard._may_link(n, cells, np.array([i]), np.array([j]), num, 1000).all()
    other = [np.unique(rng.integers(0, 1 << 63, k).astype(np.uint64)) for k in (6000, 6100)]  # long and unrelated
    two = jaccard.Cells([jaccard.cell_counts(s).tobytes() for s in other])
    assert not jaccard._may_link(np.array([6000, 6100]), two, np.array([0]), np.array([1]), 80, 100).any()
    full = jaccard.cell_counts(np.arange(300, dtype=np.uint64) << np.uint64(20))  # one cell beyond its count
    assert jaccard._may_link(np.array([300, 300]), jaccard.Cells([full.tobytes()] * 2), np.array([0]), np.array([1]), 100, 100).all()


def test_prefix_is_enough():
    for n in range(1, 200):
        assert jaccard.prefix_size(n, 9, 10) == n - int(np.ceil(round(0.9 * n, 9))) + 1


def brute_kept(rows, n):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        if i is not None:
            for s in range(len(w) - n + 1):
                k = tuple(w[s : s + n])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - n + 1 if i is not None else 0):
            if first[tuple(w[s : s + n])] < i:
                gone[s : s + n] = [True] * n
        out.append((i is None, i or 0, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("plus", [1000, 0])
def test_repeats(docs, texts, monkeypatch, plus):
    monkeypatch.setattr(substrings, "FREQUENT_PLUS", plus)  # without it, every anchor counts as frequent
    for length in (13, 4):
        got = substrings.remove_repeats(docs, length).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_kept(texts, length)


def test_empty_tables(nothing):
    assert jaccard.components(nothing).count() == 0 and substrings.remove_repeats(nothing).count() == 0


def test_components_of_a_graph(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, x) for x in range(2001, 2100)] + [(5, None)]
    root = defaultdict(lambda: None)

    def find(x):
        root[x] = x if root[x] is None else root[x]
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        if b is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
