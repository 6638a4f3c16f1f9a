"""``ntf_components`` against a dense factorisation written out here, on hosts of more than 200 nodes."""

import datetime

import numpy as np
import pandas as pd
import pytest

from auditloom.operators import regularity
from auditloom.plans.queries import QUERIES

SUPPLIERS, PARTS, BINS = 12, 240, 8


@pytest.fixture(scope="module")
def lines():
    """Four blocks of parts, each with suppliers and bins of its own, over thin noise; every part has an edge."""
    rng, rows = np.random.default_rng(5), []
    for block in range(4):
        for part in range(block * 60, block * 60 + 60):
            for supplier in range(block * 3, block * 3 + 3):
                rows += [("A", supplier, part, 2 * block + bin) for bin in (0, 1) for _ in range(2 + block)]
    rows += [("A", int(rng.integers(SUPPLIERS)), int(rng.integers(PARTS)), int(rng.integers(BINS))) for _ in range(150)]
    frame = pd.DataFrame(rows, columns=["l_returnflag", "l_suppkey", "l_partkey", "month"])
    frame["l_shipdate"] = [datetime.date(1970, 1, 1) + datetime.timedelta(days=30 * int(m) + 3) for m in frame.pop("month")]
    return frame


def dense_cp(x, rank, seed):
    """Projected alternating least squares on unfolded dense arrays, 100 rounds at most."""
    rng = np.random.default_rng(seed)
    f = [np.abs(rng.normal(0, 1, (n, rank))) * 0.01 for n in x.shape]
    before = np.inf
    for _ in range(100):
        for mode in range(3):
            p, q = (f[m] for m in range(3) if m != mode)
            product = (p[:, None, :] * q[None, :, :]).reshape(-1, rank)
            flat = np.moveaxis(x, mode, 0).reshape(x.shape[mode], -1)
            f[mode] = np.maximum(flat @ product @ np.linalg.pinv(product.T @ product), 1e-12)
        error = np.linalg.norm(x - np.einsum("ir,jr,kr->ijk", *f, optimize=True))
        if np.isfinite(before) and abs(before - error) / (before + 1e-12) < 1e-4:
            break
        before = error
    core = np.einsum("pi,qj,rk,ijk->pqr", *map(np.linalg.pinv, f), x, optimize=True)
    core[np.arange(rank), np.arange(rank), np.arange(rank)] -= 1
    return f, error / np.linalg.norm(x), 100 * (1 - (core**2).sum() / rank)


def test_components_equal_a_dense_factorisation_of_the_whole_graph(spark, tmp_path, lines):
    spark.createDataFrame(lines).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = QUERIES["ntf_components"](spark, str(tmp_path)).toPandas().sort_values("relevance")

    src, dst = "s" + lines["l_suppkey"].astype(str), "p" + lines["l_partkey"].astype(str)
    names = {n: i for i, n in enumerate(sorted(set(src) | set(dst)))}
    assert len(names) > 200
    x = np.zeros((len(names), len(names), BINS))
    bins = [(d - datetime.date(1970, 1, 1)).days // 30 for d in lines["l_shipdate"]]
    np.add.at(x, (src.map(names), dst.map(names), bins), 1)
    found = []
    for rank in range(1, 15):
        f, error, core = min((dense_cp(x, rank, seed=7 * i + 13) for i in range(5)), key=lambda r: r[1])
        found.append((core >= 50, error, rank, f))
    _, _, rank, f = min((r for r in found if r[0]), key=lambda r: r[1])
    want, _ = regularity.analyse(f)
    want = want.sort_values("relevance")
    assert len(got) == rank > 3
    for c in ("relevance", "periodicity", "burstiness", "concentration"):
        assert np.allclose(got[c], want[c], atol=1e-4), c
    assert list(got["regime"]) == list(want["regime"])


def test_ranks_starts_and_cap_are_the_reference_ones():
    assert (regularity.RANKS, regularity.MAX_NODES) == (list(range(1, 15)), 10_000)
    assert regularity.sweep.__defaults__ == regularity.components.__defaults__ == (5, "host_id", 100)
