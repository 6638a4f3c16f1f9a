"""Links of vectors whose only common bucket holds others that are like one of them and unlike the other."""

import numpy as np
import pytest

from auditloom.llm import embeddings

D = 16


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


@pytest.fixture(scope="module")
def found():
    """``x`` and ``y``, which link and share one bucket, and vectors of that bucket like ``x`` by their signs and unlike ``y``."""
    rng = np.random.default_rng(11)
    for _ in range(60):
        x = unit(rng.normal(size=(2000, D)))
        aside = rng.normal(size=(2000, D))
        aside = unit(aside - (aside * x).sum(1, keepdims=True) * x)
        y = 0.932 * x + np.sqrt(1 - 0.932**2) * aside
        x, y = unit(x.astype(np.float32).astype(float)), unit(y.astype(np.float32).astype(float))
        both = embeddings.keys(x) == embeddings.keys(y)
        for i in np.flatnonzero((both.sum(1) == 1) & embeddings._alike(embeddings.signs(x), embeddings.signs(y))):
            table = int(both[i].argmax())
            w = rng.normal(size=(4000, D)) - 3 * aside[i]
            w = unit(w - (w @ x[i])[:, None] * x[i])
            s = unit((np.cos(0.66) * x[i] + np.sin(0.66) * w).astype(np.float32).astype(float))
            own, mark = embeddings.keys(s), embeddings.signs(s)
            like, unlike = embeddings._alike(mark, embeddings.signs(x[i][None])), ~embeddings._alike(mark, embeddings.signs(y[i][None]))
            good = np.flatnonzero((own[:, table] == embeddings.keys(x[i][None])[0, table]) & like & unlike)
            if len(good):
                return x[i], y[i], s[good[0]]
    raise AssertionError("no such vectors")


@pytest.mark.parametrize("others", [1, 12, 120])
def test_a_bucket_keeps_its_links_whatever_else_is_there(spark, found, others):
    x, y, s = found
    rng = np.random.default_rng(others)
    crowd = [s + 1e-4 * rng.normal(size=D) * (k > 0) for k in range(others)]
    rows = [(k, [float(np.float32(v)) for v in vector], 1) for k, vector in enumerate([*crowd, x, y])]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1)).collect()}
    values = unit(np.array([v for _, v, _ in rows]))
    links = values @ values.T >= 0.93
    assert [got[k]["n_links"] for k in range(len(rows))] == (links.sum(1) - 1).tolist()
    assert got[others]["component_id"] == got[others + 1]["component_id"] == others
    assert got[0]["component_id"] == 0


def test_blocks_of_guests_meet_all_others(spark, monkeypatch):
    """Every two vectors of a bucket, of different components and like signs, with several blocks of either side."""
    monkeypatch.setattr(embeddings, "BLOCK", 4)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, D))
    vectors = unit(centres[np.arange(60) % 6] + 0.5 * rng.normal(size=(60, D)))
    packed = embeddings.signs(vectors)
    component = np.where(np.arange(60) < 30, 0, np.arange(60))
    rows = spark.createDataFrame([(7, i, int(component[i])) for i in range(60)], "h long, id long, c long")
    signed = spark.createDataFrame([(i, 1, bytearray(packed[i].tobytes())) for i in range(60)], "id long, l long, s binary")
    edges = embeddings._between_components(rows, signed).collect()
    near = embeddings._alike(packed[:, None].reshape(60, 1, -1).repeat(60, 1).reshape(3600, -1), np.tile(packed, (60, 1))).reshape(60, 60) & (component[:, None] != component)

    def classes(pairs):
        least = list(range(60))
        for _ in range(60):
            for a, b in pairs:
                least[a] = least[b] = min(least[a], least[b])
        return least

    joined = [(i, int(c)) for i, c in enumerate(component)]
    assert near.any()
    assert classes(joined + [(r["a"], r["b"]) for r in edges]) == classes(joined + list(zip(*map(list, np.nonzero(near)), strict=True)))
