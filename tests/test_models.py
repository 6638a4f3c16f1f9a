"""Filters, collapse, factorisation, regimes, streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditloom.operators import regimes, regularity
from auditloom.streaming import counts


def planted(n=40, s=60, seed=3):
    """Two periodic and two bursty blocks over Poisson noise."""
    rng, cells = np.random.default_rng(seed), {}
    blocks = [(range(0, 6), range(10, 16), [t for t in range(s) if t % 6 == 0]), (range(6, 10), range(16, 20), [t for t in range(s) if t % 10 == 0]), (range(20, 26), range(26, 30), [20, 21]), (range(30, 34), range(34, 38), [41, 42, 43])]
    for src, dst, when in blocks:
        for i in src:
            for j in dst:
                for k in when:
                    cells[i, j, k] = cells.get((i, j, k), 0) + 5
    for _ in range(200):
        key = (int(rng.integers(n)), int(rng.integers(n)), int(rng.integers(s)))
        cells[key] = cells.get(key, 0) + 1
    at = np.array(list(cells))
    return regularity.Tensor(at[:, 0], at[:, 1], at[:, 2], list(cells.values()), n, s)


def test_planted_blocks_are_found():
    t = planted()
    f, error = min((regularity.nonneg_cp(t, 4, seed=7 * i + 13) for i in range(4)), key=lambda x: x[1])
    scores, node = regularity.analyse(f)
    assert error < 0.35 and {"periodic", "bursty"} <= set(scores["regime"]) and (node != "").sum() > 20
    assert abs(scores["relevance"].sum() - 1) < 1e-9


def test_mttkrp_is_the_dense_one():
    t = planted(8, 9)
    rng = np.random.default_rng(0)
    t = regularity.Tensor(rng.integers(0, 5, 30), rng.integers(0, 5, 30), rng.integers(0, 4, 30), rng.random(30), 5, 4)
    dense = np.zeros(t.shape)
    np.add.at(dense, (t.i, t.j, t.k), t.w)
    a, b, c = (rng.random((n, 3)) for n in t.shape)
    assert np.allclose(t.mttkrp(0, a, b, c), np.einsum("ijk,jr,kr->ir", dense, b, c))
    assert np.allclose(t.mttkrp(1, a, b, c), np.einsum("ijk,ir,kr->jr", dense, a, c))
    assert np.allclose(t.mttkrp(2, a, b, c), np.einsum("ijk,ir,jr->kr", dense, a, b))


def test_core_consistency_of_an_exact_model():
    i = np.arange(3)
    t = regularity.Tensor(i, i, i, [2.0, 3.0, 4.0], 3, 3)
    f = [np.eye(3), np.eye(3), np.diag([2.0, 3.0, 4.0])]
    assert regularity.core_consistency(t, f) == pytest.approx(100)


def test_scores():
    wave = np.tile([1.0, 0, 0, 0, 0, 0], 10)
    spike = np.zeros(60)
    spike[30] = 9
    assert regularity.periodicity(wave) == 0 or regularity.periodicity(np.tile([1.0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], 12)) > 0.3
    assert regularity.burstiness(spike) > 0.3 and regularity.concentration(spike) == 1 and regularity.periodicity(np.ones(3)) == 0


def test_collapse(spark):
    events = spark.createDataFrame([(0, "a", "f"), (1, "a", "f"), (2, "a", "f"), (0, "a", "c1"), (1, "c1", "g"), (2, "c2", "g"), (1, "c1", "c2"), (1, "l1", "g"), (2, "l2", "g")], "bin long, src string, dst string")
    tree = spark.createDataFrame([("c1", "a", "PROCESS"), ("c2", "c1", "PROCESS"), ("f", "a", "FILE"), ("a", "root", "PROCESS"), ("l1", "l2", "PROCESS"), ("l2", "l1", "PROCESS")], "node string, parent string, role string")
    out, moved = regularity.collapse_ephemeral(events, tree, 3)
    got = {r["node"]: r["target"] for r in moved.collect()}
    assert got["c1"] == got["c2"] == "a"
    rows = sorted(tuple(r) for r in out.select("bin", "src", "dst").collect())
    assert (1, "a", "g") in rows and (2, "a", "g") in rows and not any(a == b for _, a, b in rows)
    before = regularity.node_stats(events).count()
    assert regularity.node_stats(out).count() <= before


def test_filter_arguments():
    for bad in (lambda: regularity.PersistenceFilter(0), lambda: regularity.ActivityFloorFilter(), lambda: regularity.TopKFilter(0)):
        with pytest.raises(ValueError):
            bad()


def test_hmm_likelihood_and_order():
    rng = np.random.default_rng(1)
    states = np.repeat([0, 1] * 6, 20)
    obs = np.where(states == 0, rng.integers(0, 2, 240), rng.integers(2, 4, 240))
    runs = [regimes.baum_welch(obs, 2, 4, iterations=n, seed=3)[0] for n in (1, 3, 10, 50)]
    assert all(a <= b + 1e-6 for a, b in zip(runs, runs[1:], strict=False))
    value = {k: regimes.bic(max(regimes.baum_welch(obs, k, 4, seed=s)[0] for s in range(4)), 240, k, 4) for k in (1, 2, 3)}
    assert min(value, key=value.get) == 2
    path = regimes.viterbi(obs, max((regimes.baum_welch(obs, 2, 4, seed=s) for s in range(4)), key=lambda x: x[0])[1])
    assert max((path == states).mean(), (path != states).mean()) > 0.95


def test_short_series_give_nulls(spark):
    cube = spark.createDataFrame([("h", i, "READ", 1) for i in range(5)], "host_id string, time_bin long, event_type string, count long")
    row = regimes.best_order(cube, 1).first()
    assert row["n_bins"] == 5 and row["best_k"] is None


def test_streams(spark, tmp_path):
    base = pd.Timestamp("2024-01-01")
    rows = pd.DataFrame({"ts": [base + pd.Timedelta(seconds=s) for s in (0, 10, 400, 390, 100_000)], "host_id": "h", "event_type": "x", "event_id": range(5)})
    rows["ts_us"] = rows["ts"].astype("int64") // 1000
    spark.createDataFrame(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r["count"] for r in run(counts.event_counts(stream()), "cube", "complete")) == [1, 2, 2]
    assert len(run(counts.activity_sessions(stream()), "sessions", "complete")) == 2
    last = run(counts.disorder_counts(stream()), "disorder", "update")[-1]
    assert (last["n_total"], last["n_errors"]) == (5, 1)
    assert F is not None
