"""Activity regularity: node filters, ephemeral-process collapse, sparse tensors and their factors.

Events are ``host_id, bin, src, dst``; every step keeps the host as a key, so
all hosts go through one plan. Factorisation runs per (host, rank, start) on
NumPy, whose input is one host's counted cells.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import materialize
from .lookup import resolve_chain

#: Regimes in their order, thresholds and limits.
REGIMES = ("periodic", "bursty", "aperiodic", "noise")
THRESHOLD = 0.3
MAX_NODES = 10_000
RANKS = list(range(1, 15))
CORE_LEAST = 50.0
BLOCK_BINS = 5


def node_stats(events: DataFrame, *by: str) -> DataFrame:
    """A-18: degree (a loop counts twice), distinct bins, first and last bin of each node."""
    rows = events.select(*by, "bin", F.explode(F.array("src", "dst")).alias("node"))
    return rows.groupBy(*by, "node").agg(F.count("*").alias("degree"), F.countDistinct("bin").alias("n_bins"), F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"))


class NodeFilter(ABC):
    """Chooses nodes by their stats; events keep both ends or go."""

    @abstractmethod
    def keep(self, stats: DataFrame, by: list[str]) -> DataFrame:
        """The rows of ``stats`` that stay."""

    def describe(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v}' for k, v in vars(self).items())})"


class PersistenceFilter(NodeFilter):
    """N-11: nodes that are active in ``min_bins`` bins or more."""

    def __init__(self, min_bins: int):
        if min_bins < 1:
            raise ValueError("min_bins is at least 1")
        self.min_bins = min_bins

    def keep(self, stats: DataFrame, by: list[str]) -> DataFrame:
        return stats.where(F.col("n_bins") >= self.min_bins)


class ActivityFloorFilter(NodeFilter):
    """N-12: nodes whose degree reaches ``max(1, min_events, whole part of the degrees' quantile)``."""

    def __init__(self, min_events: int | None = None, quantile: float | None = None):
        if min_events is None and quantile is None:
            raise ValueError("give min_events or quantile")
        self.min_events, self.quantile = min_events, quantile

    def keep(self, stats: DataFrame, by: list[str]) -> DataFrame:
        floor: Column = F.lit(max(1, self.min_events or 1)).cast("long")
        if not by:
            return self.keep(stats.withColumn("_all", F.lit(0)), ["_all"]).drop("_all")
        if self.quantile is None:
            return stats.where(F.col("degree") >= floor)
        limits = stats.groupBy(*by).agg(F.greatest(floor, F.floor(F.percentile("degree", F.lit(self.quantile))).cast("long")).alias("_floor"))
        return stats.join(limits, by).where(F.col("degree") >= F.col("_floor")).drop("_floor")


class TopKFilter(NodeFilter):
    """O-03, W-08: the ``max_nodes`` nodes of most degree, ties by name."""

    def __init__(self, max_nodes: int):
        if max_nodes < 1:
            raise ValueError("max_nodes is at least 1")
        self.max_nodes = max_nodes

    def keep(self, stats: DataFrame, by: list[str]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("degree"), "node"))
        return stats.withColumn("_rank", rank).where(F.col("_rank") <= self.max_nodes).drop("_rank")


def keep_nodes(events: DataFrame, kept: DataFrame, by: list[str]) -> DataFrame:
    """Events whose two ends are kept."""
    names = kept.select(*by, "node").distinct()
    for end in ("src", "dst"):
        events = events.join(names.withColumnRenamed("node", end), [*by, end], "left_semi")
    return events


def run_filters(events: DataFrame, filters: list[NodeFilter], by: list[str]) -> tuple[DataFrame, DataFrame]:
    """N-14, A-19: filters in order, and the funnel of nodes and events after each.

    ``n_nodes`` of a filter's row is the size of the set that it keeps, even
    where a kept node has lost all its events. Events and stats are written
    after each filter, so none is computed twice; an event adds two to the
    degrees, which gives the counts of events from the stats.
    """
    columns = [F.col(c) for c in (*by, "bin", "src", "dst")]
    stats = materialize(node_stats(events, *by), "node-stats")
    numbers = lambda rows, stage, name, what: rows.agg(what.alias("n")).select(F.lit(stage).alias("stage"), F.lit(name).alias("filter"), "n")
    half = (F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("long")
    seen, left = numbers(stats, 0, "raw", half), numbers(stats, 0, "raw", F.count("*"))
    for i, f in enumerate(filters, 1):
        kept = f.keep(stats, by)
        events = materialize(keep_nodes(events.select(*columns), kept, by), "kept-events")
        left = left.union(numbers(kept, i, f.describe(), F.count("*")))
        stats = materialize(node_stats(events, *by), "node-stats")
        seen = seen.union(numbers(stats, i, f.describe(), half))
    return events, seen.withColumnRenamed("n", "n_events").join(left.withColumnRenamed("n", "n_nodes"), ["stage", "filter"])


def cap_nodes(events: DataFrame, by: list[str], most: int = MAX_NODES) -> DataFrame:
    """The hard cap of a graph that is still too large: its nodes of most degree (a limit by definition)."""
    return keep_nodes(events, TopKFilter(most).keep(node_stats(events, *by), by), by)


def climb(up: DataFrame) -> DataFrame:
    """Follow ``node, target`` (one row a node) to the top of each chain; a loop's top is its least node.

    Doubling: after k rounds a pointer has gone 2**k steps up, or stands at its
    top. Nodes that still climb get fewer each round until only those below or
    in a loop are left. Their count bounds the steps that reach and go round it.
    """
    up = materialize(up.withColumn("least", F.col("target")), "climb")
    steps, before = 1, None
    while True:
        climbing = up.join(up.select(F.col("node").alias("target")), "target", "left_semi").count()
        if not climbing:
            return up.select("node", "target")
        if climbing == before and steps >= climbing:
            break
        step = up.select(F.col("node").alias("_n"), F.col("target").alias("_t"), F.col("least").alias("_l"))
        rows = up.join(step, F.col("target") == F.col("_n"), "left")
        up = materialize(rows.select("node", F.coalesce("_t", "target").alias("target"), F.least("least", "_l").alias("least")), "climb")
        steps, before = 2 * steps, climbing
    # Every pointer into a loop now stands in it, and there ``least`` has gone all round.
    loops = up.select(F.col("node").alias("_n"), F.col("least").alias("_l"))
    return up.join(loops, F.col("target") == F.col("_n"), "left").select("node", F.coalesce("_l", "target").alias("target"))


def collapse_ephemeral(events: DataFrame, lookup: DataFrame, min_bins: int) -> tuple[DataFrame, DataFrame]:
    """N-13, J-04: short-lived processes become their first lasting ancestor in the slice.

    ``lookup`` has ``node, parent, role``. Parents outside the slice end a
    chain; a chain of ephemeral ones is followed to its top, whatever its
    length, by pointer doubling. Processes whose chain runs into a loop become
    the loop's least node. Rewritten loops go. Returns the events and the map
    ``node, target``.
    """
    stats = node_stats(events)
    nodes = stats.select("node", (F.col("n_bins") < min_bins).alias("short"))
    rows = lookup.where("role = 'PROCESS'").select("node", "parent").join(nodes, "node").where("short")
    rows = rows.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").where("parent <> node")
    up = climb(rows.groupBy("node").agg(F.min("parent").alias("target"))).where("node <> target")
    for end in ("src", "dst"):
        m = up.select(F.col("node").alias("_n"), F.col("target").alias("_t"))
        events = events.join(m, F.col(end) == F.col("_n"), "left").withColumn(end, F.coalesce("_t", end)).withColumn(f"_{end}", F.col("_t").isNotNull()).drop("_n", "_t")
    moved = F.col("_src") | F.col("_dst")
    return events.where(~(moved & (F.col("src") == F.col("dst")))).drop("_src", "_dst"), up


def collapse_diagnostics(events: DataFrame, lookup: DataFrame, min_bins: int, remap: DataFrame) -> DataFrame:
    """N-13: one row: candidates, collapsed ones, loops dropped, groups, and the largest group with its target."""
    short = node_stats(events).where(F.col("n_bins") < min_bins).select("node")
    candidates = lookup.where("role = 'PROCESS'").select("node").distinct().join(short, "node", "left_semi")
    groups = remap.groupBy("target").agg((F.count("*") + 1).alias("size"))
    ends = events
    for end in ("src", "dst"):
        m = remap.select(F.col("node").alias("_n"), F.col("target").alias(f"_{end}"))
        ends = ends.join(m, F.col(end) == F.col("_n"), "left").drop("_n")
    moved = F.col("_src").isNotNull() | F.col("_dst").isNotNull()
    loops = ends.where(moved & (F.coalesce("_src", "src") == F.coalesce("_dst", "dst")))
    parts = [candidates.agg(F.count("*").alias("n_candidates")), remap.agg(F.count("*").alias("n_collapsed")), loops.agg(F.count("*").alias("n_self_loops_dropped")), groups.agg(F.count("*").alias("n_groups"), F.coalesce(F.max("size"), F.lit(0)).alias("max_group_size"))]
    return parts[0].join(parts[1]).join(parts[2]).join(parts[3])  # four tables of one row


def tensor_counts(events: DataFrame, *by: str) -> DataFrame:
    """Cells by name."""
    return events.groupBy(*by, "bin", "src", "dst").agg(F.count("*").alias("n"))


def tensor_cells(events: DataFrame, *by: str) -> DataFrame:
    """N-01: counted cells of the sparse tensor; indexes are ranks of sorted node names."""
    names = events.select(*by, F.explode(F.array("src", "dst")).alias("node")).distinct()
    names = names.withColumn("i", F.dense_rank().over(Window.partitionBy(*by).orderBy("node")) - 1)
    rows = events.groupBy(*by, "bin", "src", "dst").agg(F.count("*").alias("w"))
    for end in ("src", "dst"):
        side = names.withColumnRenamed("node", end).withColumnRenamed("i", f"{end}_i")
        rows = rows.join(side, [*by, end])
    return rows


class Tensor:
    """A sparse ``N x N x S`` tensor as coordinate lists."""

    def __init__(self, src, dst, bins, w, n: int, s: int):
        self.i, self.j, self.k = (np.asarray(x, np.int64) for x in (src, dst, bins))
        self.w, self.shape = np.asarray(w, float), (n, n, s)

    @property
    def norm(self) -> float:
        return float(np.sqrt((self.w**2).sum()))

    def mttkrp(self, mode: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """N-02: the matricised tensor times the other factors' Khatri-Rao product, over non-zeros only."""
        at = (self.i, self.j, self.k)
        others = [f[x] for m, (f, x) in enumerate(zip((a, b, c), at, strict=True)) if m != mode]
        rows = self.w[:, None] * others[0] * others[1]
        return np.stack([np.bincount(at[mode], rows[:, r], self.shape[mode]) for r in range(a.shape[1])], axis=1)


def nonneg_cp(t: Tensor, rank: int, max_iter: int = 100, tol: float = 1e-4, seed: int = 42) -> tuple[list[np.ndarray], float]:
    """N-03, H.1: projected alternating least squares; factors and relative error."""
    rng = np.random.default_rng(seed)
    f = [np.abs(rng.normal(0, 1, (n, rank))) * 0.01 for n in t.shape]
    norm, before = t.norm, np.inf
    error = norm
    for _ in range(max_iter):
        for mode in range(3):
            other = [f[m] for m in range(3) if m != mode]
            gram = (other[0].T @ other[0]) * (other[1].T @ other[1])
            numerator = t.mttkrp(mode, *f)
            f[mode] = np.maximum(numerator @ np.linalg.pinv(gram), 1e-12)
        grams = (f[0].T @ f[0]) * (f[1].T @ f[1]) * (f[2].T @ f[2])
        error = float(np.sqrt(max(norm**2 - 2 * (numerator * f[2]).sum() + grams.sum(), 0.0)))
        if np.isfinite(before) and abs(before - error) / (before + 1e-12) < tol:
            break
        before = error
    return f, error / norm if norm else 0.0


def core_consistency(t: Tensor, f: list[np.ndarray]) -> float:
    """N-05, H.2: 100 for a core that is superdiagonal, on coordinates only."""
    a, b, c = (np.linalg.pinv(x) for x in f)
    rank = f[0].shape[1]
    core = np.stack([(a[:, t.i] * (t.w * c[p, t.k])) @ b[:, t.j].T for p in range(rank)], axis=2)
    ideal = np.zeros_like(core)
    ideal[np.arange(rank), np.arange(rank), np.arange(rank)] = 1
    return float(100 * (1 - ((core - ideal) ** 2).sum() / rank))


def periodicity(c: np.ndarray) -> float:
    """N-07, H.3: greatest autocorrelation at lags beyond the burst's width."""
    c = np.asarray(c, float)
    n, top = len(c), c.max(initial=0.0)
    centred = c - c.mean() if n else c
    power = float(centred @ centred)
    if n < 4 or top <= 0 or power <= 1e-12:
        return 0.0
    lo, hi = max(2, int((c >= 0.05 * top).sum())), n // 2
    if lo >= hi:
        return 0.0
    return max(0.0, max(float(centred[lag:] @ centred[: n - lag]) for lag in range(lo, hi + 1)) / power)


def burstiness(c: np.ndarray) -> float:
    spread, mean = float(np.std(c)), float(np.mean(c))
    return (spread - mean) / (spread + mean) if spread + mean > 1e-12 else 0.0


def concentration(c: np.ndarray, block: int = BLOCK_BINS) -> float:
    whole = len(c) // max(block, 1)
    sums = np.asarray(c, float)[: whole * block].reshape(whole, -1).sum(1) if whole else np.zeros(0)
    return float(sums.max() / sums.sum()) if sums.sum() > 1e-12 else 0.0


def classify_regime(periodic: Column, bursty: Column, concentrated: Column) -> Column:
    """N-08: the first regime whose thresholds are passed."""
    return F.when(periodic > THRESHOLD, "periodic").when((bursty > THRESHOLD) & (concentrated > THRESHOLD), "bursty").when(bursty > THRESHOLD, "aperiodic").otherwise("noise")


def regime_name(periodic: float, bursty: float, concentrated: float) -> str:
    if periodic > THRESHOLD:
        return "periodic"
    if bursty > THRESHOLD:
        return "bursty" if concentrated > THRESHOLD else "aperiodic"
    return "noise"


def analyse(f: list[np.ndarray], block: int = BLOCK_BINS) -> tuple[pd.DataFrame, np.ndarray]:
    """A-30, N-07..N-09: scores of each component, and each node's regime (empty where unassigned)."""
    weight = np.prod([np.linalg.norm(x, axis=0) for x in f], axis=0)
    relevance = weight / weight.sum() if weight.sum() > 0 else weight
    rows = [(r, relevance[r], periodicity(f[2][:, r]), burstiness(f[2][:, r]), concentration(f[2][:, r], block)) for r in range(len(weight))]
    scores = pd.DataFrame(rows, columns=["component", "relevance", "periodicity", "burstiness", "concentration"])
    scores["regime"] = [regime_name(*x) for x in scores[["periodicity", "burstiness", "concentration"]].itertuples(index=False)]
    mass = np.stack([((f[0] + f[1]) * relevance * (scores["regime"] == g).to_numpy()).sum(1) for g in REGIMES], axis=1)
    names = np.array(REGIMES, object)[mass.argmax(1)]
    return scores, np.where(mass.sum(1) > 1e-12, names, "")


def sweep(cells: DataFrame, ranks: list[int], starts: int = 5, group: str = "host_id", max_iter: int = 100) -> DataFrame:
    """N-04, N-20: best start of every rank, with error, explained share and core consistency.

    A task factorises one (host, rank): a host's graph is capped, so its cells fit.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        t = _tensor(frame)
        rank = int(frame["rank"].iloc[0])
        best = min((nonneg_cp(t, rank, max_iter, seed=init * 7 + 13) for init in range(starts)), key=lambda x: x[1])
        return pd.DataFrame([(str(frame[group].iloc[0]), rank, best[1], (1 - best[1] ** 2) * 100, core_consistency(t, best[0]))], columns=["host_id", "rank", "rel_error", "explained_pct", "core_consistency"])

    rows = cells.select(group, "bin", "src_i", "dst_i", "w").withColumn("rank", F.explode(F.array(*[F.lit(r) for r in ranks])))
    return rows.groupBy(group, "rank").applyInPandas(run, "host_id string, rank int, rel_error double, explained_pct double, core_consistency double")


def _tensor(frame: pd.DataFrame) -> Tensor:
    n = int(max(frame["src_i"].max(), frame["dst_i"].max())) + 1
    first = frame["bin"].min()
    return Tensor(frame["src_i"], frame["dst_i"], frame["bin"] - first, frame["w"], n, int(frame["bin"].max() - first) + 1)


def select_rank(table: DataFrame) -> DataFrame:
    """N-06, O-08: of ranks with enough core consistency the one of least error, else rank 1."""
    good = F.when(F.col("core_consistency") >= CORE_LEAST, F.struct("rel_error", "rank"))
    return table.groupBy("host_id").agg(F.coalesce(F.min(good)["rank"], F.lit(1)).alias("rank"), F.max(F.when(F.col("rank") <= 25, F.col("explained_pct"))).alias("best_explained_pct"))


def select_consistent_rank(table: DataFrame) -> DataFrame:
    """N-06: the last rank with enough core consistency, else the first rank tried."""
    good = F.max(F.when(F.col("core_consistency") >= CORE_LEAST, F.col("rank")))
    return table.groupBy("host_id").agg(F.coalesce(good, F.min("rank")).alias("rank"))


def components(cells: DataFrame, chosen: DataFrame, starts: int = 5, group: str = "host_id", max_iter: int = 100) -> DataFrame:
    """Scores of each host's components at its chosen rank."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        t, rank = _tensor(frame), int(frame["rank"].iloc[0])
        best = min((nonneg_cp(t, rank, max_iter, seed=init * 7 + 13) for init in range(starts)), key=lambda x: x[1])
        scores, node = analyse(best[0])
        scores.insert(0, "host_id", str(frame[group].iloc[0]))
        for g in REGIMES:
            scores[f"share_{g}"] = float((node == g).sum() / max((node != "").sum(), 1))
        return scores

    fields = "host_id string, component long, relevance double, periodicity double, burstiness double, concentration double, regime string, " + ", ".join(f"share_{g} double" for g in REGIMES)
    rows = cells.select(group, "bin", "src_i", "dst_i", "w").join(chosen.select(F.col("host_id").alias("_h"), "rank"), F.col(group).cast("string") == F.col("_h"))
    return rows.groupBy(group).applyInPandas(run, fields)


def series_scores(cube: DataFrame, width: int) -> DataFrame:
    """N-07 in SQL for a host's count series, empty bins included: burstiness and concentration."""
    bins = cube.groupBy("host_id", "time_bin").agg(F.sum("count").alias("n"))
    ends = bins.groupBy("host_id").agg(F.min("time_bin").alias("a"), ((F.max("time_bin") - F.min("time_bin")) / width + 1).cast("long").alias("len"), F.sum("n").alias("s1"), F.sum(F.col("n") * F.col("n")).alias("s2"))
    block = F.floor((F.col("time_bin") - F.col("a")) / (width * BLOCK_BINS)).cast("long")
    sums = bins.join(ends, "host_id").withColumn("block", block).where(F.col("block") < F.floor(F.col("len") / BLOCK_BINS)).groupBy("host_id", "block").agg(F.sum("n").alias("b"))
    sums = sums.groupBy("host_id").agg(F.max("b").alias("top"), F.sum("b").alias("all"))
    mean = F.col("s1") / F.col("len")
    spread = F.sqrt(F.greatest(F.col("s2") / F.col("len") - mean * mean, F.lit(0.0)))
    share = F.coalesce(F.col("top") / F.col("all"), F.lit(0.0))
    return ends.join(sums, "host_id", "left").select("host_id", F.round((spread - mean) / (spread + mean), 6).alias("burstiness"), F.round(share, 6).alias("concentration"))


def top_nodes(loadings: DataFrame, k: int = 3) -> DataFrame:
    """O-04, O-07: the ``k`` nodes of each component with most weight, and their share of it."""
    w = Window.partitionBy("host_id", "component")
    rows = loadings.withColumn("share", F.col("weight") / F.sum("weight").over(w))
    return rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc("weight"), "node"))).where(F.col("rank") <= k)


def ordered_components(scores: DataFrame) -> DataFrame:
    """O-07: each host's components by relevance, the largest first; ties by number."""
    order = Window.partitionBy("host_id").orderBy(F.desc("relevance"), "component")
    return scores.withColumn("place", F.row_number().over(order))


def ancestors(lookup: DataFrame, depth: int = 8) -> DataFrame:
    """Every node's top ancestor within ``depth`` hops."""
    return resolve_chain(lookup, "node", "parent", F.lit(False), depth)
