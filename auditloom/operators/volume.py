"""Event volume per host: the count cube and the metrics over it.

The cube ``host_id, time_bin, event_type, count`` is the hub: it is a small
aggregate of the stream, and every metric here is one more aggregate of it.
Time units are the caller's; ``unit`` is how many of them make a second.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeutil import time_bin

#: Event types that carry information, and the reads and writes among them (P-13).
INFORMATION_FLOW = {
    "cdm": ("EVENT_FORK", "EVENT_CLONE", "EVENT_CREATE_THREAD", "EVENT_EXECUTE", "EVENT_LOADLIBRARY", "EVENT_READ", "EVENT_MMAP", "EVENT_LSEEK", "EVENT_WRITE", "EVENT_SENDMSG", "EVENT_SENDTO", "EVENT_RECVFROM", "EVENT_RECVMSG"),
    "ecar": ("FILE_READ", "FILE_WRITE", "MODULE_LOAD", "PROCESS_CREATE", "FLOW_START", "FLOW_MESSAGE", "REGISTRY_ADD", "REGISTRY_EDIT"),
}
READS = ("EVENT_READ", "FILE_READ", "SYSCALL_READ")
WRITES = ("EVENT_WRITE", "FILE_WRITE", "SYSCALL_WRITE")


def event_counts(events: DataFrame, width: int, host: str = "host_id", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """A-07: events by host, time bin and type."""
    key = [F.col(host).alias("host_id"), time_bin(F.col(ts), width).alias("time_bin"), F.col(kind).alias("event_type")]
    return events.groupBy(*key).agg(F.count("*").alias("count"))


def gaps(cube: DataFrame, width: int) -> DataFrame:
    """A-10: bins between a host's first and last one that hold nothing; arithmetic, no bins are generated."""
    per = cube.groupBy("host_id").agg(F.min("time_bin").alias("a"), F.max("time_bin").alias("b"), F.countDistinct("time_bin").alias("n_bins_with_events"))
    total = (F.floor((F.col("b") - F.col("a")) / width) + 1).cast("long")
    per = per.withColumn("n_bins_total", total).withColumn("n_gaps", F.col("n_bins_total") - F.col("n_bins_with_events"))
    return per.select("host_id", "n_bins_total", "n_bins_with_events", "n_gaps", F.round(100.0 * F.col("n_gaps") / F.col("n_bins_total"), 4).alias("gap_pct"))


def timespan(cube: DataFrame, day: int) -> DataFrame:
    """A-11: days from a host's first to its last bin."""
    return cube.groupBy("host_id").agg(F.round((F.max("time_bin") - F.min("time_bin")) / F.lit(float(day)), 2).alias("timespan_days"))


def information_flow(cube: DataFrame, model: str) -> DataFrame:
    """P-13: the cube's rows of types that carry information."""
    return cube.where(F.col("event_type").isin(*INFORMATION_FLOW[model]))


def bin_distances(cube: DataFrame) -> DataFrame:
    """W-04: ``d``, how far each of a host's active bins lies behind the one before it."""
    bins = cube.select("host_id", "time_bin").distinct()
    return bins.withColumn("d", F.col("time_bin") - F.lag("time_bin").over(Window.partitionBy("host_id").orderBy("time_bin")))


def volumetrics(cube: DataFrame, flow_types: Iterable[str], unit: int, single: int) -> DataFrame:
    """A-12, J-13: mean and sample deviation of events a second over a host's active bins.

    The bin width is the smallest most common distance of neighbouring bins
    (``single`` for a host of one bin). All and flow events are summed in one
    pass, so no join of the two is needed.
    """
    flows = F.col("event_type").isin(*flow_types)
    bins = cube.groupBy("host_id", "time_bin").agg(F.sum("count").alias("n"), F.sum(F.when(flows, F.col("count")).otherwise(0)).alias("f"))
    bins = bins.withColumn("d", F.col("time_bin") - F.lag("time_bin").over(Window.partitionBy("host_id").orderBy("time_bin")))
    per = bins.groupBy("host_id").agg(
        F.coalesce(F.mode("d", True), F.lit(single)).alias("width"),
        *[g(c).alias(f"{name}_{c}") for c in ("n", "f") for name, g in (("mean", F.avg), ("std", F.stddev_samp))],
    )
    rate = lambda c: F.round(F.col(c) * unit / F.col("width"), 4)
    return per.select("host_id", rate("mean_n").alias("events_per_s"), rate("std_n").alias("events_per_s_std"), rate("mean_f").alias("flow_per_s"), rate("std_f").alias("flow_per_s_std"))


def rw_collapse(cube: DataFrame, reads: Iterable[str] = READS, writes: Iterable[str] = WRITES) -> DataFrame:
    """P-14: reads and writes only, relabelled and summed again."""
    kind = F.when(F.col("event_type").isin(*reads), "READ").when(F.col("event_type").isin(*writes), "WRITE")
    rows = cube.withColumn("event_type", kind).where("event_type is not null")
    return rows.groupBy(*[c for c in cube.columns if c != "count"]).agg(F.sum("count").alias("count"))


def rebin(cube: DataFrame, width: int, times: int) -> DataFrame:
    """W-11: bins of ``times`` widths; the factor must be whole and positive."""
    if times < 1 or times != int(times):
        raise ValueError("a coarse bin is a whole number of fine ones")
    rows = cube.withColumn("time_bin", time_bin(F.col("time_bin"), width * int(times)))
    return rows.groupBy("host_id", "time_bin", "event_type").agg(F.sum("count").alias("count"))


def type_percentages(rows: DataFrame, group: str, *kinds: str) -> DataFrame:
    """A-15, A-16: counts of types and their share of the group, in percent."""
    counts = rows.groupBy(group, *kinds).agg(F.count("*").alias("n"))
    share = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(group))
    return counts.select(group, *kinds, "n", F.round(share, 4).alias("pct"))


def type_totals(rows: DataFrame, *levels: str) -> DataFrame:
    """A-17: counts by every prefix of the levels; ``level`` says how many are summed away."""
    return rows.rollup(*levels).agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def rolling_rate(cube: DataFrame, width: int, back: int = 3, ahead: int = 2) -> DataFrame:
    """W-05: centred mean over ``back + 1 + ahead`` bins, empty bins included."""
    bins = cube.groupBy("host_id", "time_bin").agg(F.sum("count").alias("n"))
    ends = bins.groupBy("host_id").agg(F.min("time_bin").alias("a"), F.max("time_bin").alias("b"))
    grid = ends.select("host_id", F.explode(F.sequence("a", "b", F.lit(width))).alias("time_bin"))
    full = grid.join(bins, ["host_id", "time_bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    near = Window.partitionBy("host_id").orderBy("time_bin").rowsBetween(-back, ahead)
    return full.select("host_id", "time_bin", "n", F.round(F.avg("n").over(near), 4).alias("rolling"))


def fleet_correlation(cube: DataFrame) -> DataFrame:
    """A-26, J-17: Pearson correlation of each pair of hosts over their common bins; constant hosts are left out."""
    bins = cube.groupBy("host_id", "time_bin").agg(F.sum("count").alias("n"))
    varying = bins.groupBy("host_id").agg(F.stddev_pop("n").alias("sd")).where("sd > 0").select("host_id")
    bins = bins.join(varying, "host_id")
    other = bins.select(F.col("host_id").alias("host_b"), "time_bin", F.col("n").alias("m"))
    pairs = bins.join(other, "time_bin").where(F.col("host_id") < F.col("host_b"))
    return pairs.groupBy(F.col("host_id").alias("host_a"), "host_b").agg(F.count("*").alias("n_bins"), F.round(F.corr("n", "m"), 6).alias("r"))


def fleet_median(cube: DataFrame) -> DataFrame:
    """A-27: median over hosts of each bin's positive counts."""
    bins = cube.groupBy("host_id", "time_bin").agg(F.sum("count").alias("n")).where("n > 0")
    return bins.groupBy("time_bin").agg(F.count("*").alias("n_hosts"), F.round(F.percentile("n", F.lit(0.5)), 4).alias("median_n"))


def counter_deltas(rows: DataFrame, track: list[str], order: list[str], value: str) -> DataFrame:
    """A-25, W-06: growth since the track's previous sample, never below zero; first samples go."""
    before = F.lag(value).over(Window.partitionBy(*track).orderBy(*order))
    delta: Column = F.greatest(F.lit(0.0), F.col(value) - before)
    return rows.withColumn("has_before", before.isNotNull()).withColumn("delta", delta).where("has_before").drop("has_before")


def category_shares(weights: DataFrame, categories: Iterable[str], group: str = "host_id") -> DataFrame:
    """A-23: share of each category in a group's weight; absent categories have zero."""
    names = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("category")) for i, c in enumerate(categories)]))
    grid = weights.select(group).distinct().select(group, names.alias("x")).select(group, "x.*")
    sums = weights.groupBy(group, "category").agg(F.sum("weight").alias("weight"))
    full = grid.join(sums, [group, "category"], "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    total = F.sum("weight").over(Window.partitionBy(group))
    return full.select(group, "position", "category", "weight", F.round(F.col("weight") / F.nullif(total, F.lit(0)), 6).alias("share"))
