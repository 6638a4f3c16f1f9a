"""First-seen ledgers of command lines and how fast they saturate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeutil import time_bin


def first_seen_ledger(rows: DataFrame, host: str, command: Column, ts: str, order: list[str] | None = None) -> DataFrame:
    """A-08: when each host first shows each command, and how often; ``order`` is arrival order, else by time."""
    rows = rows.withColumn("command", command).where("command is not null")
    first = F.min_by(ts, F.struct(*order)) if order else F.min(ts)
    return rows.groupBy(F.col(host).alias("host_id"), "command").agg(first.alias("first_seen"), F.count("*").alias("n_events"))


def normalized_ledger(ledger: DataFrame, normal: Column) -> DataFrame:
    """A-09: the ledger once commands are normalised."""
    rows = ledger.withColumn("command", normal)
    return rows.groupBy("host_id", "command").agg(F.min("first_seen").alias("first_seen"), F.sum("n_events").alias("n_events"))


def saturation_curve(ledger: DataFrame, width: int) -> DataFrame:
    """A-22, W-03: new and cumulative commands by bin."""
    bins = ledger.groupBy("host_id", time_bin(F.col("first_seen"), width).alias("time_bin")).agg(F.count("*").alias("n_new"))
    so_far = Window.partitionBy("host_id").orderBy("time_bin").rowsBetween(Window.unboundedPreceding, 0)
    return bins.withColumn("n_cumulative", F.sum("n_new").over(so_far))


def saturation_auc(ledger: DataFrame, width: int) -> DataFrame:
    """A-21, H.6: area under the curve on the unit square by trapezoids; 1 for a single bin, no origin point."""
    curve = saturation_curve(ledger, width)
    whole = Window.partitionBy("host_id")
    first, last = F.min("time_bin").over(whole), F.max("time_bin").over(whole)
    curve = curve.withColumns({"span": last - first, "since": F.col("time_bin") - first, "total": F.max("n_cumulative").over(whole)})
    x = F.col("since") / F.nullif(F.col("span"), F.lit(0))
    curve = curve.select("host_id", "time_bin", "total", x.alias("x"), (F.col("n_cumulative") / F.col("total")).alias("y"))
    over = whole.orderBy("time_bin")
    area = (F.col("y") + F.lag("y").over(over)) / 2 * (F.col("x") - F.lag("x").over(over))
    curve = curve.withColumn("area", area)
    per = curve.groupBy("host_id").agg(F.max("total").alias("n_commands"), F.count("*").alias("n_bins"), F.sum("area").alias("a"))
    return per.select("host_id", "n_commands", "n_bins", F.round(F.when(F.col("n_bins") <= 1, 1.0).otherwise(F.col("a")), 6).alias("auc"))
