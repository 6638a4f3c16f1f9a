"""Timestamp disorder per host, and first samples per type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def disorder(rows: DataFrame, host: str, ts: Column, order: list[str], chunk: Column | None = None) -> DataFrame:
    """A-13, W-02, H.7: a record errs if its time lies before that of the host's previous record.

    The previous time is always the last one seen, even a backward one.
    Deviations are of the population, 0 for a single error. ``chunk`` never
    falls along the order (a split, a range of keys); with it a host's stream
    is sorted in pieces, and each piece's first row gets the last time of the
    piece before it.
    """
    rows = rows.select(F.col(host).alias("host_id"), ts.alias("t"), *order, (F.lit(0) if chunk is None else chunk).alias("_chunk"))
    last = rows.groupBy("host_id", "_chunk").agg(F.max_by("t", F.struct(*order)).alias("_last"))
    carried = F.lag("_last").over(Window.partitionBy("host_id").orderBy("_chunk"))
    rows = rows.join(last.select("host_id", "_chunk", carried.alias("_carried")), ["host_id", "_chunk"])
    here = Window.partitionBy("host_id", "_chunk").orderBy(*order)
    before = F.when(F.row_number().over(here) == 1, F.col("_carried")).otherwise(F.lag("t").over(here))
    rows = rows.select("host_id", (before - F.col("t")).alias("back"))
    late = F.when(F.col("back") > 0, F.col("back").cast("double"))
    per = rows.groupBy("host_id").agg(
        F.count("*").alias("n_total"), F.count(late).alias("n_errors"), F.avg(late).alias("mean"), F.stddev_pop(late).alias("std"),
        F.max(late).alias("max"), F.percentile(late, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"),
    )
    value = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    p = [F.get("p", F.lit(i)) for i in range(3)]
    return per.select(
        "host_id", "n_total", "n_errors", F.round(F.col("n_errors") / F.col("n_total"), 6).alias("error_rate"),
        value(F.col("mean")).alias("mean_back"), value(F.col("std")).alias("std_back"), value(F.col("max")).alias("max_back"),
        value(p[0]).alias("p25"), value(p[1]).alias("p50"), value(p[2]).alias("p75"), value(p[2] - p[0]).alias("iqr"),
    )


def first_samples(rows: DataFrame, kinds: list[str], order: list[str], n: int = 3) -> DataFrame:
    """A-28, W-09: the first ``n`` rows of each kind."""
    rank = F.row_number().over(Window.partitionBy(*kinds).orderBy(*order))
    return rows.withColumn("sample", rank).where(F.col("sample") <= n)
