"""The event-count cube, first-seen ledger and disorder counter over unbounded input.

Late rows are taken up to the watermark and dropped after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_counts(stream: DataFrame, ts: str = "ts", host: str = "host_id", kind: str = "event_type", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """A-07 in windows of event time."""
    rows = stream.withWatermark(ts, late).groupBy(F.window(ts, width), F.col(host).alias("host_id"), F.col(kind).alias("event_type"))
    return rows.agg(F.count("*").alias("count")).select("host_id", F.unix_micros("window.start").alias("time_bin"), "event_type", "count")


def activity_sessions(stream: DataFrame, ts: str = "ts", host: str = "host_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """G-14 over a stream: runs of a host's events with no longer gap."""
    rows = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), F.col(host).alias("host_id"))
    return rows.agg(F.count("*").alias("n")).select("host_id", F.unix_micros("session_window.start").alias("start"), F.unix_micros("session_window.end").alias("end"), "n")


def disorder_counts(stream: DataFrame, ts_us: str = "ts_us", host: str = "host_id", order: str = "event_id") -> DataFrame:
    """A-13 over a stream: records and backward jumps so far, in arrival order, by host."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, errors, last = state.get if state.exists else (0, 0, 0)
        for frame in frames:
            times = frame.sort_values(order)[ts_us].to_numpy()
            before = [last, *times[:-1]]
            errors += int((times < before).sum())
            total += len(times)
            last = int(times[-1]) if len(times) else last
        state.update((total, errors, last))
        yield pd.DataFrame([(str(key[0]), total, errors)], columns=["host_id", "n_total", "n_errors"])

    rows = stream.select(F.col(host), F.col(ts_us), F.col(order)).groupBy(host)
    return rows.applyInPandasWithState(update, "host_id string, n_total long, n_errors long", "total long, errors long, last long", "update", GroupStateTimeout.NoTimeout)
