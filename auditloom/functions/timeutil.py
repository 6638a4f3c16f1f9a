"""Times are LONG nanoseconds since 1970 (microseconds where a table has no finer ones)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND_NS = 1_000_000_000
FIVE_MINUTES_NS = 300 * SECOND_NS
DAY_NS = 86_400 * SECOND_NS
#: Times before 2015-01-01 UTC are placeholders (P-10).
REALISTIC_NS = 1_420_070_400 * SECOND_NS
LONGEST = (1 << 63) - 1


def time_bin(ts: Column, width: int) -> Column:
    """Start of the ``width`` bin that holds ``ts`` (P-11)."""
    return ts - F.pmod(ts, F.lit(width))


def relative_bin(ts: Column, start: int, end: int, width: int) -> Column:
    """Index of the bin from ``start``; null outside ``0 <= b < (end - start) / width + 1`` (P-12)."""
    b = F.floor((ts - start) / width).cast("long")
    return F.when((ts >= start) & (b < (end - start) // width + 1), b)


def realistic(ts: Column) -> Column:
    return ts >= REALISTIC_NS


def in_window(ts: Column, start: int | None = None, end: int | None = None) -> Column:
    """Half-open filter ``start <= ts < end``; a missing side is unbounded (S-03)."""
    return (ts >= (0 if start is None else start)) & (ts < (LONGEST if end is None else end))


def ns_to_timestamp(ts: Column) -> Column:
    return F.timestamp_micros(F.floor(ts / 1000).cast("long"))


def timestamp_to_ns(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def iso_to_ns(text: Column) -> Column:
    """ISO-8601 text with an offset (none: UTC) to nanoseconds at microsecond precision; null if it fails."""
    return F.unix_micros(F.try_to_timestamp(text)) * 1000


def zone_to_ns(text: Column, zone: str = "America/New_York") -> Column:
    """Local wall-clock text of ``zone`` to nanoseconds."""
    return F.unix_micros(F.to_utc_timestamp(F.to_timestamp(text), zone)) * 1000


def micros(ntz: Column) -> Column:
    """Microseconds of a time column with or without a zone; the session zone must be UTC."""
    return F.unix_micros(ntz.cast("timestamp"))


def week_hours(ts: Column, zone: str = "UTC") -> Column:
    """Hours since local Monday 00:00 (W-10)."""
    local = F.from_utc_timestamp(ns_to_timestamp(ts), zone)
    return (F.unix_micros(local) - F.unix_micros(F.date_trunc("week", local))) / F.lit(3.6e9)


def time_slices(intervals: DataFrame, step: int, start: str = "start", end: str = "end") -> DataFrame:
    """``[start, end)`` cut into steps, the last one truncated; nothing if empty (W-13)."""
    steps = F.when(F.col(end) > F.col(start), F.sequence(F.col(start), F.col(end) - 1, F.lit(step)))
    rows = intervals.withColumn("slice_start", F.explode(steps))
    return rows.withColumn("slice_end", F.least(F.col("slice_start") + step, F.col(end)))


def partition_by_time(start: int, end: int, n: int) -> list[tuple[int, int]]:
    """``n`` slices of equal width, the last of which takes the remainder (S-12)."""
    width = (end - start) // max(n, 1)
    if width <= 0:
        return [(start, end)]
    return [(start + i * width, end if i == n - 1 else start + (i + 1) * width) for i in range(n)]
