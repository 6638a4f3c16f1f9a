"""Attack windows: their table, the time slices that hold them, and the label coverage of each.

A window is ``dataset, sub_dataset, host, host_uuid, report_sec, description,
start_edt, end_edt``; label sets are ``dataset, sub_dataset, source, uuid`` and,
where a source labels by report section, ``section``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeutil import SECOND_NS, zone_to_ns
from ..sources.labels import section_key
from . import coverage, graph

#: Minutes around a window that its slice keeps.
PAD_MINUTES = 30
WINDOW_KEY = ["dataset", "sub_dataset", "host_uuid", "start", "end", "report_sec"]


def timed_windows(windows: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Windows with ``start`` and ``end`` in nanoseconds and the section of their report."""
    return windows.withColumns({"start": zone_to_ns(F.col("start_edt"), zone), "end": zone_to_ns(F.col("end_edt"), zone), "section": section_key(F.col("report_sec"))})


def slices(windows: DataFrame, pad_minutes: int = PAD_MINUTES) -> DataFrame:
    """G-14: padded windows of a data set's part, merged where they overlap or touch, and named."""
    rows = graph.merge_intervals(windows, ["dataset", "sub_dataset"], "start", "end", pad_minutes * 60 * SECOND_NS).drop("island")
    return rows.withColumn("name", graph.slice_name(F.col("dataset"), F.col("sub_dataset"), F.col("start"), F.col("end")))


def window_labels(windows: DataFrame, labels: DataFrame) -> DataFrame:
    """A-29, T-04: distinct labels of each window and source; labels with a section only join windows of that section."""
    rows = labels if "section" in labels.columns else labels.withColumn("section", F.lit(None).cast("string"))
    side = rows.select(F.col("dataset").alias("_d"), F.col("sub_dataset").alias("_p"), F.col("section").alias("_s"), "source", F.upper("uuid").alias("uuid"))
    hit = (F.col("dataset") == F.col("_d")) & (F.col("sub_dataset") == F.col("_p")) & (F.col("_s").isNull() | (F.col("_s") == F.col("section")))
    return windows.select(*WINDOW_KEY, "section").join(side, hit).select(*WINDOW_KEY, "source", "uuid").distinct()


def coverage_table(windows: DataFrame, labels: DataFrame, lookup: DataFrame, records: DataFrame, known_slices: DataFrame) -> DataFrame:
    """A-20, J-05..J-11, T-06: a row for each window and source with its funnel and rates.

    ``l1``: in the lookup; ``l2``: in the graph; ``l3a``: with the host at any
    time; ``l3b``: with the host in the slice; ``l4``: in the window. Windows
    without a host or a slice come back with ``skip_reason``. All windows go
    through one plan; none is started or looked up by itself.
    """
    placed = coverage.containing_slice(timed_windows(windows), known_slices)
    reason = F.when(F.coalesce(F.col("host_uuid"), F.lit("")) == "", "missing_host_uuid").when(F.col("slice").isNull(), "no_matching_instance")
    usable = placed.where(reason.isNull())
    wanted = window_labels(usable, labels)
    edges, structural = graph.event_edges(records), graph.structural_edges(records)
    origins = structural.where("rel_type = 'originatesFrom'")
    ends = edges.select("ts_ns", F.col("src").alias("p"), F.col("dst").alias("other")).union(edges.select("ts_ns", F.col("dst"), F.col("src")))
    touched = origins.select(F.col("src").alias("p"), F.col("dst").alias("host_uuid")).join(ends, "p")
    touched = touched.select("host_uuid", "ts_ns", F.explode(F.array("p", "other")).alias("uuid"))
    at_host = usable.select(*WINDOW_KEY, "slice_start", "slice_end").join(touched, "host_uuid")
    inside = lambda a, b: (F.col("ts_ns") >= F.col(a)) & (F.col("ts_ns") < F.col(b))
    active = at_host.where(inside("start", "end")).select(*WINDOW_KEY, "uuid").distinct()
    stages = {
        "l1": lookup.select("uuid"), "l2": graph.nodes(records).select("uuid"), "l3a": at_host.select(*WINDOW_KEY, "uuid"),
        "l3b": at_host.where(inside("slice_start", "slice_end")).select(*WINDOW_KEY, "uuid"), "l4": active,
    }
    table = coverage.funnel(wanted, stages, [*WINDOW_KEY, "source"])
    totals = active.groupBy(*WINDOW_KEY).agg(F.count("*").alias("total_nodes"))
    matched = wanted.select(*WINDOW_KEY, "uuid").distinct().join(active, [*WINDOW_KEY, "uuid"], "left_semi").groupBy(*WINDOW_KEY).agg(F.count("*").alias("_any"))
    table = table.join(totals, WINDOW_KEY, "left").join(matched, WINDOW_KEY, "left").withColumn("total_nodes", F.coalesce("total_nodes", F.lit(0)))
    table = coverage.base_rates(table, "l4", F.col("total_nodes"))
    local = F.round(F.coalesce("_any", F.lit(0)) / F.nullif(F.col("total_nodes"), F.lit(0)), 6)
    table = usable.join(table.withColumn("local_base_rate", local).drop("_any"), WINDOW_KEY, "left")
    return table.unionByName(coverage.skipped(placed, reason), allowMissingColumns=True)
