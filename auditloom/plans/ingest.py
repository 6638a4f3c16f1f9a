"""From raw logs to common records and raw-line metrics, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records, textnorm
from ..functions.timeutil import FIVE_MINUTES_NS, realistic
from ..functions.shared import materialize
from ..operators import dispatch, evolution, graph, lookup, volume
from ..sources import scan, sinks
from .cache import Cache


def object_lookup(spark: SparkSession, registry: DataFrame, dataset: str, part: str, cache: Cache | None = None) -> DataFrame:
    """Pass 1, over all of the part's files whatever the window; kept if a cache is given."""

    def build() -> DataFrame:
        lines = scan.read_dataset(spark, scan.subset(registry, dataset, part), dataset)
        mentions = lookup.ecar_mentions(lines, scan.ORDER) if records.is_ecar(dataset) else lookup.cdm_mentions(lines, scan.ORDER)
        return lookup.object_lookup(mentions, scan.ORDER)

    return cache.get("ObjectLookup", f"{dataset}/{part}", build) if cache else build()


def classified_records(spark: SparkSession, registry: DataFrame, dataset: str, part: str, start: int | None = None, end: int | None = None, cache: Cache | None = None) -> DataFrame:
    """Pass 2: every line of the window with its edge or its drop reason."""
    objects = object_lookup(spark, registry, dataset, part, cache)
    lines = scan.read_dataset(spark, scan.subset(registry, dataset, part), dataset, start, end)
    classify = dispatch.classify_ecar if records.is_ecar(dataset) else dispatch.classify_cdm
    return classify(lines, objects, dataset, part)


def build_graph(spark: SparkSession, registry: DataFrame, dataset: str, part: str, root: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """G-11: lookup, metadata, records, nodes and edges of a time slice, written below ``root``; its statistics.

    One call from raw files to a stored graph: pass 1 over all files, pass 2
    over the window, then nodes (merged with host and user metadata), event and
    structural edges.
    """
    classified = materialize(classified_records(spark, registry, dataset, part, start, end), "classified")
    records_ = dispatch.common_records(classified)
    nodes, edges, structural = graph.nodes(records_), graph.event_edges(records_), graph.structural_edges(records_)
    if not records.is_ecar(dataset):
        lines = scan.read_dataset(spark, scan.subset(registry, dataset, part), dataset)
        hosts = materialize(lookup.host_metadata(lines, scan.ORDER), "hosts")
        nodes = graph.with_metadata(nodes, graph.metadata_nodes(hosts, lookup.principal_metadata(lines, scan.ORDER)))
        structural = structural.union(graph.host_addresses(hosts))
    name = f"{dataset}_{part}__{'' if start is None else start}__{'' if end is None else end}"
    none = [c for c in edges.columns if c not in structural.columns]
    sinks.write_graph(nodes, edges.unionByName(structural.withColumns({c: F.lit(None).cast(edges.schema[c].dataType) for c in none})), root, name)
    return graph.ingestion_stats(graph.node_mentions(records_), edges)


def raw_event_counts(lines: DataFrame, dataset: str, width: int = FIVE_MINUTES_NS) -> DataFrame:
    """A-07 from raw lines, by regular expression alone; unrealistic times go (P-10)."""
    kind, host = records.event_key(F.col("value"), dataset)
    rows = lines.where(realistic(F.col("ts_ns"))).select("ts_ns", kind.alias("event_type"), host.alias("host_id"))
    return volume.event_counts(rows.where("event_type is not null"), width, ts="ts_ns")


def raw_ledger(lines: DataFrame, dataset: str, part: str, normal: bool = True) -> DataFrame:
    """A-08, A-09 from raw lines, in arrival order."""
    command, host = records.command_line(F.col("value"), dataset)
    rows = lines.where(realistic(F.col("ts_ns"))).withColumn("host_id", host).where("host_id is not null")
    ledger = evolution.first_seen_ledger(rows, "host_id", command, "ts_ns", scan.ORDER)
    return evolution.normalized_ledger(ledger, textnorm.normalize(F.col("command"), dataset, part)) if normal else ledger
