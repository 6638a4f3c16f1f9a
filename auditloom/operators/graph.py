"""Property graph as node and edge DataFrames, host activity, labels on nodes, time slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import materialize
from .dispatch import RELATIONS, directed

LABELS = {"PROCESS": "Process", "FILE": "File", "SOCKET": "Socket", "EXECUTABLE": "Executable"}


def upsert(mentions: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """G-01, G-02: one row a key; of each value the last that isn't null, in order."""
    at = F.struct(*order)
    return mentions.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in values])


def node_mentions(records: DataFrame) -> DataFrame:
    """Nodes that each record speaks of; ``ord`` is its time and uuid."""
    none = lambda t: F.lit(None).cast(t)
    node = lambda label, uuid, path=none("string"), cmd=none("string"), pid=none("int"), ip=none("string"), port=none("int"): F.struct(label.alias("label"), uuid.alias("uuid"), path.alias("path"), cmd.alias("cmdline"), pid.alias("pid"), ip.alias("ip"), port.alias("port"))
    label = F.lit(None).cast("string")
    for role, name in LABELS.items():
        label = F.when(F.col("object_role") == role, name).otherwise(label)
    c = F.col
    nodes = F.array(
        node(F.lit("Process"), c("subject_uuid"), cmd=c("cmdline"), pid=c("pid")),
        node(label, c("object_uuid"), path=c("object_path"), ip=c("object_ip"), port=c("object_port")),
        node(F.lit("Host"), c("host_id")),
        node(F.lit("User"), c("user_principal")),
        node(F.lit("IPAddress"), F.when(c("edge_category").isin("SEND", "RECV"), c("object_ip"))),
    )
    rows = records.select("ts_ns", "edge_uuid", F.explode(nodes).alias("n")).select("ts_ns", "edge_uuid", "n.*")
    return rows.where("uuid is not null and uuid <> ''")


def nodes(records: DataFrame) -> DataFrame:
    """G-01..G-03: the nodes, keyed by label and uuid."""
    return upsert(node_mentions(records), ["label", "uuid"], ["ts_ns", "edge_uuid"], ["path", "cmdline", "pid", "ip", "port"])


def event_edges(records: DataFrame, once: bool = False) -> DataFrame:
    """G-04, J-19, P-07: an edge a record, named and directed by its flow; ``once`` drops repeated edge uuids."""
    relation = F.lit(None).cast("string")
    for category, name in RELATIONS.items():
        relation = F.when(F.col("edge_category") == category, name).otherwise(relation)
    rows = directed(records).select(relation.alias("rel_type"), "src", "dst", "edge_uuid", "ts_ns", "size_bytes", "raw_event_type", "host_id")
    return rows.dropDuplicates(["edge_uuid"]) if once else rows


def structural_edges(records: DataFrame) -> DataFrame:
    """G-05..G-08: distinct hasExe, hasUser, originatesFrom and hasSocketIP edges."""
    c = F.col
    edge = lambda hit, name, src, dst: F.when(hit, F.struct(F.lit(name).alias("rel_type"), src.alias("src"), dst.alias("dst")))
    edges = F.array_compact(F.array(
        edge(c("edge_category") == "EXECUTE", "hasExe", c("subject_uuid"), c("object_uuid")),
        edge(c("user_principal").isNotNull(), "hasUser", c("subject_uuid"), c("user_principal")),
        edge(F.coalesce(c("host_id"), F.lit("")) != "", "originatesFrom", c("subject_uuid"), c("host_id")),
        edge(c("edge_category").isin("SEND", "RECV") & c("object_ip").isNotNull(), "hasSocketIP", c("object_uuid"), c("object_ip")),
    ))
    return records.select(F.explode(edges).alias("e")).select("e.*").distinct()


def host_addresses(hosts: DataFrame) -> DataFrame:
    """G-09, P-18: hasHostIP edges from ``uuid, interfaces``; zone suffixes of addresses go."""
    rows = hosts.select("uuid", F.explode("interfaces").alias("i")).select("uuid", F.explode("i.ipAddresses").alias("ip"))
    return rows.select(F.lit("hasHostIP").alias("rel_type"), F.col("uuid").alias("src"), F.substring_index("ip", "%", 1).alias("dst")).distinct()


def metadata_nodes(hosts: DataFrame, principals: DataFrame) -> DataFrame:
    """G-02, G-09: Host and User nodes with what their records say, and the IPAddress nodes of the hosts' interfaces."""
    host = hosts.select(F.lit("Host").alias("label"), "uuid", F.col("host_name").alias("name"), F.col("host_type").alias("kind"), F.col("os_details").alias("details"))
    user = principals.select(F.lit("User").alias("label"), "uuid", F.col("username").alias("name"), F.col("user_id").alias("kind"), F.array_join("group_ids", ",").alias("details"))
    none = F.lit(None).cast("string")
    address = host_addresses(hosts).select(F.lit("IPAddress").alias("label"), F.col("dst").alias("uuid"), none.alias("name"), none.alias("kind"), none.alias("details")).distinct()
    return host.union(user).union(address)


def with_metadata(nodes_: DataFrame, metadata: DataFrame) -> DataFrame:
    """G-01, G-09: nodes of records and of metadata as one table, a row for each label and uuid."""
    return nodes_.join(metadata, ["label", "uuid"], "full")


def ingestion_stats(mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """G-10: mentions and distinct nodes by label, edges by type."""
    a = mentions.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n"), F.countDistinct("uuid").alias("n_distinct"))
    return a.union(edges.groupBy(F.lit("edge"), "rel_type").agg(F.count("*"), F.countDistinct("src", "dst")))


def host_nodes(originates: DataFrame, edges: DataFrame) -> DataFrame:
    """J-05, J-06: processes of a host and whatever they have an edge with, in either direction.

    Pass edges of a time window for the active nodes of that window.
    """
    both = F.explode(F.array(F.struct(F.col("src").alias("p"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("p"), F.col("src").alias("other")))).alias("e")
    # Parallel edges go before the join, not after it.
    ends = edges.select("src", "dst").distinct().select(both).select("e.*").distinct()
    hit = originates.select(F.col("src").alias("p"), F.col("dst").alias("host")).join(ends, "p")
    return hit.select("host", F.explode(F.array("p", "other")).alias("uuid")).distinct()


def record_host_nodes(records: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """J-05, J-06 from records in one pass: hosts are those of any time, edges those of ``[start, end)``."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("ts_ns") >= start)
    if end is not None:
        inside = inside & (F.col("ts_ns") < end)
    rows = records.groupBy(F.col("subject_uuid").alias("src"), F.col("object_uuid").alias("dst"), F.col("host_id").alias("host")).agg(F.max(inside).alias("inside"))
    rows = materialize(rows, "host-records")
    origins = rows.where("src is not null and coalesce(host, '') <> ''").select("src", F.col("host").alias("dst")).distinct()
    return host_nodes(origins, rows.where("inside and src is not null and dst is not null"))


def existing(uuids: DataFrame, nodes_: DataFrame) -> DataFrame:
    """J-07: uuids that some node has."""
    return uuids.join(nodes_.select("uuid"), "uuid", "left_semi")


def annotate(nodes_: DataFrame, labels: DataFrame, key: str = "uuid") -> DataFrame:
    """J-08: ``malicious`` and the sorted set of sources that say so."""
    by = labels.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("attack_sources"))
    return nodes_.join(by, key, "left").withColumn("malicious", F.col("attack_sources").isNotNull())


def clear_annotations(nodes_: DataFrame) -> DataFrame:
    """G-12: nodes as they were."""
    return nodes_.drop("malicious", "attack_sources")


def unmatched(labels: DataFrame, nodes_: DataFrame, key: str = "uuid") -> DataFrame:
    """J-09: labels that no node has."""
    return labels.join(nodes_.select(key), key, "left_anti")


def merge_intervals(rows: DataFrame, by: list[str], start: str, end: str, pad: int = 0) -> DataFrame:
    """G-14, W-07: padded intervals, overlapping or touching ones as one, with how many went in."""
    rows = rows.select(*by, (F.col(start) - pad).alias("a"), (F.col(end) + pad).alias("b"))
    order = Window.partitionBy(*by).orderBy("a", "b")
    latest = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.when(latest.isNull() | (F.col("a") > latest), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "island").agg(F.min("a").alias("start"), F.max("b").alias("end"), F.count("*").alias("n"))


def new_slices(slices: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """G-15: slices that do not exist yet."""
    return slices.join(known.select(*key), key, "left_anti")


def slice_name(dataset: Column, part: Column, start: Column, end: Column) -> Column:
    """K-11, P-20: ``dataset_part__start__end``, usable as a partition folder."""
    return F.concat_ws("__", F.concat_ws("_", dataset, part), start.cast("string"), end.cast("string"))


def parse_slice_name(name: Column) -> dict[str, Column]:
    """P-20: the parts of a slice name; the first underscore ends the data set."""
    head = F.substring_index(name, "__", 1)
    return {
        "dataset": F.substring_index(head, "_", 1), "sub_dataset": F.regexp_extract(head, "^[^_]*_(.*)$", 1),
        "start": F.try_element_at(F.split(name, "__"), F.lit(2)), "end": F.try_element_at(F.split(name, "__"), F.lit(3)),
    }


def node_label(label: Column, cmdline: Column, ip: Column, port: Column, path: Column, uuid: Column, most: int = 42) -> Column:
    """P-21: what to show for a node, cut on the left."""
    text = F.when(label == "Process", cmdline).when(label == "Socket", F.concat_ws(":", ip, port.cast("string"))).otherwise(path)
    text = F.coalesce(F.nullif(text, F.lit("")), uuid)
    return F.when(F.length(text) > most, F.concat(F.lit("…"), F.substring(text, -(most - 1), most - 1))).otherwise(text)
