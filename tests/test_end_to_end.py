"""Files to records, graph, attack-window coverage and raw metrics."""

import json

import pytest
from pyspark.sql import functions as F
from test_records import cdm, event, uid

from auditloom.operators import attacks, dispatch, graph, lookup
from auditloom.plans import ingest
from auditloom.plans.cache import Cache
from auditloom.sources import scan, sinks

T0 = 1_523_000_000_000_000_000  # 2018-04-06 07:33:20 UTC
MINUTE = 60_000_000_000


@pytest.fixture(scope="module")
def registry(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("e3") / "e3" / "theia"
    root.mkdir(parents=True)
    lines = [
        cdm("Host", {"uuid": uid(900), "hostName": "h", "hostType": "x", "osDetails": "o", "interfaces": [{"name": "e", "macAddress": "m", "ipAddresses": ["fe80::1%eth0", "10.0.0.9"]}]}),
        cdm("Principal", {"uuid": uid(50), "userId": "0", "username": {"string": "root"}, "groupIds": {"array": ["0", "1"]}}),
        cdm("Subject", {"uuid": uid(1), "type": "SUBJECT_PROCESS", "cid": 5, "cmdLine": {"string": "kill -9 44"}, "localPrincipal": uid(50)}),
        cdm("FileObject", {"uuid": uid(10), "type": "FILE_OBJECT_FILE", "baseObject": {"properties": {"map": {"path": "/a"}}}}),
        cdm("FileObject", {"uuid": uid(11), "type": "FILE_OBJECT_FILE", "baseObject": {"properties": {"map": {"path": "/b"}}}}),
        event(T0 + MINUTE, "EVENT_READ", uid(1), uid(10)),
        cdm("MemoryObject", {"uuid": uid(13)}),
        event(T0 + 50 * MINUTE, "EVENT_WRITE", uid(1), uid(11)),
    ]
    (root / "a.json").write_text("\n".join(lines) + "\n")
    (root / "b.json.tar.gz").write_text("x")
    files = scan.file_registry(spark, str(root.parent.parent))
    assert files.count() == 1
    return files.withColumns({"first_realistic_ts_ns": F.lit(T0).cast("long"), "last_timestamp_ns": F.lit(T0 + 60 * MINUTE).cast("long")})


def test_records_of_a_window(spark, registry, tmp_path):
    cache = Cache(spark, str(tmp_path))
    rows = ingest.classified_records(spark, registry, "e3", "theia", T0, T0 + 10 * MINUTE, cache)
    assert cache.has("ObjectLookup", "e3/theia")
    assert [r["object_path"] for r in dispatch.common_records(rows).collect()] == ["/a"]
    assert dispatch.coverage(rows, "dataset").first()["seen"] == 2  # the event and the line that inherits its time


def test_side_tables(spark, registry):
    lines = scan.read_dataset(spark, registry, "e3")
    host = lookup.host_metadata(lines, scan.ORDER)
    assert sorted(r["dst"] for r in graph.host_addresses(host).collect()) == ["10.0.0.9", "fe80::1"]
    who = lookup.principal_metadata(lines, scan.ORDER).first()
    assert (who["username"], who["group_ids"]) == ("root", ["0", "1"])


def test_raw_metrics(spark, registry):
    lines = scan.read_dataset(spark, registry, "e3")
    counts = {r["event_type"]: r["count"] for r in ingest.raw_event_counts(lines, "e3").collect()}
    assert counts == {"EVENT_READ": 1, "EVENT_WRITE": 1}
    text = json.dumps({"action": "CREATE", "hostname": "h", "object": "PROCESS", "properties": {"command_line": "x 1.2.3.4"}}, separators=(",", ":"))
    rows = spark.createDataFrame([(0, 0, i, T0 + i, text) for i in (5, 6)], "file_rank int, block long, mid long, ts_ns long, value string")
    row = ingest.raw_ledger(rows, "optc", "aia_51_75").first()
    assert (row["host_id"], row["command"], row["first_seen"], row["n_events"]) == ("h", "x <IP>", T0 + 5, 2)
    assert ingest.raw_event_counts(rows, "optc").first()["event_type"] == "PROCESS_CREATE"


def test_attack_windows(spark, registry, tmp_path):
    rows = dispatch.common_records(ingest.classified_records(spark, registry, "e3", "theia")).cache()
    objects = ingest.object_lookup(spark, registry, "e3", "theia")
    windows = spark.createDataFrame(
        [("e3", "theia", "h", uid(900), "3.2 Drop", "2018-04-06 03:30:00", "2018-04-06 03:40:00"), ("e3", "theia", "h", None, "1", "2018-04-06 03:30:00", "2018-04-06 03:40:00"), ("e3", "trace", "t", uid(901), "1", "2018-04-06 03:30:00", "2018-04-06 03:40:00")],
        "dataset string, sub_dataset string, host string, host_uuid string, report_sec string, start_edt string, end_edt string",
    )
    made = attacks.slices(attacks.timed_windows(windows.where("sub_dataset = 'theia'")))
    assert made.count() == 1
    labels = spark.createDataFrame([("e3", "theia", "PM", uid(n).lower(), s) for n, s in ((1, None), (10, None), (11, None), (77, None), (10, "3.2"), (11, "9"))], "dataset string, sub_dataset string, source string, uuid string, section string")
    got = {r["skip_reason"]: r for r in attacks.coverage_table(windows, labels, objects, rows, made).collect()}
    assert set(got) == {None, "missing_host_uuid", "no_matching_instance"}
    r = got[None]
    assert [r[c] for c in ("l0", "l1", "l2", "l3a", "l3b", "l4")] == [4, 3, 3, 3, 2, 2] and r["total_nodes"] == 2
    assert (r["pct_of_labelset"], r["base_rate"], r["local_base_rate"]) == (0.5, 1.0, 1.0)
    sinks.write_graph(graph.nodes(rows), graph.event_edges(rows), str(tmp_path), "s")
    nodes, edges = sinks.read_graph(spark, str(tmp_path), "s")
    assert edges.count() == 2 and sinks.duplicate_keys(nodes, ["label", "uuid"]).count() == 0
    assert sinks.merge_metrics([spark.range(2).withColumnRenamed("id", "host_id"), spark.range(1, 3).withColumnRenamed("id", "host_id").withColumn("x", F.lit(1))]).count() == 3
