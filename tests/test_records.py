"""From raw records to lookup, edges, graph and drop log."""

import json

import pytest
from pyspark.sql import functions as F

from auditloom.operators import dispatch, graph, lookup

ORDER = ["mid"]


def uid(n):
    return f"{n:08X}-0000-0000-0000-{n:012X}"


def cdm(kind, body, short=False, host=None):
    name = kind if short else f"com.bbn.tc.schema.avro.cdm18.{kind}"
    return json.dumps({"datum": {name: body}, "CDMVersion": "18", "source": "S"} | ({"hostId": host} if host else {}), separators=(",", ":"))


def event(n, kind, subject, obj, **more):
    body = {"uuid": uid(n), "type": kind, "timestampNanos": n, "hostId": uid(900).lower()}
    if subject is not None:
        body["subject"] = {"com.bbn.tc.schema.avro.cdm18.UUID": subject}
    if obj is not None:
        body["predicateObject"] = {"UUID": obj}
    return cdm("Event", body | more)


OBJECTS = [
    cdm("Subject", {"uuid": uid(1), "type": "SUBJECT_PROCESS", "cid": 0, "cmdLine": {"string": ""}, "parentSubject": None, "localPrincipal": uid(50)}),
    cdm("Subject", {"uuid": uid(1), "type": "SUBJECT_PROCESS", "cid": 77, "cmdLine": {"string": "bash"}, "localPrincipal": {"UUID": uid(51)}}),
    cdm("Subject", {"uuid": uid(2), "type": "SUBJECT_THREAD", "cid": 78, "parentSubject": {"UUID": uid(1)}}),
    cdm("Subject", {"uuid": uid(3), "type": "SUBJECT_UNIT", "parentSubject": {"UUID": uid(2)}}, short=True) + ",",
    cdm("FileObject", {"uuid": uid(10).lower(), "type": "FILE_OBJECT_FILE", "baseObject": {"properties": {"map": {"filename": "/etc/passwd"}}}}),
    cdm("NetFlowObject", {"uuid": uid(11), "localAddress": "10.0.0.1", "localPort": 5, "remoteAddress": {"string": "NA"}, "remotePort": {"int": 443}}),
    cdm("RegistryKeyObject", {"uuid": uid(12), "key": "HKLM"}),
    cdm("Host", {"uuid": uid(900), "hostName": "h"}),
    cdm("MemoryObject", {"uuid": uid(13)}),
]
EVENTS = [
    (event(101, "EVENT_READ", uid(3), uid(10)), None),
    (event(102, "EVENT_SENDTO", uid(1), uid(11), size={"long": 9}), None),
    (event(103, "EVENT_FLOWS_TO", uid(1), uid(10)), "ABSTRACT_FLOW"),
    (event(104, "EVENT_READ", None, uid(10)), "INVERTED_SUBJECT"),
    (event(105, "EVENT_READ", "xyz", uid(10)), "PARSE_ERROR"),
    (event(106, "EVENT_READ", uid(99), uid(10)), "OBJECT_TYPE_UNRESOLVABLE"),
    (event(107, "EVENT_READ", uid(10), uid(10)), "INVERTED_SUBJECT"),
    (event(108, "EVENT_READ", uid(1), None), "NULL_OBJECT"),
    (event(109, "EVENT_READ", uid(1), "0F"), "PARSE_ERROR"),
    (event(110, "EVENT_READ", uid(1), uid(13)), "OBJECT_TYPE_UNRESOLVABLE"),
    (event(111, "EVENT_FORK", uid(1), uid(10)), "NON_PROVENANCE_EVENT"),
    (event(112, "EVENT_FORK", uid(1), uid(2)), None),
    (event(113, "EVENT_EXECUTE", uid(1), uid(10), predicateObjectPath={"string": "/bin/x"}), None),
    (cdm("Event", {"type": "EVENT_READ", "subject": {"UUID": uid(1)}, "predicateObject": {"UUID": uid(10)}}), "PARSE_ERROR"),
    (OBJECTS[0], "RECORD_IS_NOT_EVENT"),
    ('{"datum":', "PARSE_ERROR"),
]


@pytest.fixture(scope="module")
def objects(spark):
    lines = spark.createDataFrame(list(enumerate(OBJECTS)), "mid long, value string")
    return lookup.object_lookup(lookup.cdm_mentions(lines, ORDER), ORDER).cache()


@pytest.fixture(scope="module")
def classified(spark, objects):
    lines = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(EVENTS)], "ts_ns long, value string")
    return dispatch.classify_cdm(lines, objects, "e3", "theia").cache()


def test_lookup_merges_first_truthy_and_last(objects):
    got = {r["uuid"]: r.asDict() for r in objects.collect()}
    assert set(got) == {uid(n) for n in (1, 2, 3, 10, 11, 12)}
    one = got[uid(1)]
    assert (one["pid"], one["cmdline"], one["principal_uuid"], one["role"], one["types_raw"]) == (77, "bash", uid(51), "PROCESS", "SUBJECT_PROCESS")
    assert (got[uid(10)]["path"], got[uid(10)]["role"]) == ("/etc/passwd", "FILE")
    assert (got[uid(11)]["ip"], got[uid(11)]["port"], got[uid(11)]["role"]) == ("NA", 443, "SOCKET")
    assert got[uid(12)]["path"] == "HKLM"


def test_threads_resolve_to_their_process(objects):
    got = {r["node"]: (r["resolved"], r["hops"]) for r in lookup.process_map(objects).collect()}
    assert got == {uid(1): (uid(1), 0), uid(2): (uid(1), 1), uid(3): (uid(1), 2)}


def test_chain_ends_on_loops_and_depth(spark):
    rows = spark.createDataFrame([(1, 1), (2, 3), (3, 2), *[(i, i - 1) for i in range(11, 40)]], "n long, p long")
    got = {r["node"]: (r["resolved"], r["hops"]) for r in lookup.resolve_chain(rows, "n", "p", F.lit(False), 10).collect()}
    assert got[1] == (1, 0) and got[2][1] == 10 and got[39] == (29, 10) and got[12] == (10, 2)


def test_guards(classified):
    got = {r["ts_ns"]: r["drop_reason"] for r in classified.collect()}
    assert [got[i] for i in range(len(EVENTS))] == [want for _, want in EVENTS]


def test_edges(classified):
    got = {r["edge_uuid"]: r for r in dispatch.common_records(classified).collect()}
    read, send, run = (got[uid(n)] for n in (101, 102, 113))
    assert (read["subject_uuid"], read["object_uuid"], read["pid"], read["host_id"]) == (uid(1), uid(10), 77, uid(900))
    assert (send["edge_category"], send["object_ip"], send["object_port"], send["size_bytes"]) == ("SEND", "NA", 443, 9)
    assert (run["edge_category"], run["object_role"], run["object_path"], run["cmdline"]) == ("EXECUTE", "EXECUTABLE", "/bin/x", "bash")


def test_seen_is_kept_plus_dropped(classified):
    c = dispatch.coverage(classified, "dataset").first()
    assert (c["seen"], c["kept"], c["dropped"]) == (len(EVENTS), 4, len(EVENTS) - 4)
    assert dispatch.drop_log(classified).agg(F.sum("n")).first()[0] == c["dropped"]


def test_graph(classified):
    records = dispatch.common_records(classified)
    nodes = {(r["label"], r["uuid"]): r for r in graph.nodes(records).collect()}
    assert nodes["Process", uid(1)]["cmdline"] == "bash" and ("IPAddress", "NA") in nodes and ("File", uid(10)) in nodes and ("Executable", uid(10)) in nodes
    kinds = {r["rel_type"] for r in graph.structural_edges(records).collect()}
    assert kinds == {"hasExe", "hasUser", "originatesFrom", "hasSocketIP"}
    ends = {r["edge_uuid"]: (r["src"], r["dst"]) for r in graph.event_edges(records).collect()}
    assert ends[uid(101)] == (uid(10), uid(1)) and ends[uid(102)] == (uid(1), uid(11))


def test_ecar(spark):
    def row(n, action, kind, actor, obj, **props):
        return json.dumps({"action": action, "actorID": actor, "hostname": "h1", "id": uid(n), "object": kind, "objectID": obj, "pid": 4, "ppid": 1, "principal": "u", "properties": props, "tid": 1, "timestamp": "2019-09-17T11:00:00Z"})

    rows = [
        (row(1, "READ", "FILE", uid(7).lower(), uid(20), file_path="/a"), None),
        (row(2, "LOAD", "MODULE", uid(7), uid(20), file_path="/m"), None),
        (row(3, "START", "FLOW", uid(7), uid(21), dest_ip="", src_ip="1.2.3.4", dest_port="0"), None),
        (row(4, "RENAME", "FILE", uid(7), uid(20)), "NON_PROVENANCE_EVENT"),
        (row(5, "READ", "FILE", "", uid(20)), "INVERTED_SUBJECT"),
        (row(6, "READ", "FILE", uid(7), ""), "NULL_OBJECT"),
        (row(7, "READ", "FILE", uid(7), "zz"), "PARSE_ERROR"),
    ]
    lines = spark.createDataFrame([(i, i, v) for i, (v, _) in enumerate(rows)], "mid long, ts_ns long, value string")
    objects = lookup.object_lookup(lookup.ecar_mentions(lines, ORDER), ORDER)
    both = {r["uuid"]: r for r in objects.collect()}[uid(20)]
    assert (both["types_raw"], both["role"], both["ambiguous"]) == ("FILE,MODULE", "FILE", False)
    got = {r["ts_ns"]: r for r in dispatch.classify_ecar(lines, objects, "optc", "x").collect()}
    assert [got[i]["drop_reason"] for i in range(len(rows))] == [want for _, want in rows]
    assert got[2]["object_ip"] == "1.2.3.4" and got[0]["subject_uuid"] == uid(7) and got[1]["edge_category"] == "EXECUTE"


def test_merge_is_idempotent(spark):
    rows = spark.createDataFrame([("h", 0, 10), ("h", 10, 12), ("h", 20, 30), ("h", 22, 24)], "h string, a long, b long")
    once = graph.merge_intervals(rows, ["h"], "a", "b")
    assert sorted((r["start"], r["end"], r["n"]) for r in once.collect()) == [(0, 12, 2), (20, 30, 2)]
    assert graph.merge_intervals(once, ["h"], "start", "end").count() == 2


def test_slice_names(spark):
    row = spark.range(1).select(graph.slice_name(F.lit("e3"), F.lit("theia"), F.lit("a"), F.lit("b")).alias("n"))
    parts = row.select(*[c.alias(k) for k, c in graph.parse_slice_name(F.col("n")).items()]).first()
    assert parts.asDict() == {"dataset": "e3", "sub_dataset": "theia", "start": "a", "end": "b"}
