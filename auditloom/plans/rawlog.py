"""Registered queries over raw logs: files are written from the driver's tables, then read back like any log.

``events`` gives event lines (2,500 a file; two of three have no time of their
own), ``customer`` processes and threads, ``part`` files, ``supplier`` sockets,
``nation`` hosts and users. Faults are planted by arithmetic on ids, so SQL can
say what must come out without reading a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records
from ..functions.shared import materialize, temporary_path
from ..operators import dispatch, graph, lookup
from ..sources import labels as label_files_
from ..sources import scan
from . import ingest
from .queries import E_SQL, _events, _table, register

FILE_EVENTS = 2500
KINDS = {"view": "EVENT_READ", "purchase": "EVENT_WRITE", "click": "EVENT_EXECUTE", "error": "EVENT_FLOWS_TO", "signup": "EVENT_OPEN"}
PROCESS, FILE, SOCKET, HOST, USER, EVENT = "C0000000", "F0000000", "A0000000", "D0000000", "B0000000", "E0000000"
_written: dict[tuple[str, str, str], str] = {}
_tables: dict[tuple[str, str, str], DataFrame] = {}


def uid(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-0000-0000-0000-"), F.lpad(key.cast("string"), 12, "0"))


def uid_sql(prefix: str, key: str) -> str:
    return f"'{prefix}-0000-0000-0000-' || lpad(CAST({key} AS VARCHAR), 12, '0')"


def _name(kind: str) -> str:
    return f"com.bbn.tc.schema.avro.cdm18.{kind}"


def _line(kind: str, *fields: Column) -> list[Column]:
    body = F.struct(F.struct(*fields).alias(_name(kind))).alias("datum")
    return [body, F.lit("18").alias("CDMVersion"), F.lit("SOURCE_TEST").alias("source")]


def _ref(name: str, uuid: Column) -> Column:
    return F.when(uuid.isNotNull(), F.struct(uuid.alias(_name("UUID")))).alias(name)


def _text(name: str, value: Column, kind: str = "string") -> Column:
    return F.when(value.isNotNull(), F.struct(value.alias(kind))).alias(name)


def _cdm_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, i, u, k = _events(spark, sf_dir), F.col("event_id"), F.col("host_id"), F.col("k")
    kind = F.lit(None).cast("string")
    for name, value in KINDS.items():
        kind = F.when(F.col("event_type") == name, value).otherwise(kind)
    subject = F.when(i % 13 != 0, F.when(u % 7 == 0, uid(FILE, u)).otherwise(uid(PROCESS, u)))
    obj = F.when(i % 17 == 0, F.lit(None)).when(i % 19 == 0, "zz").when(i % 2 == 0, uid(FILE, k)).otherwise(uid(SOCKET, k))
    command = F.when(kind == "EVENT_EXECUTE", F.struct(F.struct(F.concat(F.lit("tool --pid "), k.cast("string")).alias("cmdLine")).alias("map"))).alias("properties")
    fields = [uid(EVENT, i).alias("uuid"), _text("sequence", i, "long"), kind.alias("type"), _ref("subject", subject), _ref("predicateObject", obj),
              _text("predicateObjectPath", F.when(i % 5 == 0, F.concat(F.lit("/x/"), k.cast("string")))), F.when(i % 3 == 0, F.col("ts") * 1000).alias("timestampNanos"),
              _text("size", F.floor("value").cast("long"), "long"), command, uid(HOST, u % 25).alias("hostId")]
    return rows.select(F.floor(i / FILE_EVENTS).cast("int").alias("_file"), i.alias("_at"), *_line("Event", *fields))


def _cdm_objects(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    people, parts, sup, nations = (_table(spark, sf_dir, t) for t in ("customer", "part", "supplier", "nation"))
    c, p, s, n = F.col("c_custkey"), F.col("p_partkey"), F.col("s_suppkey"), F.col("n_nationkey")
    thread = c % 3 == 0
    subjects = people.where((c < 150) & (c % 11 != 0)).select(c.alias("_at"), *_line(
        "Subject", uid(PROCESS, c).alias("uuid"), F.when(thread, "SUBJECT_THREAD").otherwise("SUBJECT_PROCESS").alias("type"), c.alias("cid"),
        _ref("parentSubject", F.when(thread, uid(PROCESS, c + 1))), _ref("localPrincipal", uid(USER, F.col("c_nationkey"))), _text("cmdLine", F.col("c_name"))))
    # Three mentions: an empty path, the path, another one; every ninth has a second type.
    times = parts.where((p < 150) & (p % 10 != 0)).withColumn("t", F.explode(F.array(*map(F.lit, range(3)))))
    path = F.when(F.col("t") == 0, F.lit("")).when(F.col("t") == 1, F.concat(F.lit("/part/"), p.cast("string"))).otherwise(F.concat(F.lit("/other/"), p.cast("string")))
    kind = F.when((p % 9 == 0) & (F.col("t") == 2), "FILE_OBJECT_UNIX_SOCKET").otherwise("FILE_OBJECT_FILE")
    base = F.struct(F.struct(F.struct(path.alias("path")).alias("map")).alias("properties")).alias("baseObject")
    files = times.select((p * 3 + F.col("t")).alias("_at"), *_line("FileObject", uid(FILE, p).alias("uuid"), kind.alias("type"), base))
    sockets = sup.where((s < 100) & (s % 10 != 0)).select(s.alias("_at"), *_line(
        "NetFlowObject", uid(SOCKET, s).alias("uuid"), _text("localAddress", F.concat(F.lit("10.0.0."), s.cast("string"))),
        _text("remoteAddress", F.concat(F.lit("192.168.0."), s.cast("string"))), _text("remotePort", (s + 1000).cast("int"), "int")))
    address = F.struct(F.array(F.concat(F.lit("10.1.0."), n.cast("string")), F.concat(F.lit("fe80::"), n.cast("string"), F.lit("%eth0"))).alias("array"))
    face = F.array(F.struct(F.lit("eth0").alias("name"), F.lit("aa:bb").alias("macAddress"), address.alias("ipAddresses")))
    hosts = nations.select(n.cast("long").alias("_at"), *_line("Host", uid(HOST, n).alias("uuid"), F.col("n_name").alias("hostName"), F.lit("HOST_DESKTOP").alias("hostType"), _text("osDetails", F.concat(F.lit("os "), n.cast("string"))), F.struct(face.alias("array")).alias("interfaces")))
    users = nations.select(n.cast("long").alias("_at"), *_line("Principal", uid(USER, n).alias("uuid"), n.cast("string").alias("userId"), _text("username", F.col("n_name")), F.struct(F.array(F.lit("g0"), n.cast("string")).alias("array")).alias("groupIds")))
    return [subjects, files, sockets, hosts, users]


def _ecar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, i, u, k = _events(spark, sf_dir), F.col("event_id"), F.col("host_id"), F.col("k")
    action = F.when(F.col("event_type") == "view", "READ").when(F.col("event_type") == "purchase", "WRITE").when(F.col("event_type") == "click", "LOAD").when(F.col("event_type") == "error", "RENAME").otherwise("START")
    kind = F.when(action == "LOAD", "MODULE").when(action == "START", "FLOW").otherwise("FILE")
    props = F.struct(
        F.when(kind != "FLOW", F.concat(F.lit("/f/"), k.cast("string"))).alias("file_path"), F.when(kind == "FLOW", F.concat(F.lit("10.2.0."), k.cast("string"))).alias("dest_ip"),
        F.when(kind == "FLOW", (k + 1).cast("string")).alias("dest_port"), F.floor("value").cast("string").alias("size"), F.concat(F.lit("run --port "), k.cast("string")).alias("command_line"),
    )
    fields = [
        action.alias("action"), F.when(i % 13 == 0, "").otherwise(uid(PROCESS, u)).alias("actorID"), F.concat(F.lit("h"), (u % 25).cast("string")).alias("hostname"), uid(EVENT, i).alias("id"),
        kind.alias("object"), F.when(i % 17 == 0, "").when(i % 19 == 0, "zz").when(kind == "FLOW", uid(SOCKET, k)).otherwise(uid(FILE, k)).alias("objectID"),
        u.alias("pid"), F.concat(F.lit("u"), (u % 3).cast("string")).alias("principal"), props.alias("properties"), F.date_format(F.timestamp_micros("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
    ]
    return rows.select(F.floor(i / FILE_EVENTS).cast("int").alias("_file"), i.alias("_at"), *fields)


def _write(rows: DataFrame, path: str) -> None:
    """One file for each ``_file``, lines in order."""
    n = (rows.agg(F.max("_file")).first()[0] or 0) + 1
    rows = rows.repartitionById(n, "_file").sortWithinPartitions("_at").drop("_file", "_at")
    rows.write.mode("append").json(path)


def fixture(spark: SparkSession, sf_dir: str, dataset: str) -> str:
    """Root of the written logs ``<root>/<dataset>/<part>/*.json``; written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, dataset)
    if key not in _written:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        root = temporary_path(spark, "rawlog")
        if dataset == "optc":
            _write(_ecar_lines(spark, sf_dir), f"{root}/optc/aia_51_75")
        else:
            for rows in _cdm_objects(spark, sf_dir):
                _write(rows.withColumn("_file", F.lit(0)), f"{root}/e3/theia")
            _write(_cdm_events(spark, sf_dir), f"{root}/e3/theia")
        _written[key] = root
    return _written[key]


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table that several queries start from, written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        _tables[key] = materialize(make(), name)
    return _tables[key]


def registry(spark: SparkSession, sf_dir: str, dataset: str = "e3") -> DataFrame:
    """The fixture's files with their metadata; gathered once a session."""
    return _once(spark, sf_dir, f"registry-{dataset}", lambda: scan.annotated_registry(spark, fixture(spark, sf_dir, dataset), dataset))


def _lines(spark: SparkSession, sf_dir: str, dataset: str = "e3", **options) -> DataFrame:
    return scan.read_dataset(spark, scan.subset(registry(spark, sf_dir, dataset), dataset), dataset, **options)


def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "lookup", lambda: ingest.object_lookup(spark, registry(spark, sf_dir), "e3", "theia"))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "classified", lambda: ingest.classified_records(spark, registry(spark, sf_dir), "e3", "theia"))


def _number(value: Column) -> Column:
    return records.found(value, r'"sequence":\{"long":(\d+)').cast("long")


_KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " END"
X_SQL = f"""SELECT event_id AS id, event_id // {FILE_EVENTS} AS file, host_id AS u, k, value, {_KIND_SQL} AS kind, ts * 1000 AS true_ns,
  CASE WHEN event_id % 13 <> 0 THEN CASE WHEN host_id % 7 = 0 THEN {uid_sql(FILE, 'host_id')} ELSE {uid_sql(PROCESS, 'host_id')} END END AS subject,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 'ZZ' WHEN event_id % 2 = 0 THEN {uid_sql(FILE, 'k')} ELSE {uid_sql(SOCKET, 'k')} END AS object,
  coalesce(last_value(CASE WHEN event_id % 3 = 0 THEN ts * 1000 END IGNORE NULLS) OVER (PARTITION BY event_id // {FILE_EVENTS} ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS ts_ns
FROM ({E_SQL})"""
LOOKUP_SQL = f"""SELECT {uid_sql(PROCESS, 'c_custkey')} AS uuid, CASE WHEN c_custkey % 3 = 0 THEN 'SUBJECT_THREAD' ELSE 'SUBJECT_PROCESS' END AS types_raw, c_name AS path, CAST(NULL AS VARCHAR) AS ip, CAST(NULL AS INT) AS port,
  c_name AS cmdline, CAST(c_custkey AS INT) AS pid, CASE WHEN c_custkey % 3 = 0 THEN {uid_sql(PROCESS, 'c_custkey + 1')} END AS parent_uuid, {uid_sql(USER, 'c_nationkey')} AS principal_uuid, 'PROCESS' AS role, false AS ambiguous
  FROM customer WHERE c_custkey < 150 AND c_custkey % 11 <> 0
UNION ALL SELECT {uid_sql(FILE, 'p_partkey')}, CASE WHEN p_partkey % 9 = 0 THEN 'FILE_OBJECT_FILE,FILE_OBJECT_UNIX_SOCKET' ELSE 'FILE_OBJECT_FILE' END, '/part/' || p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, 'FILE', p_partkey % 9 = 0
  FROM part WHERE p_partkey < 150 AND p_partkey % 10 <> 0
UNION ALL SELECT {uid_sql(SOCKET, 's_suppkey')}, 'NetFlowObject', '10.0.0.' || s_suppkey, '192.168.0.' || s_suppkey, CAST(1000 + s_suppkey AS INT), NULL, NULL, NULL, NULL, 'SOCKET', false
  FROM supplier WHERE s_suppkey < 100 AND s_suppkey % 10 <> 0"""
CDM_SQL = f"""WITH l AS ({LOOKUP_SQL}), x AS ({X_SQL}),
j AS (SELECT x.*, s.uuid AS s_uuid, s.types_raw AS s_types, o.uuid AS o_uuid, o.types_raw AS o_types, o.role AS o_role, o.path AS o_path, o.ip AS o_ip, o.port AS o_port,
    CASE WHEN s.types_raw = 'SUBJECT_THREAD' THEN s.parent_uuid ELSE s.uuid END AS acting
  FROM x LEFT JOIN l s ON s.uuid = x.subject LEFT JOIN l o ON o.uuid = x.object),
e AS (SELECT j.*, p.pid, p.cmdline, p.principal_uuid,
    CASE WHEN kind = 'EVENT_READ' AND o_role = 'FILE' THEN 'READ' WHEN kind = 'EVENT_READ' AND o_role = 'SOCKET' THEN 'RECV' WHEN kind = 'EVENT_WRITE' AND o_role = 'FILE' THEN 'WRITE'
      WHEN kind = 'EVENT_WRITE' AND o_role = 'SOCKET' THEN 'SEND' WHEN kind = 'EVENT_EXECUTE' AND o_role = 'FILE' THEN 'EXECUTE' END AS edge
  FROM j LEFT JOIN l p ON p.uuid = j.acting)
SELECT *, CASE WHEN kind = 'EVENT_FLOWS_TO' THEN 'ABSTRACT_FLOW' WHEN subject IS NULL THEN 'INVERTED_SUBJECT' WHEN s_uuid IS NULL THEN 'OBJECT_TYPE_UNRESOLVABLE' WHEN s_types NOT LIKE 'SUBJECT%' THEN 'INVERTED_SUBJECT'
    WHEN object IS NULL THEN 'NULL_OBJECT' WHEN object = 'ZZ' THEN 'PARSE_ERROR' WHEN o_uuid IS NULL THEN 'OBJECT_TYPE_UNRESOLVABLE' WHEN edge IS NULL THEN 'NON_PROVENANCE_EVENT' END AS reason,
  CASE WHEN kind = 'EVENT_FLOWS_TO' OR subject IS NULL THEN NULL WHEN s_uuid IS NULL THEN 'subject_missing' WHEN s_types NOT LIKE 'SUBJECT%' THEN s_types
    WHEN object IS NULL OR object = 'ZZ' THEN NULL WHEN o_uuid IS NULL THEN 'not_in_filtered_lookup' WHEN edge IS NULL THEN o_types END AS detail
FROM e"""
RECORDS_SQL = f"""SELECT ts_ns, edge AS edge_category, CASE edge WHEN 'EXECUTE' THEN 'EXECUTABLE' WHEN 'READ' THEN 'FILE' WHEN 'WRITE' THEN 'FILE' ELSE 'SOCKET' END AS object_role, {uid_sql(EVENT, 'id')} AS edge_uuid,
  acting AS subject_uuid, object AS object_uuid, {uid_sql(HOST, 'u % 25')} AS host_id, CASE WHEN id % 5 = 0 THEN '/x/' || k ELSE o_path END AS object_path, o_ip AS object_ip, o_port AS object_port, pid,
  CAST(floor(value) AS BIGINT) AS size_bytes, CASE WHEN edge = 'EXECUTE' THEN coalesce(cmdline, 'tool --pid ' || k) ELSE cmdline END AS cmdline, principal_uuid AS user_principal, kind AS raw_event_type, o_types AS raw_object_type, s_types AS raw_subject_type
FROM ({CDM_SQL}) WHERE reason IS NULL"""


@register(LOOKUP_SQL)
def cdm_lookup(spark, sf_dir):
    """A-03, A-04, A-05, P-02, P-03, S-16: the object lookup of raw lines."""
    return _lookup(spark, sf_dir).select("uuid", "types_raw", "path", "ip", "port", "cmdline", "pid", "parent_uuid", "principal_uuid", "role", "ambiguous")


@register(f"SELECT role, count(*) AS n, count_if(ambiguous) AS n_ambiguous FROM ({LOOKUP_SQL}) GROUP BY role")
def cdm_role_statistics(spark, sf_dir):
    """A-06."""
    return lookup.role_statistics(lookup.cdm_mentions(_lines(spark, sf_dir), scan.ORDER), scan.ORDER)


@register(RECORDS_SQL)
def cdm_records(spark, sf_dir):
    """S-01, S-02, S-11, S-13, S-14, S-16, P-01, P-04, P-06, J-01, J-03: kept records of the raw files."""
    return dispatch.common_records(_classified(spark, sf_dir)).drop("dataset", "sub_dataset")


@register(f"""SELECT 'e3' AS dataset, 'theia' AS sub_dataset, reason AS drop_reason, kind AS raw_event_type, coalesce(detail, '') AS drop_detail, count(*) AS n FROM ({CDM_SQL}) WHERE reason IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'e3', 'theia', 'RECORD_IS_NOT_EVENT', 'Subject', '', count(*) FROM customer WHERE c_custkey < 150 AND c_custkey % 11 <> 0
UNION ALL SELECT 'e3', 'theia', 'RECORD_IS_NOT_EVENT', 'FileObject', '', 3 * count(*) FROM part WHERE p_partkey < 150 AND p_partkey % 10 <> 0
UNION ALL SELECT 'e3', 'theia', 'RECORD_IS_NOT_EVENT', 'NetFlowObject', '', count(*) FROM supplier WHERE s_suppkey < 100 AND s_suppkey % 10 <> 0
UNION ALL SELECT 'e3', 'theia', 'RECORD_IS_NOT_EVENT', k, '', count(*) FROM nation, (VALUES ('Host'), ('Principal')) v(k) GROUP BY k""")
def cdm_drop_log(spark, sf_dir):
    """A-01, P-04, P-06: why lines have no edge."""
    return dispatch.drop_log(_classified(spark, sf_dir))


@register(f"""SELECT {uid_sql(HOST, 'u % 25')} AS host_id, ts_ns // 300000000000 * 300000000000 AS time_bin, kind AS event_type, count(*) AS count FROM ({X_SQL}) WHERE ts_ns > 0 GROUP BY ALL""")
def raw_event_cube(spark, sf_dir):
    """A-07, P-08, P-10, S-17: the count cube by pattern alone."""
    return ingest.raw_event_counts(_lines(spark, sf_dir), "e3")


@register(f"""SELECT {uid_sql(HOST, 'u % 25')} AS host_id, 'tool --pid <PID>' AS command, min(first_seen) AS first_seen, CAST(sum(n) AS BIGINT) AS n_events FROM (
  SELECT u % 25 AS u, k, arg_min(ts_ns, id) AS first_seen, count(*) AS n FROM ({X_SQL}) WHERE kind = 'EVENT_EXECUTE' AND ts_ns > 0 GROUP BY ALL) GROUP BY u""")
def raw_command_ledger(spark, sf_dir):
    """A-08, A-09, P-09, P-15, P-16: first-seen ledger of raw lines, normalised."""
    return ingest.raw_ledger(_lines(spark, sf_dir), "e3", "theia")


T_FROM, T_TO = 1_704_500_000_000_000_000, 1_705_500_000_000_000_000


@register(f"SELECT id AS event_id, ts_ns FROM ({X_SQL}) WHERE ts_ns >= {T_FROM} AND ts_ns < {T_TO}")
def raw_window(spark, sf_dir):
    """S-03, S-06, S-08, S-13: lines of a half-open window, from the files that may overlap it."""
    rows = _lines(spark, sf_dir, start=T_FROM, end=T_TO)
    return rows.select(_number(F.col("value")).alias("event_id"), "ts_ns").where("event_id is not null")


@register(f"""SELECT id AS event_id, ts_ns FROM (SELECT *, max(ts_ns) OVER (PARTITION BY file ORDER BY id ROWS UNBOUNDED PRECEDING) AS latest FROM ({X_SQL})) WHERE latest < {T_TO}""")
def raw_early_exit(spark, sf_dir):
    """S-04: what a reader sees that leaves a file at its first time past the end."""
    rows = scan.window_lines(_lines(spark, sf_dir), None, T_TO, stop_early=True)
    return rows.select(_number(F.col("value")).alias("event_id"), "ts_ns").where("event_id is not null")


@register(f"""SELECT id AS event_id, ts_ns FROM (SELECT *, min(CASE WHEN ts_ns > 0 THEN ts_ns END) OVER (PARTITION BY file) AS t0 FROM ({X_SQL})) WHERE ts_ns > 0 AND ts_ns <= t0 + 3600000000000""")
def raw_first_hour(spark, sf_dir):
    """S-07, W-12: each file's first hour."""
    rows = _lines(spark, sf_dir, seconds=3600)
    return rows.select(_number(F.col("value")).alias("event_id"), "ts_ns").where("event_id is not null")


@register(f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY id) AS up, row_number() OVER (PARTITION BY file ORDER BY id DESC) AS down FROM ({X_SQL})),
s AS (SELECT *, CASE WHEN id % 3 = 0 THEN true_ns END AS t FROM x WHERE up <= 50 OR down <= 50)
SELECT min(id) AS min_sequence, max(id) AS max_sequence, min(t) AS first_timestamp_ns, max(t) AS last_timestamp_ns, min(t) AS first_realistic_ts_ns, true AS likely_ordered,
  CASE WHEN max(t % 1000) > 0 THEN 'nanoseconds' WHEN max(t % 1000000) > 0 THEN 'microseconds' WHEN max(t % 1000000000) > 0 THEN 'milliseconds' ELSE 'seconds' END AS resolution,
  'upper' AS uuid_case, 'SOURCE_TEST' AS source, false AS trailing_comma, true AS wrapped FROM s GROUP BY file""")
def raw_file_metadata(spark, sf_dir):
    """S-09, S-09a to S-09f: a row for each event file from its first and last 50 lines."""
    paths = [r["path"] for r in scan.file_registry(spark, fixture(spark, sf_dir, "e3")).orderBy("path").select("path").collect()]
    lines = scan.read_lines(spark, paths)
    rows = scan.file_metadata(lines, records.own_timestamp(F.col("value"), "e3"), sample=50).where("min_sequence is not null")
    return rows.select("min_sequence", "max_sequence", "first_timestamp_ns", "last_timestamp_ns", "first_realistic_ts_ns", "likely_ordered", "resolution", "uuid_case", "source", "trailing_comma", "wrapped")


@register(f"""SELECT 'e3' AS dataset, 'theia' AS sub_dataset, count(DISTINCT file) + 5 AS n_files, count(*) FILTER (id % 3 = 0) AS n_int_nanos, count(*) FILTER (id % 3 <> 0) AS n_none FROM ({X_SQL})""")
def raw_registry(spark, sf_dir):
    """S-09e, S-09g, S-10, S-18: files by data set, and how event lines write their time."""
    files = scan.file_registry(spark, fixture(spark, sf_dir, "e3"))
    paths = [r["path"] for r in files.orderBy("path").select("path").collect()]
    kind = scan.timestamp_kind(F.col("value"))
    kinds = scan.read_lines(spark, paths).where(_number(F.col("value")).isNotNull()).agg(F.count_if(kind == "int_nanos").alias("n_int_nanos"), F.count_if(kind == "none").alias("n_none"))
    return scan.subset(files, "E3").groupBy("dataset", "sub_dataset").agg(F.count("*").alias("n_files")).join(kinds)  # one row each


@register(f"""WITH x AS ({X_SQL}), f AS (SELECT file, min(true_ns) AS t FROM x WHERE id % 3 = 0 GROUP BY file)
SELECT CAST(row_number() OVER (ORDER BY t) - 1 AS INT) AS file_rank, t AS first_realistic_ts_ns FROM f""")
def raw_file_order(spark, sf_dir):
    """O-01, O-02, S-08: files in sequence, those without times last."""
    rows = scan.select_files(registry(spark, sf_dir)).where("first_realistic_ts_ns is not null")
    return rows.select("file_rank", "first_realistic_ts_ns")


NODES_SQL = f"""SELECT label, uuid, count(*) AS n FROM (
  SELECT 'Process' AS label, subject_uuid AS uuid FROM ({RECORDS_SQL}) UNION ALL SELECT 'Host', host_id FROM ({RECORDS_SQL}) UNION ALL SELECT 'User', user_principal FROM ({RECORDS_SQL}) WHERE user_principal IS NOT NULL
  UNION ALL SELECT CASE object_role WHEN 'FILE' THEN 'File' WHEN 'SOCKET' THEN 'Socket' ELSE 'Executable' END, object_uuid FROM ({RECORDS_SQL})
  UNION ALL SELECT 'IPAddress', object_ip FROM ({RECORDS_SQL}) WHERE edge_category IN ('SEND', 'RECV')) GROUP BY ALL"""
META_SQL = f"""SELECT 'Host' AS label, {uid_sql(HOST, 'n_nationkey')} AS uuid, n_name AS name, 'HOST_DESKTOP' AS kind, 'os ' || n_nationkey AS details FROM nation
UNION ALL SELECT 'User', {uid_sql(USER, 'n_nationkey')}, n_name, CAST(n_nationkey AS VARCHAR), 'g0,' || n_nationkey FROM nation
UNION ALL SELECT 'IPAddress', '10.1.0.' || n_nationkey, NULL, NULL, NULL FROM nation UNION ALL SELECT 'IPAddress', 'fe80::' || n_nationkey, NULL, NULL, NULL FROM nation"""


@register(META_SQL)
def graph_metadata(spark, sf_dir):
    """G-02, G-09, P-18: Host, User and IPAddress nodes from metadata records."""
    lines = _lines(spark, sf_dir)
    return graph.metadata_nodes(lookup.host_metadata(lines, scan.ORDER), lookup.principal_metadata(lines, scan.ORDER))


@register(f"""SELECT 'node' AS kind, label AS name, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_distinct FROM ({NODES_SQL}) GROUP BY label
UNION ALL SELECT 'edge', CASE edge_category WHEN 'EXECUTE' THEN 'isExecutedBy' WHEN 'READ' THEN 'isReadBy' WHEN 'WRITE' THEN 'writes' WHEN 'SEND' THEN 'sends' ELSE 'isReceivedBy' END, count(*), count(DISTINCT subject_uuid || object_uuid) FROM ({RECORDS_SQL}) GROUP BY edge_category""")
def graph_build(spark, sf_dir):
    """G-04, G-10, G-11, K-02: one call from raw files to a stored graph; its statistics."""
    return ingest.build_graph(spark, registry(spark, sf_dir), "e3", "theia", temporary_path(spark, "graphs"))


STORED_SQL = f"""SELECT rel_type, count(*) AS n, count(ts_ns) AS n_timed FROM (
  SELECT CASE edge_category WHEN 'EXECUTE' THEN 'isExecutedBy' WHEN 'READ' THEN 'isReadBy' WHEN 'WRITE' THEN 'writes' WHEN 'SEND' THEN 'sends' ELSE 'isReceivedBy' END AS rel_type, ts_ns FROM ({RECORDS_SQL})
  UNION ALL SELECT rel_type, NULL FROM (SELECT DISTINCT 'hasExe' AS rel_type, subject_uuid, object_uuid FROM ({RECORDS_SQL}) WHERE edge_category = 'EXECUTE'
    UNION SELECT 'hasUser', subject_uuid, user_principal FROM ({RECORDS_SQL}) WHERE user_principal IS NOT NULL UNION SELECT 'originatesFrom', subject_uuid, host_id FROM ({RECORDS_SQL})
    UNION SELECT 'hasSocketIP', object_uuid, object_ip FROM ({RECORDS_SQL}) WHERE edge_category IN ('SEND', 'RECV') AND object_ip IS NOT NULL)
  UNION ALL SELECT 'hasHostIP', NULL FROM nation, (VALUES (1), (2))) GROUP BY rel_type"""


@register(STORED_SQL)
def graph_stored_edges(spark, sf_dir):
    """K-03, G-05 to G-09: edges read back from the stored graph."""
    from ..sources import sinks

    root = temporary_path(spark, "graphs")
    ingest.build_graph(spark, registry(spark, sf_dir), "e3", "theia", root)
    return sinks.read_graph(spark, root, "e3_theia____")[1].groupBy("rel_type").agg(F.count("*").alias("n"), F.count("ts_ns").alias("n_timed"))


@register(f"""WITH n AS (SELECT uuid FROM ({NODES_SQL})), q AS (SELECT {uid_sql(FILE, 'range')} AS uuid FROM range(200))
SELECT q.uuid, q.uuid IN (SELECT uuid FROM ({LOOKUP_SQL})) AS in_lookup, q.uuid IN (SELECT uuid FROM n) AS in_graph FROM q""")
def present_and_existing(spark, sf_dir):
    """J-02, J-07: which of 200 uuids the lookup has, and which the graph."""
    asked = spark.range(200).select(F.lower(uid(FILE, F.col("id"))).alias("uuid"))
    here = lookup.present(asked, _lookup(spark, sf_dir)).withColumn("in_lookup", F.lit(True))
    upper = asked.select(F.upper("uuid").alias("uuid"))
    there = graph.existing(upper, graph.nodes(dispatch.common_records(_classified(spark, sf_dir)))).withColumn("in_graph", F.lit(True))
    rows = upper.join(here.select(F.upper("uuid").alias("uuid"), "in_lookup"), "uuid", "left").join(there, "uuid", "left")
    return rows.select("uuid", F.coalesce("in_lookup", F.lit(False)).alias("in_lookup"), F.coalesce("in_graph", F.lit(False)).alias("in_graph"))


ECAR_SQL = f"""WITH x AS (SELECT event_id AS id, host_id AS u, k, value, ts,
    CASE event_type WHEN 'view' THEN 'READ' WHEN 'purchase' THEN 'WRITE' WHEN 'click' THEN 'LOAD' WHEN 'error' THEN 'RENAME' ELSE 'START' END AS action FROM ({E_SQL})),
y AS (SELECT *, CASE action WHEN 'LOAD' THEN 'MODULE' WHEN 'START' THEN 'FLOW' ELSE 'FILE' END AS object FROM x),
z AS (SELECT *, CASE WHEN id % 17 = 0 THEN '' WHEN id % 19 = 0 THEN 'ZZ' WHEN object = 'FLOW' THEN {uid_sql(SOCKET, 'k')} ELSE {uid_sql(FILE, 'k')} END AS object_uuid FROM y),
t AS (SELECT object_uuid, string_agg(DISTINCT object, ',' ORDER BY object) AS types FROM z GROUP BY object_uuid)
SELECT z.*, t.types, CASE action WHEN 'READ' THEN 'READ' WHEN 'WRITE' THEN 'WRITE' WHEN 'LOAD' THEN 'EXECUTE' WHEN 'START' THEN 'SEND' END AS edge,
  CASE WHEN id % 13 = 0 THEN 'INVERTED_SUBJECT' WHEN z.object_uuid = '' THEN 'NULL_OBJECT' WHEN z.object_uuid = 'ZZ' THEN 'PARSE_ERROR' WHEN action = 'RENAME' THEN 'NON_PROVENANCE_EVENT' END AS reason
FROM z JOIN t USING (object_uuid)"""


def _ecar(spark, sf_dir):
    return ingest.classified_records(spark, registry(spark, sf_dir, "optc"), "optc", "aia_51_75")


@register(f"""SELECT ts // 1000 * 1000000 AS ts_ns, edge AS edge_category, CASE edge WHEN 'EXECUTE' THEN 'EXECUTABLE' WHEN 'SEND' THEN 'SOCKET' ELSE 'FILE' END AS object_role, {uid_sql(EVENT, 'id')} AS edge_uuid, {uid_sql(PROCESS, 'u')} AS subject_uuid, object_uuid,
  'h' || (u % 25) AS host_id, CASE WHEN object <> 'FLOW' THEN '/f/' || k END AS object_path, CASE WHEN object = 'FLOW' THEN '10.2.0.' || k END AS object_ip, CAST(CASE WHEN object = 'FLOW' THEN k + 1 END AS INT) AS object_port,
  CAST(u AS INT) AS pid, CAST(floor(value) AS BIGINT) AS size_bytes, 'u' || (u % 3) AS user_principal, action AS raw_event_type, types AS raw_object_type FROM ({ECAR_SQL}) WHERE reason IS NULL""")
def ecar_records(spark, sf_dir):
    """P-05, S-15, S-16, S-17: kept records of raw eCAR files."""
    rows = dispatch.common_records(_ecar(spark, sf_dir))
    return rows.select("ts_ns", "edge_category", "object_role", "edge_uuid", "subject_uuid", "object_uuid", "host_id", "object_path", "object_ip", "object_port", "pid", "size_bytes", "user_principal", "raw_event_type", "raw_object_type")


@register(f"SELECT 'optc' AS dataset, 'aia_51_75' AS sub_dataset, reason AS drop_reason, action AS raw_event_type, coalesce(CASE WHEN reason = 'NON_PROVENANCE_EVENT' THEN types END, '') AS drop_detail, count(*) AS n FROM ({ECAR_SQL}) WHERE reason IS NOT NULL GROUP BY ALL")
def ecar_drop_log(spark, sf_dir):
    """A-01, P-05."""
    return dispatch.drop_log(_ecar(spark, sf_dir))


@register(f"""SELECT 'h' || (u % 25) AS host_id, 'run --port <PORT>' AS command, min(ts // 1000 * 1000000) AS first_seen, count(*) AS n_events FROM ({ECAR_SQL}) GROUP BY u % 25""")
def ecar_command_ledger(spark, sf_dir):
    """P-09, P-15, P-16 for eCAR, with Windows rules."""
    return ingest.raw_ledger(_lines(spark, sf_dir, "optc"), "optc", "aia_51_75")


def _label_files(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    key = (spark.sparkContext.applicationId, sf_dir, "labels")
    if key not in _written:
        root = temporary_path(spark, "labels")
        ids = _table(spark, sf_dir, "labels").select("doc_id")
        d = F.col("doc_id")
        line = lambda c: c.alias("value")
        ids.where(d % 2 == 0).select(line(F.concat(F.lower(uid(FILE, d)), F.lit(",note, more")))).write.text(f"{root}/pm")
        listed = ids.where(d % 3 == 0).agg(F.to_json(F.sort_array(F.collect_list(uid(FILE, d)))).alias("value"))
        listed.coalesce(1).write.text(f"{root}/fl.json")
        ids.where(d % 5 == 0).select(line(F.concat(F.lit("  "), uid(FILE, d), F.lit(" ")))).write.text(f"{root}/fl.txt")
        chain = F.concat(F.lit("x_"), (d % 4 + 1).cast("string"), F.lit("."), (d % 3).cast("string"), F.lit("_y"))
        ids.where(d % 7 == 0).select(uid(FILE, d).alias(" uuid "), chain.alias("attack_chain")).write.option("header", True).csv(f"{root}/ww")
        ids.where(d % 11 == 0).select(uid(PROCESS, d).alias("actorID"), uid(FILE, d).alias("objectID")).write.json(f"{root}/rv")
        _written[key] = root
    root = _written[key]
    return {"PM": f"{root}/pm", "FL": f"{root}/fl.json", "FL lines": f"{root}/fl.txt", "WW": f"{root}/ww", "RV": f"{root}/rv"}


@register(" UNION ALL ".join(f"SELECT '{s}' AS source, {uid_sql(p, 'doc_id')} AS uuid FROM labels WHERE doc_id % {m} = 0" for s, p, m in (("PM", FILE, 2), ("FL", FILE, 3), ("FL lines", FILE, 5), ("WW", FILE, 7), ("RV", PROCESS, 11), ("RV", FILE, 11))))
def label_files(spark, sf_dir):
    """S-19, S-20, T-05: label files of every kind."""
    out = None
    for source, path in _label_files(spark, sf_dir).items():
        rows = label_files_.load(spark, source.split()[0], path).select(F.lit(source).alias("source"), "uuid")
        out = rows if out is None else out.union(rows)
    return out


@register(f"SELECT {uid_sql(FILE, 'doc_id')} AS uuid, (doc_id % 4 + 1) || '.' || (doc_id % 3) AS section FROM labels WHERE doc_id % 7 = 0")
def label_sections(spark, sf_dir):
    """S-21."""
    return label_files_.labels_by_section(spark, _label_files(spark, sf_dir)["WW"])


@register(f"""SELECT CAST(host_id AS BIGINT) AS pid, sample_ts, syscr - before AS delta FROM (
  SELECT host_id, sample_ts, syscr, lag(syscr) OVER (PARTITION BY host_id ORDER BY sample_ts) AS before FROM (
    SELECT host_id, ts // 3600000000 * 3600.0 AS sample_ts, max(event_id) AS syscr FROM ({E_SQL}) WHERE host_id < 20 GROUP BY ALL)) WHERE before IS NOT NULL""")
def process_counters(spark, sf_dir):
    """S-22, A-25: counters of a file of hourly samples, and their growth."""
    from ..operators import volume

    key = (spark.sparkContext.applicationId, sf_dir, "counters")
    if key not in _written:
        root = temporary_path(spark, "counters")
        hour = F.floor(F.col("ts") / 3_600_000_000) * 3600.0
        rows = _events(spark, sf_dir).where("host_id < 20").groupBy("host_id", hour.alias("sample_ts")).agg(F.max("event_id").alias("syscr"))
        z = F.lit(0)
        rows = rows.select("sample_ts", F.col("host_id").alias("pid"), z.alias("uid"), F.lit("p").alias("comm"), "syscr", *[z.alias(c) for c in ("syscw", "read_bytes", "write_bytes", "rchar", "wchar")])
        # The hadoop writer names files itself; counters are named by hour.
        rows.coalesce(1).write.option("sep", "\t").option("header", True).csv(root)
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in files.listStatus(path):
            if status.getPath().getName().startswith("part-"):
                files.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(f"{root}/io_2024010100.tsv"))
        _written[key] = root
    rows = label_files_.process_io(spark, _written[key], "2024", "2025")
    return volume.counter_deltas(rows, ["pid"], ["sample_ts"], "syscr").select("pid", "sample_ts", F.col("delta").cast("long").alias("delta"))
