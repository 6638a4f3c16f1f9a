"""Registered queries over stored results, attack windows, names and ranks, beside those of ``queries`` and ``rawlog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import temporary_path
from ..functions.timeutil import partition_by_time, relative_bin, week_hours
from ..operators import attacks, coverage, dispatch, graph, regularity, volume
from ..sources import sinks
from ..sources.labels import section_key
from . import rawlog
from .cache import Cache
from .queries import CUBE_SQL, DAY, E_SQL, LEDGER_SQL, ORACLES, STATS_SQL, T_SQL, WIDTH, _cube, _events, _ledger, _table, _tensor_events, register
from .rawlog import FILE, HOST, LOOKUP_SQL, PROCESS, RECORDS_SQL, SOCKET, uid, uid_sql

FROM, TO = 1_704_067_200_000_000, 1_706_745_600_000_000


@register(f"""SELECT host_id, max(n) AS n_bins, min(d) AS least, max(d) AS most FROM (SELECT host_id, count(*) OVER (PARTITION BY host_id) AS n, time_bin - lag(time_bin) OVER (PARTITION BY host_id ORDER BY time_bin) AS d
  FROM (SELECT DISTINCT host_id, time_bin FROM ({CUBE_SQL}))) GROUP BY host_id""")
def bin_distances(spark, sf_dir):
    """W-04."""
    return volume.bin_distances(_cube(spark, sf_dir)).groupBy("host_id").agg(F.count("*").alias("n_bins"), F.min("d").alias("least"), F.max("d").alias("most"))


@register(f"""SELECT event_id, CASE WHEN ts >= {FROM + 5 * DAY} AND (ts - {FROM + 5 * DAY}) // {DAY} < 11 THEN (ts - {FROM + 5 * DAY}) // {DAY} END AS bin FROM ({E_SQL})""")
def relative_bins(spark, sf_dir):
    """P-12."""
    start = FROM + 5 * DAY
    return _events(spark, sf_dir).select("event_id", relative_bin(F.col("ts"), start, start + 10 * DAY, DAY).alias("bin"))


@register(f"SELECT event_id, round((ts - epoch_us(date_trunc('week', make_timestamp(ts)))) / 3600000000.0, 6) AS hours FROM ({E_SQL})")
def weekday_hours(spark, sf_dir):
    """W-10."""
    return _events(spark, sf_dir).select("event_id", F.round(week_hours(F.col("ts") * 1000), 6).alias("hours"))


@register("SELECT p_partkey, nullif(regexp_extract(trim(p_size || '.' || (p_partkey % 7) || ' ' || p_name), '^(\\d+(?:\\.\\d+)*)', 1), '') AS section FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 3 = 0")
def section_keys(spark, sf_dir):
    """P-19."""
    number = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string"))
    report = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", number, "p_name"))
    return _table(spark, sf_dir, "part").select("p_partkey", section_key(report).alias("section"))


@register("SELECT n_nationkey, 'e3_part_' || n_nationkey || '__' || n_regionkey || '__' || n_name AS name, 'e3' AS dataset, 'part_' || n_nationkey AS sub_dataset, CAST(n_regionkey AS VARCHAR) AS start, n_name AS \"end\" FROM nation")
def slice_names(spark, sf_dir):
    """P-20, K-11: names of slices and their parts again."""
    n = F.col("n_nationkey")
    name = graph.slice_name(F.lit("e3"), F.concat(F.lit("part_"), n.cast("string")), F.col("n_regionkey"), F.col("n_name"))
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", name.alias("name"))
    return rows.select("n_nationkey", "name", *[c.alias(k) for k, c in graph.parse_slice_name(F.col("name")).items()])


@register("SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey % 4 <> 0")
def slices_to_make(spark, sf_dir):
    """G-15."""
    rows = _table(spark, sf_dir, "nation")
    return graph.new_slices(rows.select("n_nationkey", "n_regionkey"), rows.where("n_nationkey % 4 = 0"), ["n_nationkey"])


@register("""SELECT p_partkey, CASE WHEN length(t) > 12 THEN '…' || right(t, 11) ELSE t END AS text FROM (SELECT p_partkey, coalesce(nullif(CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN concat_ws(':', '10.0.0.' || p_size, p_size) ELSE CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END END, ''), 'u' || p_partkey) AS t FROM part)""")
def node_texts(spark, sf_dir):
    """P-21."""
    k = F.col("p_partkey") % 4
    label = F.when(k == 0, "Process").when(k == 1, "Socket").otherwise("File")
    path = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_name"))
    text = graph.node_label(label, F.col("p_type"), F.concat(F.lit("10.0.0."), F.col("p_size").cast("string")), F.col("p_size"), path, F.concat(F.lit("u"), F.col("p_partkey").cast("string")), 12)
    return _table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


@register(f"""WITH s AS (SELECT 'd' || lpad(CAST(r AS VARCHAR), 2, '0') AS name, {FROM} + r * {DAY} AS a, {FROM} + (r + 2) * {DAY} AS b FROM range(0, 30, 1) t(r))
SELECT event_id, (SELECT min(name) FROM s WHERE ts >= a AND ts + 600000000 <= b) AS slice FROM ({E_SQL}) WHERE event_type = 'error'""")
def holding_slices(spark, sf_dir):
    """J-11: the first of the two-day slices that holds each ten-minute window."""
    part = lambda rows: rows.withColumns({"dataset": F.lit("e3"), "sub_dataset": F.lit("x")})
    days = part(spark.range(30).select(F.concat(F.lit("d"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("name"), (F.col("id") * DAY + FROM).alias("start"), ((F.col("id") + 2) * DAY + FROM).alias("end")))
    windows = part(_events(spark, sf_dir).where("event_type = 'error'").select("event_id", F.col("ts").alias("start"), (F.col("ts") + 600_000_000).alias("end")))
    return coverage.containing_slice(windows, days).select("event_id", "slice")


@register(f"""SELECT host_id, n_bins_total, n_gaps, timespan_days, events_per_s FROM ({ORACLES['gaps_per_host']}) FULL JOIN ({ORACLES['timespan_per_host']}) USING (host_id) FULL JOIN ({ORACLES['volumetrics']}) USING (host_id)""")
def metric_table(spark, sf_dir):
    """J-14, K-10: metrics of each host side by side."""
    cube = _cube(spark, sf_dir)
    tables = [volume.gaps(cube, WIDTH), volume.timespan(cube, DAY), volume.volumetrics(cube, ("click", "view", "purchase"), 1_000_000, WIDTH)]
    return sinks.merge_metrics(tables).select("host_id", "n_bins_total", "n_gaps", "timespan_days", "events_per_s")


@register(f"""SELECT slice, count(*) AS n FROM (SELECT least((ts - {FROM}) // (({TO} - {FROM}) // 7), 6) AS slice FROM ({E_SQL}) WHERE ts >= {FROM} AND ts < {TO}) GROUP BY slice""")
def sliced_counts(spark, sf_dir):
    """S-12: events in each of seven slices of equal width."""
    slices = F.array(*[F.struct(F.lit(i).cast("long").alias("slice"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(partition_by_time(FROM, TO, 7))])
    rows = _events(spark, sf_dir).select("ts", F.explode(slices).alias("s")).where("ts >= s.a and ts < s.b")
    return rows.groupBy("s.slice").agg(F.count("*").alias("n"))


@register(f"""WITH n AS (SELECT host_id, node, CAST(first_bin % 3 AS INT) AS component, CAST(degree AS DOUBLE) AS weight FROM ({STATS_SQL}))
SELECT host_id, component, node, rank, round(share, 9) AS share FROM (SELECT *, weight / sum(weight) OVER w AS share, CAST(row_number() OVER (w ORDER BY weight DESC, node) AS INT) AS rank FROM n WINDOW w AS (PARTITION BY host_id, component)) WHERE rank <= 3""")
def component_top_nodes(spark, sf_dir):
    """O-04: three nodes of most weight of each component, a report's size."""
    stats = regularity.node_stats(_tensor_events(spark, sf_dir), "host_id")
    rows = stats.select("host_id", "node", (F.col("first_bin") % 3).cast("int").alias("component"), F.col("degree").cast("double").alias("weight"))
    return regularity.top_nodes(rows).select("host_id", "component", "node", "rank", F.round("share", 9).alias("share"))


SWEEP_SQL = "SELECT l_returnflag AS host_id, l_linenumber AS rank, round(avg(l_discount), 6) AS rel_error, CAST(100 - l_linenumber * 12 AS DOUBLE) AS core_consistency, round(100 * (1 - avg(l_tax)), 6) AS explained_pct FROM lineitem GROUP BY ALL"


def _sweep_rows(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("host_id"), F.col("l_linenumber").alias("rank"))
    return rows.agg(F.round(F.avg("l_discount"), 6).alias("rel_error"), F.round(100 * (1 - F.avg("l_tax")), 6).alias("explained_pct")).withColumn("core_consistency", (100 - F.col("rank") * 12).cast("double"))


@register(f"""WITH s AS ({SWEEP_SQL}) SELECT host_id, coalesce(arg_min(rank, (rel_error, rank)) FILTER (core_consistency >= 50), 1) AS least_error_rank, coalesce(max(rank) FILTER (core_consistency >= 50), min(rank)) AS last_rank,
  max(explained_pct) FILTER (rank <= 25) AS best_explained_pct FROM s GROUP BY host_id""")
def sweep_choices(spark, sf_dir):
    """N-06, N-10, O-08: which rank a sweep's table speaks for, by least error and as the last consistent one."""
    table = _sweep_rows(spark, sf_dir)
    return regularity.select_rank(table).withColumnRenamed("rank", "least_error_rank").join(regularity.select_consistent_rank(table).withColumnRenamed("rank", "last_rank"), "host_id").select("host_id", "least_error_rank", "last_rank", "best_explained_pct")


@register(f"WITH s AS ({SWEEP_SQL}) SELECT host_id, rank AS component, rel_error AS relevance, CAST(row_number() OVER (PARTITION BY host_id ORDER BY rel_error DESC, rank) AS INT) AS place FROM s")
def component_order(spark, sf_dir):
    """O-07: components by relevance."""
    rows = _sweep_rows(spark, sf_dir).select("host_id", F.col("rank").alias("component"), F.col("rel_error").alias("relevance"))
    return regularity.ordered_components(rows)


@register(f"SELECT uuid, role, path FROM ({LOOKUP_SQL})")
def stored_lookup(spark, sf_dir):
    """K-01: the lookup as read back from its table, written twice."""
    root, table = temporary_path(spark, "lookups"), rawlog._lookup(spark, sf_dir)
    for _ in range(2):
        sinks.write_lookup(table, root, "e3", "theia")
    return sinks.read_lookup(spark, root, "e3", "theia").select("uuid", "role", "path")


@register(f"SELECT host_id, command, n_events FROM ({LEDGER_SQL})")
def cached_ledger(spark, sf_dir):
    """K-05, K-06: a result built once, then read; ``fresh`` builds anew."""
    cache, built = Cache(spark, temporary_path(spark, "cache")), []

    def build():
        built.append(1)
        return _ledger(spark, sf_dir)

    for fresh in (False, False, True):
        rows = cache.get("FirstSeenLedger", "all", build, fresh)
    if len(built) != 2 or not cache.has("FirstSeenLedger", "all"):
        raise AssertionError("the cache is to build twice")
    return rows.select("host_id", "command", "n_events")


@register(f"SELECT host_id, count(*) AS n FROM ({E_SQL}) GROUP BY host_id")
def resumed_sweep(spark, sf_dir):
    """K-09: a table made in two goes, the second of which only adds groups that are not there."""
    cache = Cache(spark, temporary_path(spark, "cache"))
    rows = _events(spark, sf_dir).groupBy("host_id").agg(F.count("*").alias("n"))
    cache.append_new(rows.where("host_id % 3 = 0"), "Sweep", "all", ["host_id"])
    return cache.append_new(rows, "Sweep", "all", ["host_id"])


@register(f"SELECT host_id, n_gaps, gap_pct FROM ({ORACLES['gaps_per_host']})")
def csv_report(spark, sf_dir):
    """K-08, K-10: a report as CSV, read back."""
    path = temporary_path(spark, "report")
    sinks.write_csv(volume.gaps(_cube(spark, sf_dir), WIDTH), path)
    return spark.read.csv(path, header=True, inferSchema=True).select("host_id", F.col("n_gaps").cast("long").alias("n_gaps"), F.col("gap_pct").cast("double").alias("gap_pct"))


@register(r"""SELECT replace(replace(drop_reason, '_', '\_'), '%', '\%') || ' & ' || replace(raw_event_type, '_', '\_') || ' & ' || n || ' \\' AS value FROM ("""  # noqa: ISC003
          + ORACLES["cdm_drop_log"] + ")")
def latex_drop_log(spark, sf_dir):
    """K-07: the drop log as table rows, written and read back."""
    path = temporary_path(spark, "latex")
    rows = dispatch.drop_log(rawlog._classified(spark, sf_dir)).select("drop_reason", "raw_event_type", "n")
    sinks.write_latex(rows, path)
    return spark.read.text(path)


@register(f"""SELECT source, uuid FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY uuid) AS r FROM (
  SELECT l.source, f.uuid FROM ({LOOKUP_SQL}) f, (VALUES ('PM', 2), ('FL', 3)) l(source, m) WHERE f.role = 'FILE' AND CAST(right(f.uuid, 12) AS INT) % l.m = 0 AND CAST(right(f.uuid, 12) AS INT) >= 40)) WHERE r <= 5""")
def excluded_objects(spark, sf_dir):
    """O-05: labelled objects without a node, five of each source (a report's size)."""
    objects = rawlog._lookup(spark, sf_dir).where("role = 'FILE'")
    key = F.substring("uuid", -12, 12).cast("long")
    labels = objects.withColumn("source", F.explode(F.array(F.lit("PM"), F.lit("FL")))).where(key % F.when(F.col("source") == "PM", 2).otherwise(3) == 0).select("source", "uuid")
    return coverage.exclusions(labels, objects.select("uuid"), objects.where(key < 40).select("uuid"), ["source"], 5).select("source", "uuid")


@register("""SELECT 'union' AS what, count(*) AS n FROM (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0)
UNION ALL SELECT 'intersection', count(*) FROM (SELECT doc_id FROM labels WHERE toxic = 1 INTERSECT SELECT doc_id FROM documents WHERE lang = 'en') UNION ALL SELECT 'difference', count(*) FROM (SELECT doc_id FROM labels WHERE quality = 0 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1)""")
def set_counts(spark, sf_dir):
    """T-01, T-02, T-03: sizes of a union, an intersection and a difference of label sets."""
    labels, docs = _table(spark, sf_dir, "labels"), _table(spark, sf_dir, "documents")
    toxic, junk, english = labels.where("toxic = 1").select("doc_id"), labels.where("quality = 0").select("doc_id"), docs.where("lang = 'en'").select("doc_id")
    sets = {"union": toxic.union(junk).distinct(), "intersection": toxic.intersect(english), "difference": junk.subtract(toxic)}
    out = None
    for what, rows in sets.items():
        row = rows.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
        out = row if out is None else out.union(row)
    return out


_WINDOWS = [(n, f"3.{n} step", f"2024-01-{4 + 3 * n:02d} 08:00:00", f"2024-01-{6 + 3 * n:02d} 20:30:00") for n in range(7)]
_HOUR_NS = 3_600_000_000_000
_W_SQL = ", ".join(
    f"({n}, {'NULL' if n == 5 else uid_sql(HOST, str(n))}, '3.{n}', epoch_us(TIMESTAMP '{a}') * 1000 + 5 * {_HOUR_NS}, epoch_us(TIMESTAMP '{b}') * 1000 + 5 * {_HOUR_NS})" for n, _, a, b in _WINDOWS
)
#: Slices as (name, first day, last day) since 2024-01-01.
_SLICES = [("s0", 0, 9), ("s1", 8, 19)]
_S_SQL = ", ".join(f"('{name}', {FROM * 1000 + a * 24 * _HOUR_NS}, {FROM * 1000 + b * 24 * _HOUR_NS})" for name, a, b in _SLICES)


@register(f"""WITH r AS ({RECORDS_SQL}), w(n, host_uuid, section, a, b) AS (VALUES {_W_SQL}), s(slice, sa, sb) AS (VALUES {_S_SQL}),
p AS (SELECT *, (SELECT min(slice) FROM s WHERE w.a >= sa AND w.b <= sb) AS slice FROM w), u AS (SELECT p.*, sa, sb FROM p JOIN s USING (slice) WHERE host_uuid IS NOT NULL),
l AS (SELECT 'PM' AS source, NULL AS section, {uid_sql(FILE, 'p_partkey')} AS uuid FROM part WHERE p_partkey < 150 AND p_partkey % 2 = 0
  UNION ALL SELECT 'WW', '3.' || (s_suppkey % 4), {uid_sql(SOCKET, 's_suppkey')} FROM supplier WHERE s_suppkey < 100),
wl AS (SELECT DISTINCT u.n, l.source, l.uuid FROM u JOIN l ON l.section IS NULL OR l.section = u.section),
t AS (SELECT DISTINCT o.host_id, r.ts_ns, unnest([r.subject_uuid, r.object_uuid]) AS uuid FROM (SELECT DISTINCT subject_uuid, host_id FROM r) o JOIN r USING (subject_uuid)),
h AS (SELECT u.n, t.uuid, bool_or(ts_ns >= sa AND ts_ns < sb) AS in_slice, bool_or(ts_ns >= a AND ts_ns < b) AS in_window FROM u JOIN t ON t.host_id = u.host_uuid GROUP BY ALL),
g AS (SELECT subject_uuid AS uuid FROM r UNION SELECT object_uuid FROM r UNION SELECT host_id FROM r UNION SELECT user_principal FROM r),
f AS (SELECT wl.n, wl.source, count(*) AS l0, count(*) FILTER (wl.uuid IN (SELECT uuid FROM ({LOOKUP_SQL}))) AS l1, count(*) FILTER (wl.uuid IN (SELECT uuid FROM g)) AS l2, count(h.uuid) AS l3a, count(*) FILTER (h.in_slice) AS l3b, count(*) FILTER (h.in_window) AS l4
  FROM wl LEFT JOIN h ON h.n = wl.n AND h.uuid = wl.uuid GROUP BY ALL),
c AS (SELECT n, count(*) FILTER (in_window) AS total FROM h GROUP BY n), m AS (SELECT h.n, count(*) AS hit FROM h WHERE in_window AND (h.n, h.uuid) IN (SELECT (n, uuid) FROM wl) GROUP BY h.n)
SELECT u.n, CAST(NULL AS VARCHAR) AS skip_reason, f.source, l0, l1, l2, l3a, l3b, l4, coalesce(total, 0) AS total_nodes, round(l4 / nullif(l0, 0), 6) AS pct_of_labelset, round(l4 / nullif(coalesce(total, 0), 0), 6) AS base_rate, round(coalesce(hit, 0) / nullif(coalesce(total, 0), 0), 6) AS local_base_rate
FROM u LEFT JOIN f USING (n) LEFT JOIN c USING (n) LEFT JOIN m USING (n)
UNION ALL SELECT n, CASE WHEN host_uuid IS NULL THEN 'missing_host_uuid' ELSE 'no_matching_instance' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p WHERE host_uuid IS NULL OR slice IS NULL""")
def attack_coverage(spark, sf_dir):
    """A-20, A-29, J-05 to J-11, T-04, T-06: label coverage of seven windows, two of which can't be measured."""
    part = lambda rows: rows.withColumns({"dataset": F.lit("e3"), "sub_dataset": F.lit("theia")})
    rows = [(n, None if n == 5 else f"{HOST}-0000-0000-0000-{n:012d}", sec, a, b) for n, sec, a, b in _WINDOWS]
    windows = part(spark.createDataFrame(rows, "n int, host_uuid string, report_sec string, start_edt string, end_edt string"))
    slices = part(spark.createDataFrame([(name, FROM * 1000 + a * 24 * _HOUR_NS, FROM * 1000 + b * 24 * _HOUR_NS) for name, a, b in _SLICES], "name string, start long, end long"))
    parts, sup = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "supplier")
    pm = parts.where("p_partkey < 150 and p_partkey % 2 = 0").select(F.lit("PM").alias("source"), F.lit(None).cast("string").alias("section"), uid(FILE, F.col("p_partkey")).alias("uuid"))
    ww = sup.where("s_suppkey < 100").select(F.lit("WW").alias("source"), F.concat(F.lit("3."), (F.col("s_suppkey") % 4).cast("string")).alias("section"), uid(SOCKET, F.col("s_suppkey")).alias("uuid"))
    records = dispatch.common_records(rawlog._classified(spark, sf_dir))
    out = attacks.coverage_table(windows, part(pm.union(ww)), rawlog._lookup(spark, sf_dir), records, slices)
    return out.select("n", "skip_reason", "source", "l0", "l1", "l2", "l3a", "l3b", "l4", "total_nodes", "pct_of_labelset", "base_rate", "local_base_rate")


FLOW_SQL = f"""SELECT {uid_sql(HOST, 'u % 25')} AS host_id, kind AS event_type, count(*) AS n FROM ({rawlog.X_SQL}) WHERE ts_ns > 0 AND kind IN ('EVENT_READ', 'EVENT_WRITE', 'EVENT_EXECUTE') GROUP BY ALL"""


@register(FLOW_SQL)
def information_flow_counts(spark, sf_dir):
    """P-13: only the types that carry information."""
    return volume.information_flow(rawlog.ingest.raw_event_counts(rawlog._lines(spark, sf_dir), "e3"), "cdm").groupBy("host_id", "event_type").agg(F.sum("count").alias("n"))


COLLAPSE_SQL = f"""WITH RECURSIVE e AS (SELECT event_id, ts // {DAY} * {DAY} AS bin, host_id FROM ({E_SQL})),
c(node, here) AS (SELECT event_id, event_id FROM e UNION ALL SELECT c.node, c.here // 2 FROM c WHERE c.here // 2 <> c.here AND c.here // 2 IN (SELECT event_id FROM e)),
t AS (SELECT node, min(here) AS top FROM c GROUP BY node)"""


@register(COLLAPSE_SQL + " SELECT bin, CAST(top AS VARCHAR) AS src, 'h' || host_id AS dst FROM e JOIN t ON t.node = e.event_id")
def collapsed_events(spark, sf_dir):
    """N-13, J-04: events as processes whose parent is half their id, each for the top of its chain."""
    return regularity.collapse_ephemeral(*_short_lived(spark, sf_dir), 2)[0].select("bin", "src", "dst")


@register(COLLAPSE_SQL + """, g AS (SELECT top, count(*) AS size FROM t GROUP BY top HAVING count(*) > 1) SELECT (SELECT count(*) FROM e) AS n_candidates, (SELECT count(*) FROM t WHERE top <> node) AS n_collapsed, 0 AS n_self_loops_dropped, (SELECT count(*) FROM g) AS n_groups, (SELECT coalesce(max(size), 0) FROM g) AS max_group_size""")
def collapse_report(spark, sf_dir):
    """N-13: its diagnostics."""
    events, nodes = _short_lived(spark, sf_dir)
    remap = regularity.collapse_ephemeral(events, nodes, 2)[1]
    return regularity.collapse_diagnostics(events, nodes, 2, remap)


def _short_lived(spark, sf_dir):
    rows = _events(spark, sf_dir)
    name = lambda c: F.col(c).cast("string")
    events = rows.select((F.col("ts") - F.pmod(F.col("ts"), F.lit(DAY))).alias("bin"), name("event_id").alias("src"), F.concat(F.lit("h"), name("host_id")).alias("dst"))
    return events, rows.select(name("event_id").alias("node"), F.floor(F.col("event_id") / 2).cast("long").cast("string").alias("parent"), F.lit("PROCESS").alias("role"))
