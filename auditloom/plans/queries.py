"""Registered queries: the operators applied to the driver's tables.

The tables stand in for audit data: ``events`` is the stream (user = host,
``props.k`` = argument, ``event_id`` = arrival order); ``lineitem``, ``orders``
and ``customer`` give edges; ``labels`` gives label sets; ``pages.url`` gives
strings to normalise. Times are microseconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import categories, textnorm
from ..functions.timeutil import micros, time_bin, time_slices
from ..operators import coverage, disorder, dispatch, evolution, graph, lookup, regimes, regularity, volume

WIDTH, HOUR, DAY = 300_000_000, 3_600_000_000, 86_400_000_000
FLOW = ("click", "view", "purchase")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events")
    return rows.select("event_id", F.col("user_id").alias("host_id"), micros(F.col("ts")).alias("ts"), "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def _cube(spark: SparkSession, sf_dir: str, width: int = WIDTH) -> DataFrame:
    return volume.event_counts(_events(spark, sf_dir), width)


def _command():
    return F.concat(F.col("event_type"), F.lit(" --pid "), F.col("k").cast("string"))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolution.first_seen_ledger(_events(spark, sf_dir), "host_id", _command(), "ts")


def _days(c: str):
    return F.unix_date(F.col(c).cast("date")).cast("long")


def _tensor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return rows.select(F.col("l_returnflag").alias("host_id"), F.floor(_days("l_shipdate") / 30).cast("long").alias("bin"), name("s", "l_suppkey").alias("src"), name("p", "l_partkey").alias("dst"))


E_SQL = "SELECT event_id, user_id AS host_id, epoch_us(ts) AS ts, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"
CUBE_SQL = f"SELECT host_id, ts // {WIDTH} * {WIDTH} AS time_bin, event_type, count(*) AS count FROM ({E_SQL}) GROUP BY ALL"
HOURS_SQL = f"SELECT host_id, ts // {HOUR} * {HOUR} AS time_bin, CAST(count(*) AS BIGINT) AS n FROM ({E_SQL}) GROUP BY ALL"
LEDGER_SQL = f"SELECT host_id, event_type || ' --pid ' || k AS command, min(ts) AS first_seen, count(*) AS n_events FROM ({E_SQL}) WHERE k IS NOT NULL GROUP BY ALL"
CURVE_SQL = f"""SELECT *, sum(n_new) OVER (PARTITION BY host_id ORDER BY time_bin) AS n_cumulative FROM (
  SELECT host_id, first_seen // {WIDTH} * {WIDTH} AS time_bin, count(*) AS n_new FROM ({LEDGER_SQL}) GROUP BY ALL)"""
T_SQL = "SELECT l_returnflag AS host_id, CAST(floor(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) / 30.0) AS BIGINT) AS bin, 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem"
STATS_SQL = f"""SELECT host_id, node, count(*) AS degree, count(DISTINCT bin) AS n_bins, min(bin) AS first_bin, max(bin) AS last_bin FROM (
  SELECT host_id, bin, src AS node FROM ({T_SQL}) UNION ALL SELECT host_id, bin, dst FROM ({T_SQL})) GROUP BY ALL"""


@register(CUBE_SQL)
def event_counts(spark, sf_dir):
    """A-07, P-11."""
    return _cube(spark, sf_dir)


@register(f"""SELECT host_id, n_bins_total, n_bins_with_events, n_bins_total - n_bins_with_events AS n_gaps,
  round(100.0 * (n_bins_total - n_bins_with_events) / n_bins_total, 4) AS gap_pct
FROM (SELECT host_id, (max(time_bin) - min(time_bin)) // {WIDTH} + 1 AS n_bins_total, count(DISTINCT time_bin) AS n_bins_with_events FROM ({CUBE_SQL}) GROUP BY host_id)""")
def gaps_per_host(spark, sf_dir):
    """A-10."""
    return volume.gaps(_cube(spark, sf_dir), WIDTH)


@register(f"SELECT host_id, round((max(time_bin) - min(time_bin)) / {DAY}.0, 2) AS timespan_days FROM ({CUBE_SQL}) GROUP BY host_id")
def timespan_per_host(spark, sf_dir):
    """A-11."""
    return volume.timespan(_cube(spark, sf_dir), DAY)


@register(f"""WITH b AS (SELECT host_id, time_bin, sum(count) AS n, sum(CASE WHEN event_type IN ('click', 'view', 'purchase') THEN count ELSE 0 END) AS f FROM ({CUBE_SQL}) GROUP BY ALL),
d AS (SELECT host_id, d, row_number() OVER (PARTITION BY host_id ORDER BY count(*) DESC, d) AS rn
  FROM (SELECT host_id, time_bin - lag(time_bin) OVER (PARTITION BY host_id ORDER BY time_bin) AS d FROM b) WHERE d IS NOT NULL GROUP BY host_id, d),
m AS (SELECT b.host_id, coalesce(any_value(d.d), {WIDTH}) AS w, avg(n) AS an, stddev_samp(n) AS sn, avg(f) AS af, stddev_samp(f) AS sf FROM b LEFT JOIN d ON d.host_id = b.host_id AND rn = 1 GROUP BY b.host_id)
SELECT host_id, round(an * 1000000 / w, 4) AS events_per_s, round(sn * 1000000 / w, 4) AS events_per_s_std, round(af * 1000000 / w, 4) AS flow_per_s, round(sf * 1000000 / w, 4) AS flow_per_s_std FROM m""")
def volumetrics(spark, sf_dir):
    """A-12, J-13."""
    return volume.volumetrics(_cube(spark, sf_dir), FLOW, 1_000_000, WIDTH)


@register(f"""SELECT host_id, time_bin, CASE event_type WHEN 'view' THEN 'READ' ELSE 'WRITE' END AS event_type, CAST(sum(count) AS BIGINT) AS count
FROM ({CUBE_SQL}) WHERE event_type IN ('view', 'purchase') GROUP BY ALL""")
def rw_collapse(spark, sf_dir):
    """P-14."""
    return volume.rw_collapse(_cube(spark, sf_dir), ["view"], ["purchase"])


@register(f"SELECT host_id, time_bin // (3 * {WIDTH}) * 3 * {WIDTH} AS time_bin, event_type, CAST(sum(count) AS BIGINT) AS count FROM ({CUBE_SQL}) GROUP BY ALL")
def coarse_rebin(spark, sf_dir):
    """W-11."""
    return volume.rebin(_cube(spark, sf_dir), WIDTH, 3)


@register("""SELECT l_returnflag, l_linestatus, n, round(100.0 * n / sum(n) OVER (PARTITION BY l_returnflag), 4) AS pct
FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)""")
def type_percentages(spark, sf_dir):
    """A-15, A-16."""
    return volume.type_percentages(_table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@register("""SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, CAST(grouping(l_returnflag, l_linestatus, l_linenumber) AS BIGINT) AS level
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus, l_linenumber)""")
def type_totals_rollup(spark, sf_dir):
    """A-17."""
    return volume.type_totals(_table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_linenumber")


ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity"]


@register("""WITH r AS (SELECT l_suppkey AS host_id, lag(d) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_quantity) - d AS back
  FROM (SELECT *, epoch_us(l_shipdate) // 1000000 AS d FROM lineitem)),
e AS (SELECT host_id, count(*) AS n_total, count(*) FILTER (back > 0) AS n_errors, avg(back) FILTER (back > 0) AS m, stddev_pop(back) FILTER (back > 0) AS s, max(back) FILTER (back > 0) AS x,
  quantile_cont(back, [0.25, 0.5, 0.75]) FILTER (back > 0) AS p FROM r GROUP BY host_id)
SELECT host_id, n_total, n_errors, round(n_errors / n_total, 6) AS error_rate, round(coalesce(m, 0), 4) AS mean_back, round(coalesce(s, 0), 4) AS std_back, CAST(coalesce(x, 0) AS DOUBLE) AS max_back,
  round(coalesce(p[1], 0), 4) AS p25, round(coalesce(p[2], 0), 4) AS p50, round(coalesce(p[3], 0), 4) AS p75, round(coalesce(p[3] - p[1], 0), 4) AS iqr FROM e""")
def timing_disorder(spark, sf_dir):
    """A-13, W-02, H.7."""
    return disorder.disorder(_table(spark, sf_dir, "lineitem"), "l_suppkey", F.floor(micros(F.col("l_shipdate")) / 1_000_000).cast("long"), ORDER, chunk=F.floor(F.col("l_orderkey") / 5000))


@register(LEDGER_SQL)
def first_seen_ledger(spark, sf_dir):
    """A-08."""
    return _ledger(spark, sf_dir)


@register(f"""SELECT host_id, regexp_replace(command, '(--pid\\s+)\\d+', '\\1<PID>', 'g') AS command, min(first_seen) AS first_seen, CAST(sum(n_events) AS BIGINT) AS n_events
FROM ({LEDGER_SQL}) GROUP BY ALL""")
def normalized_ledger(spark, sf_dir):
    """A-09, P-15."""
    return evolution.normalized_ledger(_ledger(spark, sf_dir), textnorm.normalize(F.col("command"), "e5", "theia"))


@register(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b', '<IP>', 'g'),
  '(--port\s+)\d+', '\1<PORT>', 'g'), '(--pid\s+)\d+', '\1<PID>', 'g'), '[0-9A-Fa-f]{16,}', '<HEXEXPR>', 'g')) AS normal FROM pages""")
def normalized_urls(spark, sf_dir):
    """P-15 over page addresses, with Linux rules."""
    return _table(spark, sf_dir, "pages").select("page_id", textnorm.normalize(F.col("url"), "e3", "trace").alias("normal"))


@register(CURVE_SQL.replace("sum(n_new)", "CAST(sum(n_new)").replace("ORDER BY time_bin) AS", "ORDER BY time_bin) AS BIGINT) AS"))
def saturation_curve(spark, sf_dir):
    """A-22, W-03."""
    return evolution.saturation_curve(_ledger(spark, sf_dir), WIDTH)


@register(f"""WITH c AS ({CURVE_SQL}),
u AS (SELECT host_id, time_bin, max(n_cumulative) OVER w AS total, n_cumulative / max(n_cumulative) OVER w AS y, (time_bin - min(time_bin) OVER w) / nullif(max(time_bin) OVER w - min(time_bin) OVER w, 0) AS x FROM c WINDOW w AS (PARTITION BY host_id)),
a AS (SELECT host_id, total, (y + lag(y) OVER v) / 2 * (x - lag(x) OVER v) AS area FROM u WINDOW v AS (PARTITION BY host_id ORDER BY time_bin))
SELECT host_id, CAST(max(total) AS BIGINT) AS n_commands, count(*) AS n_bins, round(CASE WHEN count(*) <= 1 THEN 1.0 ELSE sum(area) END, 6) AS auc FROM a GROUP BY host_id""")
def saturation_auc(spark, sf_dir):
    """A-21, H.6."""
    return evolution.saturation_auc(_ledger(spark, sf_dir), WIDTH)


@register(f"""WITH h AS ({HOURS_SQL}), e AS (SELECT host_id, min(time_bin) AS a, max(time_bin) AS b FROM h GROUP BY host_id),
g AS (SELECT host_id, unnest(range(a, b + 1, {HOUR})) AS time_bin FROM e),
f AS (SELECT g.host_id, g.time_bin, CAST(coalesce(n, 0) AS BIGINT) AS n FROM g LEFT JOIN h USING (host_id, time_bin))
SELECT *, round(avg(n) OVER (PARTITION BY host_id ORDER BY time_bin ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 4) AS rolling FROM f""")
def rolling_rate(spark, sf_dir):
    """W-05."""
    return volume.rolling_rate(_cube(spark, sf_dir, HOUR), HOUR)


@register(f"""WITH p AS (SELECT host_id, ts - 1800000000 AS a, ts + 1800000000 AS b FROM ({E_SQL}) WHERE event_type = 'error'),
m AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY host_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM p),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY host_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT host_id, min(a) AS start, max(b) AS "end", count(*) AS n FROM i GROUP BY host_id, island""")
def interval_merge(spark, sf_dir):
    """G-14, W-07."""
    rows = _events(spark, sf_dir).where("event_type = 'error'")
    return graph.merge_intervals(rows, ["host_id"], "ts", "ts", 1_800_000_000).drop("island")


@register(f"""SELECT host_id, event_type, event_id, round(greatest(0.0, value - before), 4) AS delta FROM (
  SELECT *, lag(value) OVER (PARTITION BY host_id, event_type ORDER BY event_id) AS before FROM ({E_SQL})) WHERE before IS NOT NULL""")
def counter_deltas(spark, sf_dir):
    """A-25, W-06."""
    rows = volume.counter_deltas(_events(spark, sf_dir), ["host_id", "event_type"], ["event_id"], "value")
    return rows.select("host_id", "event_type", "event_id", F.round("delta", 4).alias("delta"))


DAILY_SQL = f"SELECT event_type AS host_id, ts // {DAY} * {DAY} AS time_bin, CAST(count(*) AS BIGINT) AS n FROM ({E_SQL}) GROUP BY ALL"


def _daily(spark, sf_dir):
    return volume.event_counts(_events(spark, sf_dir).withColumn("host_id", F.col("event_type")), DAY)


@register(f"""WITH b AS ({DAILY_SQL}), v AS (SELECT * FROM b WHERE host_id IN (SELECT host_id FROM b GROUP BY host_id HAVING stddev_pop(n) > 0))
SELECT x.host_id AS host_a, y.host_id AS host_b, count(*) AS n_bins, round(corr(x.n, y.n), 6) AS r FROM v x JOIN v y ON x.time_bin = y.time_bin AND x.host_id < y.host_id GROUP BY ALL""")
def fleet_correlation(spark, sf_dir):
    """A-26, J-17."""
    return volume.fleet_correlation(_daily(spark, sf_dir))


@register(f"SELECT time_bin, count(*) AS n_hosts, round(quantile_cont(n, 0.5), 4) AS median_n FROM ({DAILY_SQL}) GROUP BY time_bin")
def fleet_median(spark, sf_dir):
    """A-27."""
    return volume.fleet_median(_daily(spark, sf_dir))


@register(f"SELECT event_type, event_id, sample FROM (SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS INT) AS sample FROM ({E_SQL})) WHERE sample <= 3")
def first_three_samples(spark, sf_dir):
    """A-28, W-09: the feature is a sample of three."""
    return disorder.first_samples(_events(spark, sf_dir), ["event_type"], ["event_id"]).select("event_type", "event_id", "sample")


_PROGRAMS = ("bash", "firefox", "grep", "gcc", "apt-get", "ssh", "sendmail", "systemd", "unknown-tool", "-zsh")


def _programs(spark, sf_dir):
    program = F.element_at(F.array(*[F.lit(x) for x in _PROGRAMS]), (F.col("event_id") % len(_PROGRAMS) + 1).cast("int"))
    command = F.concat(F.when(F.col("event_id") % 2 == 0, F.lit("/usr/bin/")).otherwise(F.lit("")), program, F.lit(" -x"))
    return _events(spark, sf_dir).select("host_id", categories.category(categories.basename(command)).alias("category"))


PROGRAMS_SQL = f"""SELECT host_id, CASE event_id % 10 WHEN 0 THEN 'Shells & sessions' WHEN 1 THEN 'GUI / desktop apps' WHEN 2 THEN 'Coreutils & text' WHEN 3 THEN 'Dev / build / IDE'
  WHEN 4 THEN 'Package management' WHEN 5 THEN 'Remote access & file transfer' WHEN 6 THEN 'Mail & messaging' WHEN 7 THEN 'System services & daemons'
  WHEN 9 THEN 'Shells & sessions' ELSE 'Other' END AS category FROM ({E_SQL})"""


@register(f"SELECT category, count(*) AS n FROM ({PROGRAMS_SQL}) GROUP BY category")
def category_breakdown(spark, sf_dir):
    """P-17, A-24."""
    return _programs(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


@register(f"""WITH w AS (SELECT event_type AS host_id, category, count(*) AS weight FROM (SELECT e.event_type, p.category FROM ({E_SQL}) e JOIN (SELECT event_id, host_id, category FROM (
  SELECT event_id, host_id, {PROGRAMS_SQL.split('host_id, ', 1)[1].split(' FROM (')[0]} FROM ({E_SQL}))) p USING (event_id)) GROUP BY ALL),
n(position, category) AS (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(categories.ORDER))}),
g AS (SELECT h.host_id, n.position, n.category FROM (SELECT DISTINCT host_id FROM w) h CROSS JOIN n)
SELECT g.host_id, g.position, g.category, CAST(coalesce(weight, 0) AS BIGINT) AS weight, round(coalesce(weight, 0) / sum(coalesce(weight, 0)) OVER (PARTITION BY g.host_id), 6) AS share
FROM g LEFT JOIN w USING (host_id, category)""")
def category_shares(spark, sf_dir):
    """A-23."""
    program = F.element_at(F.array(*[F.lit(x) for x in _PROGRAMS]), (F.col("event_id") % len(_PROGRAMS) + 1).cast("int"))
    rows = _events(spark, sf_dir).select(F.col("event_type").alias("host_id"), categories.category(categories.basename(program)).alias("category"))
    return volume.category_shares(rows.groupBy("host_id", "category").agg(F.count("*").alias("weight")), categories.ORDER)


def _records(spark, sf_dir):
    """Order lines as edges: order = process, part = object, flag = category, nation = host, customer = user."""
    items, orders, people = (_table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    rows = items.join(orders, items.l_orderkey == orders.o_orderkey).join(people, orders.o_custkey == people.c_custkey)
    kind = F.when(F.col("l_returnflag") == "A", "READ").when(F.col("l_returnflag") == "R", "WRITE").when(F.col("l_linestatus") == "O", "SEND").otherwise("EXECUTE")
    role = F.when(kind.isin("READ", "WRITE"), "FILE").when(kind == "SEND", "SOCKET").otherwise("EXECUTABLE")
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return rows.select(
        micros(F.col("l_shipdate")).alias("ts_ns"), kind.alias("edge_category"), role.alias("object_role"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")]).alias("edge_uuid"),
        text("o", "l_orderkey").alias("subject_uuid"), text("p", "l_partkey").alias("object_uuid"), text("n", "c_nationkey").alias("host_id"),
        F.when(kind != "SEND", text("/part/", "l_partkey")).alias("object_path"), F.when(kind == "SEND", text("10.0.0.", "l_suppkey")).alias("object_ip"), F.col("l_linenumber").alias("object_port"),
        F.lit(None).cast("int").alias("pid"), F.col("l_quantity").cast("long").alias("size_bytes"), F.col("o_orderpriority").alias("cmdline"), text("c", "o_custkey").alias("user_principal"), F.col("l_returnflag").alias("raw_event_type"),
    )


R_SQL = """SELECT epoch_us(l_shipdate) AS ts_ns, CASE WHEN l_returnflag = 'A' THEN 'READ' WHEN l_returnflag = 'R' THEN 'WRITE' WHEN l_linestatus = 'O' THEN 'SEND' ELSE 'EXECUTE' END AS edge_category,
  l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey AS edge_uuid, 'o' || l_orderkey AS subject_uuid, 'p' || l_partkey AS object_uuid, 'n' || c_nationkey AS host_id, 'c' || o_custkey AS user_principal,
  l_partkey, l_suppkey, l_quantity, l_linenumber, o_orderpriority, l_returnflag
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""
EDGES_SQL = f"SELECT CASE edge_category WHEN 'READ' THEN 'isReadBy' WHEN 'WRITE' THEN 'writes' WHEN 'SEND' THEN 'sends' ELSE 'isExecutedBy' END AS rel_type, CASE WHEN edge_category IN ('WRITE', 'SEND') THEN subject_uuid ELSE object_uuid END AS src, CASE WHEN edge_category IN ('WRITE', 'SEND') THEN object_uuid ELSE subject_uuid END AS dst, edge_uuid, ts_ns, CAST(l_quantity AS BIGINT) AS size_bytes, l_returnflag AS raw_event_type, host_id FROM ({R_SQL})"


@register(EDGES_SQL)
def edges_common_record(spark, sf_dir):
    """P-07, J-01, G-04."""
    return graph.event_edges(_records(spark, sf_dir))


@register(f"""SELECT DISTINCT 'hasExe' AS rel_type, subject_uuid AS src, object_uuid AS dst FROM ({R_SQL}) WHERE edge_category = 'EXECUTE'
UNION SELECT 'hasUser', subject_uuid, user_principal FROM ({R_SQL}) UNION SELECT 'originatesFrom', subject_uuid, host_id FROM ({R_SQL})
UNION SELECT 'hasSocketIP', object_uuid, '10.0.0.' || l_suppkey FROM ({R_SQL}) WHERE edge_category = 'SEND'""")
def structural_edges(spark, sf_dir):
    """G-05 to G-08."""
    return graph.structural_edges(_records(spark, sf_dir))


@register(f"""SELECT label, count(*) AS n_mentions, count(DISTINCT uuid) AS n_nodes FROM (
  SELECT 'Process' AS label, subject_uuid AS uuid FROM ({R_SQL}) UNION ALL SELECT 'Host', host_id FROM ({R_SQL}) UNION ALL SELECT 'User', user_principal FROM ({R_SQL})
  UNION ALL SELECT CASE edge_category WHEN 'SEND' THEN 'Socket' WHEN 'EXECUTE' THEN 'Executable' ELSE 'File' END, object_uuid FROM ({R_SQL})
  UNION ALL SELECT 'IPAddress', '10.0.0.' || l_suppkey FROM ({R_SQL}) WHERE edge_category = 'SEND') GROUP BY label""")
def node_counts(spark, sf_dir):
    """G-03, G-10: mentions and nodes by label."""
    return graph.node_mentions(_records(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n_mentions"), F.countDistinct("uuid").alias("n_nodes"))


@register(f"""SELECT host_id AS uuid, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS last_type, arg_max(value, event_id) FILTER (value > 50) AS last_value FROM ({E_SQL}) GROUP BY host_id""")
def node_upsert(spark, sf_dir):
    """G-01, G-02: the last value that isn't null."""
    rows = _events(spark, sf_dir).select(F.col("host_id").alias("uuid"), "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("last_type"), F.when(F.col("value") > 50, F.col("value")).alias("last_value"))
    return graph.upsert(rows, ["uuid"], ["event_id"], ["last_type", "last_value"])


def _classified(spark, sf_dir):
    items, parts, sup = (_table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    sup = sup.where("s_acctbal >= 0")
    rows = items.join(parts, items.l_partkey == parts.p_partkey, "left").join(sup, items.l_suppkey == sup.s_suppkey, "left")
    none = F.lit(None).cast("string")
    reason, fine = dispatch.first_reason(
        (F.col("l_returnflag") == "R", "RECORD_IS_NOT_EVENT", none),
        (F.col("l_linenumber") > 5, "ABSTRACT_FLOW", none),
        (F.col("s_suppkey").isNull(), "OBJECT_TYPE_UNRESOLVABLE", F.lit("subject_missing")),
        (F.col("p_size") > 40, "NON_PROVENANCE_EVENT", F.col("p_type")),
    )
    return rows.select(F.col("l_linestatus").alias("dataset"), F.lit("x").alias("sub_dataset"), F.col("l_returnflag").alias("raw_event_type"), reason.alias("drop_reason"), fine.alias("drop_detail"))


C_SQL = """SELECT l_linestatus AS dataset, l_returnflag AS raw_event_type,
  CASE WHEN l_returnflag = 'R' THEN 'RECORD_IS_NOT_EVENT' WHEN l_linenumber > 5 THEN 'ABSTRACT_FLOW' WHEN s_suppkey IS NULL THEN 'OBJECT_TYPE_UNRESOLVABLE' WHEN p_size > 40 THEN 'NON_PROVENANCE_EVENT' END AS drop_reason,
  CASE WHEN l_returnflag = 'R' OR l_linenumber > 5 THEN NULL WHEN s_suppkey IS NULL THEN 'subject_missing' WHEN p_size > 40 THEN p_type END AS drop_detail
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal >= 0) ON l_suppkey = s_suppkey"""


@register(f"SELECT dataset, 'x' AS sub_dataset, drop_reason, coalesce(raw_event_type, '') AS raw_event_type, coalesce(drop_detail, '') AS drop_detail, count(*) AS n FROM ({C_SQL}) WHERE drop_reason IS NOT NULL GROUP BY ALL")
def classify_drop_reasons(spark, sf_dir):
    """P-04, A-01."""
    return dispatch.drop_log(_classified(spark, sf_dir))


@register(f"SELECT dataset, count(*) AS seen, count(*) FILTER (drop_reason IS NULL) AS kept, count(*) FILTER (drop_reason IS NOT NULL) AS dropped, round(100.0 * count(*) FILTER (drop_reason IS NULL) / count(*), 2) AS kept_pct FROM ({C_SQL}) GROUP BY dataset")
def record_coverage(spark, sf_dir):
    """A-02."""
    return dispatch.coverage(_classified(spark, sf_dir), "dataset")


@register("""SELECT l_partkey, CASE WHEN bool_or(l_returnflag = 'A') THEN 'PROCESS' WHEN bool_or(l_returnflag = 'N') THEN 'FILE' ELSE 'SOCKET' END AS role, count(DISTINCT l_returnflag) > 1 AS ambiguous
FROM lineitem GROUP BY l_partkey""")
def role_resolution(spark, sf_dir):
    """A-05."""
    role = F.when(F.col("l_returnflag") == "A", "PROCESS").when(F.col("l_returnflag") == "N", "FILE").otherwise("SOCKET")
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.collect_set(role).alias("r"))
    best, several = lookup.resolve_role(F.col("r"))
    return rows.select("l_partkey", best.alias("role"), several.alias("ambiguous"))


@register(f"""SELECT CAST(host_id AS VARCHAR) AS uuid, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types_raw, coalesce(arg_min(event_type, event_id) FILTER (value > 50), '') AS path,
  coalesce(arg_min(k, event_id) FILTER (k <> 0), 0) AS port, arg_max(CAST(k AS VARCHAR), event_id) FILTER (k % 2 = 0) AS parent_uuid, count(DISTINCT event_type = 'view') > 1 AS ambiguous FROM ({E_SQL}) GROUP BY host_id""")
def lookup_merge(spark, sf_dir):
    """A-03, A-04: all types, the first value that isn't empty or zero, the last that isn't null."""
    none = F.lit(None).cast("string")
    rows = _events(spark, sf_dir).select(
        "event_id", F.col("host_id").cast("string").alias("uuid"), F.col("event_type").alias("type"), F.when(F.col("value") > 50, F.col("event_type")).otherwise("").alias("path"), F.col("k").alias("port"),
        F.when(F.col("k") % 2 == 0, F.col("k").cast("string")).alias("parent_uuid"), *[none.alias(c) for c in ("ip", "cmdline", "pid", "principal_uuid")],
    )
    merged = lookup.object_lookup(rows, ["event_id"], role=F.when(F.col("type") == "view", "PROCESS").otherwise("FILE"))
    return merged.select("uuid", "types_raw", "path", "port", "parent_uuid", "ambiguous")


@register(STATS_SQL)
def node_stats(spark, sf_dir):
    """A-18."""
    return regularity.node_stats(_tensor_events(spark, sf_dir), "host_id")


def _filtered_sql(keep: str) -> str:
    return f"""WITH s AS ({STATS_SQL}), k AS ({keep}) SELECT e.host_id, e.bin, e.src, e.dst, count(*) AS n FROM ({T_SQL}) e
JOIN k a ON a.host_id = e.host_id AND a.node = e.src JOIN k b ON b.host_id = e.host_id AND b.node = e.dst GROUP BY ALL"""


def _filtered(spark, sf_dir, f):
    events = _tensor_events(spark, sf_dir)
    kept = f.keep(regularity.node_stats(events, "host_id"), ["host_id"])
    return regularity.tensor_counts(regularity.keep_nodes(events, kept, ["host_id"]), "host_id")


@register(_filtered_sql("SELECT host_id, node FROM s WHERE n_bins >= 6"))
def persistence_filter(spark, sf_dir):
    """N-11."""
    return _filtered(spark, sf_dir, regularity.PersistenceFilter(6))


@register(_filtered_sql("SELECT host_id, node FROM (SELECT *, greatest(2, CAST(floor(quantile_cont(degree, 0.75) OVER (PARTITION BY host_id)) AS BIGINT)) AS f FROM s) WHERE degree >= f"))
def activity_floor(spark, sf_dir):
    """N-12."""
    return _filtered(spark, sf_dir, regularity.ActivityFloorFilter(2, 0.75))


@register(_filtered_sql("SELECT host_id, node FROM (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY degree DESC, node) AS r FROM s) WHERE r <= 500"))
def topk_filter(spark, sf_dir):
    """O-03, W-08: a limit by definition."""
    return _filtered(spark, sf_dir, regularity.TopKFilter(500))


@register(f"""WITH s AS ({STATS_SQL}), k AS (SELECT host_id, node FROM s WHERE n_bins >= 6),
e1 AS (SELECT e.* FROM ({T_SQL}) e JOIN k a ON a.host_id = e.host_id AND a.node = e.src JOIN k b ON b.host_id = e.host_id AND b.node = e.dst),
s1 AS (SELECT host_id, node, count(*) AS degree FROM (SELECT host_id, src AS node FROM e1 UNION ALL SELECT host_id, dst FROM e1) GROUP BY ALL),
k1 AS (SELECT host_id, node FROM s1 WHERE degree >= 3),
e2 AS (SELECT e.* FROM e1 e JOIN k1 a ON a.host_id = e.host_id AND a.node = e.src JOIN k1 b ON b.host_id = e.host_id AND b.node = e.dst)
SELECT 0 AS stage, 'raw' AS filter, (SELECT count(*) FROM ({T_SQL})) AS n_events, (SELECT count(*) FROM s) AS n_nodes
UNION ALL SELECT 1, 'PersistenceFilter(min_bins=6)', (SELECT count(*) FROM e1), (SELECT count(*) FROM k)
UNION ALL SELECT 2, 'ActivityFloorFilter(min_events=3, quantile=None)', (SELECT count(*) FROM e2), (SELECT count(*) FROM k1)""")
def filter_funnel(spark, sf_dir):
    """N-14, A-19."""
    return regularity.run_filters(_tensor_events(spark, sf_dir), [regularity.PersistenceFilter(6), regularity.ActivityFloorFilter(3)], ["host_id"])[1]


@register("""WITH RECURSIVE n AS (SELECT event_id AS node, nullif(event_id // 2, event_id) AS parent, event_type = 'signup' AS stop FROM events),
c(node, here, hops, go) AS (SELECT node, node, 0, NOT stop AND parent IS NOT NULL FROM n
  UNION ALL SELECT c.node, n.parent, c.hops + 1, c.hops + 1 < 10 AND coalesce(NOT p.stop AND p.parent IS NOT NULL, false) FROM c JOIN n ON n.node = c.here LEFT JOIN n p ON p.node = n.parent WHERE c.go)
SELECT node, arg_max(here, hops) AS resolved, CAST(max(hops) AS BIGINT) AS hops FROM c GROUP BY node""")
def resolve_parent_chain(spark, sf_dir):
    """J-03: parents are halves of the id, a signup stops."""
    rows = _events(spark, sf_dir).withColumn("parent", F.floor(F.col("event_id") / 2).cast("long"))
    return lookup.resolve_chain(rows, "event_id", "parent", F.col("event_type") == "signup", 10)


ORIGIN_SQL = f"SELECT DISTINCT subject_uuid AS p, host_id AS host FROM ({R_SQL})"


def _host_sql(where: str) -> str:
    return f"""WITH e AS (SELECT * FROM ({EDGES_SQL}) {where}), x AS (SELECT src AS p, dst AS other FROM e UNION ALL SELECT dst, src FROM e),
h AS (SELECT host, p, other FROM ({ORIGIN_SQL}) JOIN x USING (p)) SELECT host, p AS uuid FROM h UNION SELECT host, other FROM h"""


@register(_host_sql("WHERE ts_ns >= 800000000000000 AND ts_ns < 830000000000000"))
def window_active_nodes(spark, sf_dir):
    """J-05."""
    return graph.record_host_nodes(_records(spark, sf_dir), 800_000_000_000_000, 830_000_000_000_000)


@register(_host_sql(""))
def host_anytime_nodes(spark, sf_dir):
    """J-06."""
    return graph.record_host_nodes(_records(spark, sf_dir))


def _labels(spark, sf_dir):
    rows = _table(spark, sf_dir, "labels")
    kinds = F.explode(F.array(F.struct(F.lit("toxic").alias("source"), F.col("toxic").alias("hit")), F.struct(F.lit("junk").alias("source"), (1 - F.col("quality")).alias("hit"))))
    return rows.select("doc_id", kinds.alias("x")).select("doc_id", "x.source", "x.hit").where("hit = 1").select("doc_id", "source")


L_SQL = "SELECT doc_id, 'toxic' AS source FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'junk' FROM labels WHERE quality = 0"


@register(f"""WITH l AS ({L_SQL}) SELECT source, count(*) AS l0, count(*) FILTER (doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')) AS in_lang, count(*) FILTER (doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 1000)) AS long_text,
  round(count(*) FILTER (doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 1000)) / count(*), 6) AS pct_of_labelset, round(count(*) FILTER (doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 1000)) / 1000.0, 6) AS base_rate FROM l GROUP BY source""")
def label_funnel(spark, sf_dir):
    """A-20, J-10."""
    docs = _table(spark, sf_dir, "documents")
    rows = coverage.funnel(_labels(spark, sf_dir), {"in_lang": docs.where("lang = 'en'").select("doc_id"), "long_text": docs.where("n_chars > 1000").select("doc_id")}, ["source"], "doc_id")
    return coverage.base_rates(rows, "long_text", F.lit(1000))


@register(f"SELECT doc_id, source FROM ({L_SQL}) WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def label_unmatched(spark, sf_dir):
    """J-09, T-03."""
    return graph.unmatched(_labels(spark, sf_dir), _table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id").select("doc_id", "source")


@register(f"""SELECT d.doc_id, l.s AS attack_sources, l.s IS NOT NULL AS malicious FROM documents d LEFT JOIN (SELECT doc_id, string_agg(DISTINCT source, ',' ORDER BY source) AS s FROM ({L_SQL}) GROUP BY doc_id) l USING (doc_id)""")
def annotate_nodes(spark, sf_dir):
    """J-08, G-12, G-13."""
    return graph.annotate(_table(spark, sf_dir, "documents").select("doc_id"), _labels(spark, sf_dir), "doc_id")


@register("""SELECT coalesce(s.s_name, 'Unresolved') AS l_suppkey_s_name, CASE WHEN l_partkey % 7 <> 0 THEN coalesce(p.s_name, 'Unresolved') END AS ref2_s_name, count(*) AS n
FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal >= 0) s ON l_suppkey = s.s_suppkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal >= 0) p ON (CASE WHEN l_partkey % 7 <> 0 THEN l_partkey END) = p.s_suppkey GROUP BY ALL""")
def flow_semantics(spark, sf_dir):
    """J-15."""
    rows = _table(spark, sf_dir, "lineitem").withColumn("ref2", F.when(F.col("l_partkey") % 7 != 0, F.col("l_partkey")))
    return coverage.flow_semantics(rows, _table(spark, sf_dir, "supplier").where("s_acctbal >= 0"), ["l_suppkey", "ref2"], "s_suppkey", ["s_name"])


@register("SELECT l_partkey, string_agg(DISTINCT l_returnflag, '+' ORDER BY l_returnflag) AS types FROM lineitem WHERE l_partkey <> 0 GROUP BY l_partkey")
def type_sets(spark, sf_dir):
    """J-16."""
    return coverage.type_sets(_table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag")


@register(f"""WITH n AS (SELECT DISTINCT host_id, src AS node FROM ({T_SQL}) UNION SELECT host_id, dst FROM ({T_SQL})), i AS (SELECT host_id, node, CAST(dense_rank() OVER (PARTITION BY host_id ORDER BY node) - 1 AS INT) AS i FROM n)
SELECT e.host_id, e.bin, a.i AS src_i, b.i AS dst_i, count(*) AS w FROM ({T_SQL}) e JOIN i a ON a.host_id = e.host_id AND a.node = e.src JOIN i b ON b.host_id = e.host_id AND b.node = e.dst GROUP BY ALL""")
def tensor_coo(spark, sf_dir):
    """N-01."""
    return regularity.tensor_cells(_tensor_events(spark, sf_dir), "host_id").select("host_id", "bin", "src_i", "dst_i", "w")


SCORES_SQL = f"""WITH b AS (SELECT host_id, ts // {HOUR} * {HOUR} AS t, count(*) AS n FROM ({E_SQL}) GROUP BY ALL),
e AS (SELECT host_id, min(t) AS a, (max(t) - min(t)) // {HOUR} + 1 AS len, sum(n) AS s1, sum(n * n) AS s2 FROM b GROUP BY host_id),
k AS (SELECT host_id, max(x) AS top, sum(x) AS al FROM (SELECT host_id, (t - a) // ({HOUR} * 5) AS blk, any_value(len) AS len, sum(n) AS x FROM b JOIN e USING (host_id) GROUP BY ALL) WHERE blk < len // 5 GROUP BY host_id),
m AS (SELECT e.host_id, s1 / len AS mu, sqrt(greatest(s2 / len - (s1 / len) * (s1 / len), 0)) AS sd, coalesce(top / al, 0) AS c FROM e LEFT JOIN k USING (host_id))
SELECT host_id, round((sd - mu) / (sd + mu), 6) AS burstiness, round(c, 6) AS concentration FROM m"""


@register(SCORES_SQL)
def burstiness_concentration(spark, sf_dir):
    """N-07, H.3."""
    return regularity.series_scores(_cube(spark, sf_dir, HOUR), HOUR)


@register(f"SELECT host_id, CASE WHEN burstiness > 0.3 AND concentration > 0.3 THEN 'bursty' WHEN burstiness > 0.3 THEN 'aperiodic' ELSE 'noise' END AS regime FROM ({SCORES_SQL})")
def regime_classes(spark, sf_dir):
    """N-08."""
    scores = regularity.series_scores(_cube(spark, sf_dir, HOUR), HOUR)
    return scores.select("host_id", regularity.classify_regime(F.lit(0.0), F.col("burstiness"), F.col("concentration")).alias("regime"))


@register(f"""WITH i AS (SELECT host_id, min(ts) AS start, max(ts) AS "end" FROM ({E_SQL}) GROUP BY host_id)
SELECT host_id, s AS slice_start, least(s + {DAY}, "end") AS slice_end FROM (SELECT *, unnest(range(start, "end", {DAY})) AS s FROM i)""")
def time_slice_rows(spark, sf_dir):
    """W-13, S-12."""
    spans = _events(spark, sf_dir).groupBy("host_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return time_slices(spans, DAY).select("host_id", "slice_start", "slice_end")


FILES_SQL = f"SELECT event_id // 100 AS file, min(ts) AS first_ts, max(ts) AS last_ts FROM ({E_SQL}) GROUP BY ALL"


@register(f"SELECT f.file, w.start, w.start + {DAY} AS \"end\" FROM ({FILES_SQL}) f JOIN (SELECT unnest(range(1704067200000000, 1706745600000000, 5 * {DAY})) AS start) w ON f.first_ts < w.start + {DAY} AND f.last_ts > w.start")
def file_overlap(spark, sf_dir):
    """S-08, J-12: the windows are a handful of rows."""
    files = _events(spark, sf_dir).groupBy(F.floor(F.col("event_id") / 100).cast("long").alias("file")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    windows = spark.range(1_704_067_200_000_000, 1_706_745_600_000_000, 5 * DAY).select(F.col("id").alias("start"), (F.col("id") + DAY).alias("end"))
    return coverage.overlapping(windows, files, strict=True).select(F.col("slice_file").alias("file"), "start", "end")


@register(f"""WITH r AS (SELECT event_id // 1000 AS file, event_id, CASE WHEN event_id % 3 = 0 THEN ts END AS own FROM ({E_SQL}))
SELECT file, event_id, last_value(own IGNORE NULLS) OVER (PARTITION BY file ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS ts_ns FROM r""")
def inherited_timestamps(spark, sf_dir):
    """S-02, W-01, J-18: two lines of three have no time of their own."""
    from ..sources import scan

    rows = _events(spark, sf_dir).select(F.floor(F.col("event_id") / 1000).cast("long").alias("file_rank"), F.floor(F.col("event_id") / 250).cast("long").alias("block"), F.col("event_id").alias("mid"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("t"))
    return scan.inherit_timestamps(rows, F.col("t")).select(F.col("file_rank").alias("file"), F.col("mid").alias("event_id"), "ts_ns")


@register()
def ntf_components(spark, sf_dir):
    """N-02 to N-09: components of each host's tensor, by the sweep over ranks 1 to 14 (``DEFAULT_R_RANGE`` of the host sweep)."""
    events = regularity.cap_nodes(_tensor_events(spark, sf_dir), ["host_id"])
    cells = regularity.tensor_cells(events, "host_id")
    table = regularity.sweep(cells, regularity.RANKS)
    return regularity.components(cells, regularity.select_rank(table))


def _rw_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.rw_collapse(_cube(spark, sf_dir, DAY), ["view"], ["purchase"])


@register()
def hmm_best_k(spark, sf_dir):
    """N-15, N-16."""
    return regimes.best_order(_rw_days(spark, sf_dir), DAY)


@register()
def hmm_states(spark, sf_dir):
    """N-17: days of each host under its best model of two states."""
    return regimes.decode_states(_rw_days(spark, sf_dir), 2)
