"""Raw lines: order, inherited times, windows, file metadata."""

import json

import pytest
from pyspark.sql import functions as F

from auditloom.functions import records
from auditloom.sources import scan


def line(i, ts=None):
    stamp = f'"timestampNanos":{ts},' if ts is not None else ""
    return '{"datum":{"com.bbn.tc.schema.avro.cdm18.Event":{' + stamp + f'"n":{i}' + "}}}"


def sequential(rows):
    out, last = [], None
    for n, ts in rows:
        last = ts if ts is not None else last
        out.append((n, last))
    return out


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    data = []
    for f in range(2):
        rows = [(f * 5000 + i, (f * 10_000 + i) * 1000 if (i * 7 + f) % 5 == 0 and i > 6 else None) for i in range(5000)]
        (root / f"part{f}.json").write_text("\n".join(line(*r) for r in rows) + "\n\n")
        data.append(rows)
    return [str(root / f"part{f}.json") for f in range(2)], data


def timed(spark, paths):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        rows = scan.inherit_timestamps(scan.read_lines(spark, paths), records.own_timestamp(F.col("value"), "e3"))
        rows = rows.withColumn("n", F.regexp_extract("value", r'"n":(\d+)', 1).cast("long")).cache()
        rows.count()  # the splits are made while the setting holds
        return rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fill_equals_a_sequential_loop(spark, files):
    paths, data = files
    rows = timed(spark, paths)
    assert rows.select("file_rank", "block").distinct().count() > 4
    got = {r["n"]: r["ts_ns"] for r in rows.select("n", "ts_ns").collect()}
    assert got == dict(x for d in data for x in sequential(d))
    order = [r["n"] for r in rows.orderBy(*scan.ORDER).select("n").collect()]
    assert order == [n for d in data for n, _ in d]


def test_windows(spark, files):
    paths, data = files
    rows = timed(spark, paths)
    filled = [x for d in data for x in sequential(d)]
    assert scan.window_lines(rows).count() == len(filled)
    want = {n for n, t in filled if t is not None and 1_000_000 <= t < 12_000_000}
    assert {r["n"] for r in scan.window_lines(rows, 1_000_000, 12_000_000).select("n").collect()} == want


def test_early_stop_loses_late_lines(spark):
    rows = spark.createDataFrame([(0, 0, i, t) for i, t in enumerate([10, 30, 15])], "file_rank int, block long, mid long, ts_ns long")
    assert scan.window_lines(rows, 0, 20).count() == 2
    assert scan.window_lines(rows, 0, 20, stop_early=True).count() == 1


def test_only_the_first_time_key_counts(spark):
    texts = ['{"timestampNanos":12,"x":1}', '{"timestampNanos":null,"timestampNanos":5}', '{"timestampNanos":1.5e18}', '{"timestampNanos": 7}', ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "value string").select(records.own_timestamp(F.col("value"), "e5")).collect()]
    assert got == [12, None, 1, None, None]
    ecar = [json.dumps({"timestamp": t}, separators=(",", ":")) for t in ("2019-09-17T11:00:00.123-04:00", "bad")]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in ecar], "value string").select(records.own_timestamp(F.col("value"), "optc")).collect()]
    assert got == [1568732400123000000, None]


def test_unknown_dataset():
    with pytest.raises(KeyError):
        records.is_ecar("nope")


def test_files_are_pruned_and_ranked(spark):
    rows = [("c", 50, 60), ("a", 10, 20), ("b", None, None), ("d", 20, 40)]
    registry = spark.createDataFrame(rows, "path string, first_realistic_ts_ns long, last_timestamp_ns long")
    got = [r["path"] for r in scan.select_files(registry, 20, 50).orderBy("file_rank").collect()]
    assert got == ["d", "b"]


def test_metadata(spark, files):
    paths, _ = files
    lines = scan.read_lines(spark, paths)
    got = scan.file_metadata(lines, records.own_timestamp(F.col("value"), "e3")).orderBy("file_rank").collect()
    assert [r["likely_ordered"] for r in got] == [True, True]
    assert [r["resolution"] for r in got] == ["microseconds", "microseconds"]
    assert got[0]["uuid_case"] is None and got[0]["first_realistic_ts_ns"] is None
    assert scan.read_lines(spark, []).count() == 0


def test_read_dataset(spark, files):
    paths, data = files
    registry = spark.createDataFrame([(p, f * 10_000_000, (f * 10_000 + 4999) * 1000) for f, p in enumerate(paths)], "path string, first_realistic_ts_ns long, last_timestamp_ns long")
    assert scan.read_dataset(spark, registry, "e3").count() == 10_000
    assert scan.read_dataset(spark, registry, "e3", 10_000_000).select("file_rank").distinct().count() == 1
