"""Command-line rules, categories, label files, caches."""

import re

import pytest
from pyspark.sql import functions as F

from auditloom.functions import categories, textnorm, timeutil
from auditloom.operators import coverage, volume
from auditloom.plans.cache import Cache
from auditloom.sources import labels

B = "\\\\"
CASES = [
    ("e3", "theia", "ssh 10.1.2.3 --port  22 --pid 7", "ssh <IP> --port  <PORT> --pid  <PID>".replace("--pid  ", "--pid ")),
    ("e3", "theia", "scp -r a@10.0.0.1:/x y", "scp -r <SRC> <DST>"),
    ("e3", "theia", "scp x y", "scp x y"),
    ("e3", "theia", "scp -t /x", "scp -t /x"),
    ("e3", "theia", "kill -9 123", "kill -9 <PID>"),
    ("e3", "cadets", "/tmp/foo.AbCdEf12", "/tmp/foo.<RAND>"),
    ("e3", "cadets", "/tmp/locatexhmAyn5hWz/_updatedb", "/tmp/<TMPDIR>/_updatedb"),
    ("e3", "cadets", "sed s/XXX_FUNCTION_NAME_XXX/foo/ base.c", "sed s/XXX_FUNCTION_NAME_XXX/<FUNC>/ base.c"),
    ("e3", "cadets", "cc -O2 ab.c -o ab.o", "cc -O2 <SRC>.c -o <SRC>.o"),
    ("e3", "clearscope", " com.app 1.2.3.4 ", "com.app <IP>"),
    ("optc", "x", f"c:{B}WINDOWS{B}System32{B}a.exe", f"C:{B}Windows{B}System32{B}a.exe"),
    ("optc", "x", "x {01234567-89ab-CDEF-0123-456789abcdef} 01234567-89ab-cdef-0123-456789abcdef", "x {<GUID>} <GUID>"),
    ("e3", "fivedirections", "smss.exe 000000ab", "smss.exe <HEX>"),
    ("optc", "x", "WerFault.exe -u -p 12 -s 34", "WerFault.exe -u -p <PID> -s <SESSION>"),
    ("optc", "x", "taskeng.exe {abc} S-1-5-18:LUA[3]", "taskeng.exe {<TASKGUID>} S-<SID>:LUA[<N>]"),
    ("optc", "x", "powershell -EncodedCommand QUJD", "powershell -EncodedCommand <ENCODED>"),
    ("e5", "marple", "@ name # ab c@ value # q@ controlType # z@ className # w", "@ name # <UINAME> @ value # <UIVAL> @ controlType # z@ className # <UICLASS>"),
    ("e3", "trace", "sleep 100", "sleep <DURATION>"),
    ("e3", "trace", "sleep 10", "sleep 10"),
    ("e3", "trace", "x 0123456789abcdef0", "x <HEXEXPR>"),
    ("e3", "trace", "modinfo -F a /lib/modules/4/x.ko", "modinfo -F a /<MODULE>.ko"),
    ("e3", "trace", "date -d now - 12.5 seconds", "date -d now - <ELAPSED> seconds"),
    ("e3", "trace", "/usr/lib/firefox/firefox -contentproc -childID 3 -isForBrowser -prefs 1.2.3.4 -appdir /usr/x 77 true tab", "/usr/lib/firefox/firefox -contentproc -childID <N> -isForBrowser <PREFS> -appdir /usr/x <PID> true tab"),
    ("e3", "trace", "\x01\x02\x03", "<BINARY_GARBAGE>"),
    ("e3", "trace", "", ""),
]


def test_rules(spark):
    for (ds, part), rows in __import__("itertools").groupby(sorted(CASES), key=lambda c: c[:2]):
        rows = list(rows)
        df = spark.createDataFrame([(r[2],) for r in rows], "c string")
        got = [r[0] for r in df.select(textnorm.normalize(F.col("c"), ds, part)).collect()]
        assert got == [r[3] for r in rows]


def test_platforms():
    assert [textnorm.platform(*x) for x in (("e3", "cadets"), ("e5", "clearscope"), ("optc", "aia_1"), ("e3", "trace"), ("hpc", "login"))] == ["freebsd", "android", "windows", "linux", "linux"]
    with pytest.raises(ValueError):
        textnorm.platform("e3", "nope")


def test_categories(spark):
    rows = spark.createDataFrame([("/bin/-zsh",), ("-bash -l",), ("",), ("python3.9 x",), ("u:8",), ("pip3",), ("zzz",)], "c string")
    got = [tuple(r) for r in rows.select(categories.basename(F.col("c")), categories.category(categories.basename(F.col("c")))).collect()]
    assert got == [("-zsh", "Other"), ("bash", "Shells & sessions"), ("", "Package management"), ("python3.9", "Dev / build / IDE"), ("u:8", "System services & daemons"), ("pip3", "Package management"), ("zzz", "Other")]
    assert all(re.compile(p) for patterns in categories.CATEGORIES.values() for p in patterns)


def test_label_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ab-1,x\nAB-1,y\nc,\n")
    (tmp_path / "b.json").write_text('["x1", "x2"]')
    (tmp_path / "c.json").write_text('{"p": ["x1"],\n "q": ["x3"]}')
    (tmp_path / "d.txt").write_text("u1\n\nu2\n")
    (tmp_path / "e.csv").write_text("uuid , attack_chain \nu1, E3_3.2_x;Y_4.1\nu2,none\n")
    (tmp_path / "f.json").write_text('{"actorID":"a","objectID":"b"}\n{"actorID":"a"}\n')
    load = lambda s, f: sorted(r[0] for r in labels.load(spark, s, str(tmp_path / f)).collect())
    assert load("PM", "a.csv") == ["AB-1", "C"]
    assert load("FL", "b.json") == ["X1", "X2"] and load("FL", "c.json") == ["X1", "X3"] and load("FL", "d.txt") == ["U1", "U2"]
    assert load("WW", "e.csv") == ["U1", "U2"] and load("RV", "f.json") == ["A", "B"] and load("zz", "a.csv") == []
    got = sorted(tuple(r) for r in labels.labels_by_section(spark, str(tmp_path / "e.csv")).collect())
    assert got == [("U1", "3.2"), ("U1", "4.1")]
    with pytest.raises(NotImplementedError):
        labels.load(spark, "WW", str(tmp_path / "edges.csv"))


def test_first_slice_that_contains_a_window(spark):
    windows = spark.createDataFrame([("e3", "t", 5, 8), ("e3", "t", 90, 99)], "dataset string, sub_dataset string, start long, end long")
    slices = spark.createDataFrame([("e3", "t", 0, 10, "b"), ("e3", "t", 4, 9, "a")], "dataset string, sub_dataset string, start long, end long, name string")
    assert sorted((r["start"], r["slice"]) for r in coverage.containing_slice(windows, slices).collect()) == [(5, "a"), (90, None)]


def test_single_bin_and_ties(spark):
    cube = spark.createDataFrame([("a", 0, "x", 6), ("b", 0, "x", 1), ("b", 300, "x", 3), ("b", 900, "y", 5)], "host_id string, time_bin long, event_type string, count long")
    got = {r["host_id"]: r for r in volume.volumetrics(cube, ["x"], 1, 300).collect()}
    assert got["a"]["events_per_s"] == 0.02 and got["a"]["events_per_s_std"] is None
    assert got["b"]["events_per_s"] == 0.01  # 300 and 600 are equally common
    with pytest.raises(ValueError):
        volume.rebin(cube, 300, 0)


def test_time_helpers():
    assert timeutil.partition_by_time(0, 10, 3) == [(0, 3), (3, 6), (6, 10)]
    assert timeutil.partition_by_time(5, 5, 3) == [(5, 5)]


def test_cache(spark, tmp_path):
    cache, built = Cache(spark, str(tmp_path)), []
    build = lambda: built.append(1) or spark.range(3).withColumn("g", F.col("id") % 2)
    assert cache.get("EventsPerHost", "e3", build).count() == cache.get("EventsPerHost", "e3", build).count() == 3
    assert len(built) == 1 and cache.path("EventsPerHost", "k").endswith("events_per_host/k")
    assert cache.append_new(spark.range(10, 13).withColumn("g", F.col("id") % 3), "EventsPerHost", "e3", ["g"]).count() == 4
