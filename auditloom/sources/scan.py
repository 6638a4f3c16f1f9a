"""Raw text logs: file pruning, line order, own and inherited timestamps.

Line order is ``(file_rank, block, mid)``: the file's place in the sequence,
the byte offset of the split, and the row's place within the task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import records
from ..functions.timeutil import REALISTIC_NS, SECOND_NS, in_window

ORDER = ["file_rank", "block", "mid"]


def select_files(registry: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """S-08, O-02: files whose time range overlaps ``[start, end)``, ranked by first realistic time.

    A file without times can't be ruled out.
    """
    known = F.col("first_realistic_ts_ns").isNotNull() & F.col("last_timestamp_ns").isNotNull()
    hit = F.lit(True)
    if end is not None:
        hit = hit & (F.col("first_realistic_ts_ns") < end)
    if start is not None:
        hit = hit & (F.col("last_timestamp_ns") > start)
    rows = registry.where(~known | hit)
    return rows.withColumn("file_rank", F.row_number().over(Window.orderBy(F.col("first_realistic_ts_ns").asc_nulls_last(), "path")) - 1)


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """S-01, S-11: lines of the files with their order; blank lines go. Paths are in sequence."""
    if not paths:
        return spark.createDataFrame([], "file_rank int, block long, mid long, value string")
    rank = {p: i for i, p in enumerate(paths)}
    names = F.create_map(*[x for p, i in rank.items() for x in (F.lit(p.rsplit("/", 1)[-1]), F.lit(i))])
    whole = F.create_map(*[x for p, i in rank.items() for x in (F.lit(p), F.lit(i))])
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    unique = len({p.rsplit("/", 1)[-1] for p in paths}) == len(paths)
    place = names[F.col("_metadata.file_name")] if unique else whole[path]
    rows = spark.read.text(paths).select(place.alias("file_rank"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"), "value")
    return rows.where(F.trim("value") != "")


def inherit_timestamps(lines: DataFrame, own: Column) -> DataFrame:
    """S-02, W-01, J-18: a line without a time takes the last one before it in its file.

    Three steps keep a large file in many tasks: the last time of each split, a
    running last over the splits (one row each), and a fill within the split
    that starts from what came before. ``ts_ns`` stays null before a file's
    first time.
    """
    rows = lines.withColumn("own_ts_ns", own)
    ends = rows.groupBy("file_rank", "block").agg(F.max_by("own_ts_ns", F.when(F.col("own_ts_ns").isNotNull(), F.col("mid"))).alias("last_ts"))
    before = Window.partitionBy("file_rank").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file_rank", "block", F.last("last_ts", ignorenulls=True).over(before).alias("carried"))
    rows = rows.join(ends, ["file_rank", "block"])
    here = Window.partitionBy("file_rank", "block").orderBy("mid").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("ts_ns", F.coalesce(F.last("own_ts_ns", ignorenulls=True).over(here), "carried")).drop("carried")


def window_lines(lines: DataFrame, start: int | None = None, end: int | None = None, stop_early: bool = False) -> DataFrame:
    """S-03, S-04: lines with ``start <= ts < end``; leading untimed lines count as time 0 when no start is given.

    ``stop_early`` reproduces a reader that leaves a file at its first time
    past the end, and so loses late lines.
    """
    ts = F.coalesce("ts_ns", F.lit(0)) if start is None else F.col("ts_ns")
    rows = lines.withColumn("ts_ns", ts)
    if stop_early and end is not None:
        so_far = Window.partitionBy("file_rank").orderBy("block", "mid").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_latest", F.max("ts_ns").over(so_far)).where(F.col("_latest") < end).drop("_latest")
    return rows.where(in_window(F.col("ts_ns"), start, end))


def first_seconds(lines: DataFrame, seconds: float) -> DataFrame:
    """S-07, W-12: each file's lines up to ``seconds`` after its first time, the bound included."""
    first = lines.groupBy("file_rank").agg(F.min_by("ts_ns", F.when(F.col("ts_ns").isNotNull(), F.struct("block", "mid"))).alias("_first"))
    return lines.join(first, "file_rank").where(F.col("ts_ns") <= F.col("_first") + int(seconds * SECOND_NS)).drop("_first")


def read_dataset(spark: SparkSession, registry: DataFrame, dataset: str, start: int | None = None, end: int | None = None, seconds: float | None = None) -> DataFrame:
    """S-13: timed lines of a data set's files, only those that may overlap the window read.

    The registry is a small table; its paths are listed on the driver, as any scan's are.
    """
    paths = [r["path"] for r in select_files(registry, start, end).orderBy("file_rank").select("path").collect()]
    rows = inherit_timestamps(read_lines(spark, paths), records.own_timestamp(F.col("value"), dataset))
    if seconds is not None:
        rows = first_seconds(rows, seconds)
    return window_lines(rows, start, end)


def end_lines(lines: DataFrame, sample: int) -> DataFrame:
    """First and last ``sample`` lines of each file.

    Counts of the splits (one row each) tell which splits hold them; only those
    are sorted, so a file is never gathered in a task.
    """
    splits = lines.groupBy("file_rank", "block").agg(F.count("*").alias("_n"))
    over = Window.partitionBy("file_rank").orderBy("block")
    before = F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    behind = F.coalesce(F.sum("_n").over(over.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    splits = splits.select("file_rank", "block", "_n", before.alias("_before"), behind.alias("_behind")).where((F.col("_before") < sample) | (F.col("_behind") < sample))
    nth = F.row_number().over(Window.partitionBy("file_rank", "block").orderBy("mid"))
    rows = lines.join(splits, ["file_rank", "block"]).withColumn("_nth", nth)
    near = (F.col("_before") + F.col("_nth") <= sample) | (F.col("_behind") + F.col("_n") - F.col("_nth") < sample)
    return rows.where(near).drop("_n", "_before", "_behind", "_nth")


def whole_file_times(lines: DataFrame, own: Column) -> DataFrame:
    """S-09: extreme times over all lines of a file, for files whose ends say nothing."""
    real = F.when(own >= REALISTIC_NS, own)
    return lines.groupBy("file_rank").agg(F.min(own).alias("_first"), F.max(own).alias("_last"), F.min(real).alias("_real"))


def file_metadata(lines: DataFrame, own: Column, sample: int = 100, extended: bool = False) -> DataFrame:
    """S-09a..f: a row for each file from its first and last ``sample`` lines and its extreme times.

    ``ordered`` allows backward jumps of ten seconds within the samples and
    from the first to the last of them. ``extended`` takes missing times from
    all lines of the file.
    """
    ahead = Window.partitionBy("file_rank").orderBy("block", "mid")
    some = end_lines(lines, sample).withColumn("t", own)
    some = some.withColumn("jump", F.lag("t").over(ahead) - F.col("t"))
    timed = F.col("t").isNotNull()
    uuid = F.regexp_extract_all("value", F.lit(r'"([0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12})"'), F.lit(1))
    ids = F.array_join(uuid, "")
    source = records.found(F.col("value"), r'"source":"([^"]*)"')
    number = F.try_to_number(records.found(F.col("value"), r'"sequence":(?:\{"(?:long|int)":)?(\d+)'), F.lit("9" * 19)).cast("long")
    uneven = lambda n: F.coalesce(F.max(F.when(timed, F.col("t") % n != 0)), F.lit(False))
    per = some.groupBy("file_rank").agg(
        F.min("t").alias("first_timestamp_ns"),
        F.max("t").alias("last_timestamp_ns"),
        F.min(F.when(F.col("t") >= REALISTIC_NS, F.col("t"))).alias("first_realistic_ts_ns"),
        (F.coalesce(F.max("jump"), F.lit(0)) <= 10 * SECOND_NS).alias("likely_ordered"),
        F.when(F.count("t") == 0, F.lit(None)).when(uneven(1000), "nanoseconds").when(uneven(1_000_000), "microseconds").when(uneven(SECOND_NS), "milliseconds").otherwise("seconds").alias("resolution"),
        F.max(ids.rlike("[a-f]")).alias("lower"),
        F.max(ids.rlike("[A-F]")).alias("upper"),
        F.max(F.size(uuid) > 0).alias("any"),
        F.array_sort(F.collect_set(source)).alias("sources"),
        F.min(number).alias("min_sequence"),
        F.max(number).alias("max_sequence"),
        F.max(F.col("value").rlike(r",\s*$")).alias("trailing_comma"),
        F.max(records.is_cdm(F.col("value"))).alias("wrapped"),
    )
    case = F.when(~F.col("any"), F.lit(None)).when(F.col("lower") & F.col("upper"), "mixed").when(F.col("lower"), "lower").when(F.col("upper"), "upper").otherwise("no_alpha_hex")
    one = F.when(F.size("sources") == 1, F.get("sources", F.lit(0))).when(F.size("sources") > 1, F.concat(F.lit("mixed:"), F.array_join("sources", ",")))
    per = per.withColumns({"uuid_case": case, "source": one}).drop("lower", "upper", "any", "sources")
    if not extended:
        return per
    per = per.join(whole_file_times(lines, own), "file_rank")
    fill = {"first_timestamp_ns": "_first", "last_timestamp_ns": "_last", "first_realistic_ts_ns": "_real"}
    return per.withColumns({c: F.coalesce(c, other) for c, other in fill.items()}).drop(*fill.values())


def timestamp_kind(value: Column) -> Column:
    """S-09e: how the line writes its time."""
    number = F.regexp_extract(value, r'"timestampNanos":\s*(-?[0-9.eE+]+)', 1)
    return F.when(number.rlike(r"^-?\d+$"), "int_nanos").when(number != "", "float_nanos").when(value.rlike(r'"timestamp":"\d{4}-'), "iso8601").otherwise("none")


def dataset_of(path: Column) -> tuple[Column, Column]:
    """S-09g: data set and part of a file by its folders ``.../<dataset>/<part>/<file>``."""
    parts = F.split(path, "/")
    return F.lower(F.element_at(parts, -3)), F.lower(F.element_at(parts, -2))


def file_registry(spark: SparkSession, root: str) -> DataFrame:
    """S-10, O-01: JSON files below a folder (no archives) with size and data set; listing only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("file_size_bytes"))
    name = F.element_at(F.split("path", "/"), -1)
    files = files.where(name.contains("json") & ~name.rlike(r"\.(tar|gz|zip)$"))
    dataset, part = dataset_of(F.col("path"))
    return files.withColumns({"dataset": dataset, "sub_dataset": part})


def annotated_registry(spark: SparkSession, root: str, dataset: str, extended: bool = False) -> DataFrame:
    """S-09, S-10: the files of a data set with the metadata that their lines give."""
    files = subset(file_registry(spark, root), dataset)
    paths = [r["path"] for r in files.select("path").orderBy("path").collect()]
    ranks = files.withColumn("file_rank", F.row_number().over(Window.orderBy("path")) - 1)
    meta = file_metadata(read_lines(spark, paths), records.own_timestamp(F.col("value"), dataset), extended=extended)
    return ranks.join(meta, "file_rank", "left").drop("file_rank")


def subset(registry: DataFrame, dataset: str, part: str | None = None) -> DataFrame:
    """S-18: a data set's files."""
    rows = registry.where(F.lower("dataset") == dataset.lower())
    return rows if part is None else rows.where(F.lower("sub_dataset") == part.lower())
