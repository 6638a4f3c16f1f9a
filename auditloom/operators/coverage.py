"""Label coverage: how many labels of each attack window survive from the files to the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def containing_slice(windows: DataFrame, slices: DataFrame) -> DataFrame:
    """J-11: the first slice, by name, of the same data set that holds the whole window; null if none does."""
    s = slices.select(F.col("dataset").alias("_d"), F.col("sub_dataset").alias("_p"), F.col("start").alias("slice_start"), F.col("end").alias("slice_end"), F.col("name").alias("slice"))
    hit = (F.col("dataset") == F.col("_d")) & (F.col("sub_dataset") == F.col("_p")) & (F.col("start") >= F.col("slice_start")) & (F.col("end") <= F.col("slice_end"))
    rows = windows.join(s, hit, "left")
    rank = F.row_number().over(Window.partitionBy(*windows.columns).orderBy("slice"))
    return rows.withColumn("_n", rank).where("_n = 1").drop("_n", "_d", "_p")


def overlapping(windows: DataFrame, slices: DataFrame, strict: bool = False) -> DataFrame:
    """J-12: pairs that overlap; touching ones count unless ``strict``.

    Both sides are dealt into time bins as wide as the longer of their mean
    lengths; a pair meets in the first bin that both reach, by an equi-join.
    """
    length = lambda rows: rows.agg(F.avg(F.col("end") - F.col("start"))).first()[0] or 0
    width = int(max(1, length(windows), length(slices)))
    bins = lambda rows: rows.where("start <= end").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    s = bins(slices).select(F.col("_bin"), *[F.col(c).alias(f"slice_{c}") for c in slices.columns])
    hit = (F.col("start") < F.col("slice_end")) & (F.col("end") > F.col("slice_start")) if strict else (F.col("start") <= F.col("slice_end")) & (F.col("end") >= F.col("slice_start"))
    first = F.col("_bin") == F.floor(F.greatest("start", "slice_start") / width)
    return bins(windows).join(s, "_bin").where(hit & first).drop("_bin")


def funnel(labels: DataFrame, stages: dict[str, DataFrame], by: list[str], key: str = "uuid") -> DataFrame:
    """A-20, J-10: distinct labels by group, and of them those in each stage's set.

    ``labels`` has the group columns and the key; a stage has the key, and may
    have group columns (a window's own nodes). All windows go through at once.
    """
    rows = labels.select(*by, key).distinct()
    for name, members in stages.items():
        on = [*[c for c in by if c in members.columns], key]
        rows = rows.join(members.select(*on).distinct().withColumn(name, F.lit(1)), on, "left")
    return rows.groupBy(*by).agg(F.count("*").alias("l0"), *[F.count(name).alias(name) for name in stages])


def base_rates(funnels: DataFrame, last: str, total: Column) -> DataFrame:
    """Shares of the label set and of all active nodes that the last stage holds; null of nothing."""
    share = lambda n, d: F.round(n / F.nullif(d, F.lit(0)), 6)
    return funnels.withColumns({"pct_of_labelset": share(F.col(last), F.col("l0")), "base_rate": share(F.col(last), total)})


def exclusions(labels: DataFrame, lookup: DataFrame, nodes: DataFrame, by: list[str], most: int = 500) -> DataFrame:
    """O-05: labelled objects that no node has, the first ``most`` uuids of each group (a report's size)."""
    rows = labels.select(*by, "uuid").distinct().join(lookup, "uuid").join(nodes.select("uuid").distinct(), "uuid", "left_anti")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("uuid"))
    return rows.withColumn("_n", rank).where(F.col("_n") <= most).drop("_n")


def skipped(windows: DataFrame, reason: Column) -> DataFrame:
    """T-06: windows that can't be measured, with why; union them by name with missing columns."""
    return windows.withColumn("skip_reason", reason).where("skip_reason is not null")


def flow_semantics(events: DataFrame, objects: DataFrame, refs: list[str], key: str, kind: list[str]) -> DataFrame:
    """J-15: types of what each reference points to, counted; ``Unresolved`` where it points nowhere, null where it is null."""
    rows, names = events, []
    for ref in refs:
        side = objects.select(F.col(key).alias(f"_{ref}"), *[F.col(k).alias(f"{ref}_{k}") for k in kind])
        rows = rows.join(side, F.col(ref) == F.col(f"_{ref}"), "left")
        for k in kind:
            rows = rows.withColumn(f"{ref}_{k}", F.when(F.col(ref).isNotNull(), F.coalesce(F.col(f"{ref}_{k}"), F.lit("Unresolved"))))
            names.append(f"{ref}_{k}")
    return rows.groupBy(*names).agg(F.count("*").alias("n"))


def type_sets(mentions: DataFrame, key: str, kind: str, sep: str = "+") -> DataFrame:
    """J-16: the sorted set of types that each object is seen with, joined; the zero uuid is left out."""
    rows = mentions.where(~F.col(key).cast("string").rlike("^[0-]+$"))
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(kind)), sep).alias("types"))
