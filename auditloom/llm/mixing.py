"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a random key (MD5 of its id and text), documents are put in key
order within their source, distributed prefix sums of their sizes run along
that order, and each source is cut at its exact budget. A budget above the
source's size takes whole epochs first; the rest is cut from the same order.

The prefix sums have three levels: sums of key ranges (the first three hex
digits), sums of finer ranges within them (six digits), and a running sum
within a fine range. No level gathers more than 4096 range sums or one fine
range's documents in a task, so a source that holds most rows is spread like
any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words are runs of anything but space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """Target of each source: ``(source, source_size)`` in, ``rank`` and ``target`` added.

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` of all sizes. No target exceeds ``most`` times its source's size;
    the excess goes to the others by weight until none is above. That fixed
    point is ``least(most * size, level * weight)``: in order of ``most * size /
    weight`` the stopped sources come first, so one running sum finds the level.
    One row per source; sources are a small dimension.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    rows = rows.withColumn("stop", most * F.col("source_size"))
    filled = Window.orderBy(F.col("stop") / F.col("weight"), "rank")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.withColumns(
        {
            "left": share * F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0.0)),
            "open": F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    # The level is right at the first source that the remaining shares do not fill.
    level = F.min(F.when(F.col("left") * F.col("weight") <= F.col("stop") * F.col("open"), F.struct(F.col("stop") / F.col("weight"), "rank", F.col("left") / F.col("open"))))
    rows = rows.withColumn("level", level.over(everything)["col3"])
    target = F.when(F.col("level").isNull(), F.col("stop")).otherwise(F.least("stop", F.col("level") * F.col("weight")))
    return rows.select("source", "source_size", "rank", target.alias("target"))


def mix(
    docs: DataFrame,
    size: Column | None = None,
    weights: Sequence[float] = (1, 2, 3),
    share: float = 1.0,
    most: float = 3.0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Every row of ``docs`` with ``_size``, ``_source_size``, ``_target`` and ``_taken``.

    ``_taken`` counts the size units the mix takes, repeats included; over a
    source it adds up to the rounded target exactly. The document at the cut is
    taken in part. Equal ids tie on the text, then on nothing: rows that agree
    in both are interchangeable. A null id or source is a value like any other;
    empty and null texts have size 0 and are taken 0 times; an empty table
    gives an empty result. Other columns pass through untouched, but for ones
    named like the added columns or ``__mix_...``, which go.
    """
    if size is None:
        size = word_count(F.col(text_col))
    tie = F.md5(F.coalesce(text_col, F.lit("")))
    key = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), tie))  # rows of one id spread by their texts
    docs = docs.drop(*[c for c in docs.columns if c.startswith("__mix_") or c in ("_size", "_source_size", "_target", "_taken")])
    rows = docs.withColumns({"_size": size, "__mix_key": key, "__mix_tie": tie})
    rows = rows.withColumns({"__mix_wide": F.substring("__mix_key", 1, 3), "__mix_fine": F.substring("__mix_key", 1, 6)})
    fine = rows.groupBy(F.col(source_col).alias("s"), F.col("__mix_wide").alias("w"), F.col("__mix_fine").alias("f")).agg(F.sum("_size").alias("n"))
    wide = fine.groupBy("s", "w").agg(F.sum("n").alias("n"))
    goal = targets(wide.groupBy(F.col("s").alias("source")).agg(F.sum("n").alias("source_size")), weights, share, most)
    before = lambda over: F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wide = wide.withColumn("start", before(Window.partitionBy("s").orderBy("w")))
    fine = fine.withColumn("inside", before(Window.partitionBy("s", "w").orderBy("f")))
    fine = fine.alias("a").join(wide.alias("b"), F.col("a.s").eqNullSafe(F.col("b.s")) & (F.col("a.w") == F.col("b.w")))
    fine = fine.select("a.s", "a.f", (F.col("start") + F.col("inside")).alias("__mix_start"))
    goal = goal.select(F.col("source").alias("s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    fine = fine.alias("a").join(goal.alias("b"), F.col("a.s").eqNullSafe(F.col("b.s"))).select(F.col("a.s").alias("__mix_s"), F.col("f").alias("__mix_f"), "__mix_start", "_source_size", "_target")
    running = Window.partitionBy(source_col, "__mix_fine").orderBy("__mix_key", id_col, "__mix_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__mix_inside", F.coalesce(F.sum("_size").over(running), F.lit(0)))
    rows = rows.join(fine, F.col(source_col).eqNullSafe(F.col("__mix_s")) & (F.col("__mix_fine") == F.col("__mix_f")))
    budget = F.round("_target").cast("long")
    epochs = F.when(F.col("_source_size") > 0, F.floor(budget / F.greatest("_source_size", F.lit(1)))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("_source_size")
    part = F.greatest(F.lit(0), F.least("_size", rest - F.col("__mix_start") - F.col("__mix_inside")))
    taken = (epochs * F.col("_size") + part).cast("long")
    return rows.withColumn("_taken", taken).drop("__mix_key", "__mix_tie", "__mix_wide", "__mix_fine", "__mix_inside", "__mix_start", "__mix_s", "__mix_f")


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: a row of ``docs`` for each time it is taken.

    A document taken ``x`` times its size appears ``round(x)`` times, so each
    source's total differs from its target by half a document at most.
    """
    mixed = mix(docs, **options)
    copies = F.when(F.col("_size") > 0, F.round(F.col("_taken") / F.col("_size")).cast("int")).otherwise(1)
    return mixed.withColumn("_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)))).select(*docs.columns)
