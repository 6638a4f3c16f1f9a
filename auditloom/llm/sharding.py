"""Uniform shuffle into shards of exact size, with DataFrame functions only.

A communication matrix says how many rows each of P map groups sends to each
shard. Its law is the multivariate hypergeometric one that a uniform shuffle of
all rows induces, drawn group by group from what the shards have left, so the
row and column sums are exact. Each group's rows are permuted locally and dealt
by its row of the matrix, exchanged, and permuted again within the shard.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a map group, on average, once there are more than LEAST_GROUPS of them.
GROUP_ROWS = 1 << 18
LEAST_GROUPS = 64
#: Groups whose part of the matrix a plan holds at once.
PIECE_GROUPS = 1024
ADDED = ("size", "text_crc32", "shard", "slot")


def capacities(rows: int, shards: int) -> list[int]:
    """Shard sizes that add up to ``rows`` and differ by one at most."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def communication_matrix(counts: list[int], room: list[int], seed: int) -> np.ndarray:
    """Rows that each group sends to each shard; sums over groups are ``room`` exactly.

    Drawn on the driver: one small vector per map group, none per row.
    """
    rng, left = np.random.default_rng(seed), np.array(room, np.int64)
    out = np.zeros((len(counts), len(room)), np.int64)
    for g, n in enumerate(counts):
        # numpy's sampler takes totals below 10**9; one shard after another has no such bound.
        rest, total = int(n), int(left.sum())
        for s in range(len(room)):
            total -= int(left[s])
            out[g, s] = _hypergeometric(rng, int(left[s]), total, rest)
            rest -= int(out[g, s])
        left -= out[g]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    # Beyond the sampler's range by inversion: weights relative to the mode's, as products of neighbours'
    # exact ratios. Further than 16 deviations and 64 from the mode they add less than a double resolves.
    p, total = good / (good + bad), good + bad
    spread = math.sqrt(draws * p * (1 - p) * (total - draws) / (total - 1))
    mode, reach = (draws + 1) * (good + 1) // (total + 2), int(16 * spread) + 64
    lo, hi = max(0, draws - bad, mode - reach), min(good, draws, mode + reach)
    x = np.arange(lo, hi, dtype=float)
    ratio = (good - x) / (x + 1) * ((draws - x) / (bad - draws + x + 1))  # weight of x + 1 over that of x
    up, down = np.cumprod(ratio[mode - lo :]), np.cumprod(1 / ratio[: mode - lo][::-1])[::-1]
    sums = np.cumsum(np.concatenate([down, [1.0], up]))
    return lo + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def _random_key(salt: str, *columns: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(salt), *columns))


def _matrix_table(spark: SparkSession, present: list[int], matrix: np.ndarray) -> DataFrame:
    """``_g, _cut``: where each group's rows are cut into shards; a plan never holds more than ``PIECE_GROUPS`` groups."""
    table = None
    cuts = np.cumsum(matrix, axis=1)
    for lo in range(0, max(len(present), 1), PIECE_GROUPS):
        rows = [{"g": g, "cut": c.tolist()} for g, c in zip(present[lo : lo + PIECE_GROUPS], cuts[lo : lo + PIECE_GROUPS], strict=True)]
        piece = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<g:int,cut:array<long>>>")).alias("p")).select(F.col("p.g").alias("_g"), F.col("p.cut").alias("_cut"))
        if len(present) > PIECE_GROUPS:
            piece = materialize(piece, "shard-matrix")
        table = piece if table is None else table.union(piece)
    return table


def shuffle_into_shards(
    docs: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Rows of ``docs`` with ``shard``, ``slot`` (gapless from 0 in its shard), ``size`` and ``text_crc32``.

    ``keep`` names the columns that travel (all by default; maps can't). Shard
    sizes differ by one at most (law ``rows``). Reruns agree. Equal texts take
    their places independently. Rows that agree in all that travels, the id,
    the size and the checksum are counted as one and numbered, so thousands of
    copies spread like other rows. Null ids and texts are values like any
    other, with a size of one for a null or empty text. Columns of ``docs``
    named like the added ones, or starting with ``__shard_``, go. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ADDED and not c.startswith("__shard_")]
    rows = docs.select(*kept, F.col(id_col).cast("string").alias("__shard_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("__shard_n"))
    rows = rows.withColumn("__shard_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__shard_n")))).drop("__shard_n")
    # Rows that differ in other columns alone must not share their place either.
    identity = [F.coalesce(F.col("__shard_id"), F.lit("")), F.col("size").cast("string"), F.col("text_crc32").cast("string"), F.col("__shard_copy").cast("string"), F.xxhash64(*kept).cast("string")]
    total = docs.count()
    groups = max(LEAST_GROUPS, math.ceil(total / GROUP_ROWS))
    group = F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(groups)).cast("int")
    rows = rows.withColumns({"__shard_group": group, "__shard_first": _random_key(f"{seed}a", *identity), "__shard_second": _random_key(f"{seed}b", *identity)}).drop("__shard_id", "__shard_copy")
    counts = {r["g"]: r["n"] for r in rows.groupBy(F.col("__shard_group").alias("g")).agg(F.count("*").alias("n")).collect()}  # one row per map group
    present = sorted(counts)
    plan = _matrix_table(spark, present, communication_matrix([counts[g] for g in present], capacities(total, shards), seed))
    # Local permutation, then the matrix says which stretch of it goes where.
    local = F.row_number().over(Window.partitionBy("__shard_group").orderBy("__shard_first")).cast("long")
    rows = rows.withColumn("__shard_rank", local).join(plan, F.col("__shard_group") == F.col("_g"))
    rows = rows.withColumn("shard", F.size(F.filter("_cut", lambda c: c < F.col("__shard_rank"))).cast("int"))
    # Permutation within the shard: key ranges, their offsets, and ranks within a range.
    fine = max(1, math.ceil(math.log(max(1, total / shards / 4096), 16)) + 1)
    rows = rows.withColumn("__shard_range", F.substring("__shard_second", 1, fine)).drop("_g", "_cut", "__shard_rank", "__shard_group", "__shard_first")
    sums = rows.groupBy("shard", "__shard_range").agg(F.count("*").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("__shard_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("shard").alias("_s"), F.col("__shard_range").alias("_r"), offset.alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("shard", "__shard_range").orderBy("__shard_second")) - 1
    rows = rows.withColumn("__shard_inner", rank).join(sums, (F.col("shard") == F.col("_s")) & (F.col("__shard_range") == F.col("_r")))
    slot = (F.col("_offset") + F.col("__shard_inner")).cast("long")
    return rows.select(*kept, "size", "text_crc32", "shard", slot.alias("slot"))
