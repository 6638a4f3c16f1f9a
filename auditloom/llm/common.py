"""Shared helpers: shared-folder tables, session settings and connected components."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import materialize, settle, shared_dir, temporary_path  # noqa: F401
from .grouping import spanning_stars

#: Rows of one Arrow batch sent to Python; texts are long, so batches are short.
ARROW_ROWS = 400
#: Edges of a graph that one task settles by itself, 16 bytes each; larger ones take rounds over all tasks.
FEW_EDGES = 100_000


def prepare(spark: SparkSession) -> None:
    """Session settings every operator here relies on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def let_go() -> None:
    """Drop the tokenizer that other work has left in this Python worker."""
    if bpe := sys.modules.get("auditloom.llm.bpe"):
        bpe.load.cache_clear()


def least_hashed(rows: DataFrame, column: str, n: int) -> DataFrame:
    """At most ``n`` rows, those whose ``column`` hashes least: a sample that reruns agree on.

    In a large table a threshold that about ``2 n`` rows pass goes first, so
    that tasks send what they hold of the sample and not ``n`` rows each.
    """
    total, space = rows.count(), 1 << 40
    place = F.pmod(F.xxhash64(column), F.lit(space))
    if total > 4 * n:
        rows = rows.where(place < int(space * 2 * n / total))
    return rows.orderBy(place, column).limit(n)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, component`` of the whole graph of edges ``u, v``."""
    held = list(batches)
    if held:
        table = pa.Table.from_batches(held)
        ids, place = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("u", "v")]), return_inverse=True)
        node, least = spanning_stars(ids, place[: table.num_rows], place[table.num_rows :])
        centres = np.setdiff1d(ids, node)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, centres])), pa.array(np.concatenate([least, centres]))], ["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from each node, over undirected ``edges``.

    A graph of at most ``FEW_EDGES`` edges is settled in one task. Of a larger one
    alternates large-star and small-star steps until the edge set stands still.
    Every step is an aggregate and a join, so a hub's edges are spread over
    tasks by partial aggregation and skew-join splitting. Returns ``(node,
    component)`` for the nodes that appear in an edge; null ends and loops are
    ignored.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    pairs = materialize(pairs.where("u is not null and v is not null and u <> v").distinct(), "cc-edges")
    if pairs.count() <= FEW_EDGES:
        return materialize(pairs.coalesce(1).mapInArrow(_settled, "node long, component long"), "cc-edges", replaces=pairs)
    while True:  # every round brings nodes nearer to their least, so it ends; as a rule after a logarithm of the longest path
        # Settled once all are stars: each larger end has one smaller one, which is no larger end itself.
        ends = F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e")
        ends = pairs.select(ends).select("e.*").groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
        if ends.where("ups > 1 or (ups = 1 and least = 0)").isEmpty():
            break
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m"))
        # Large star: every larger neighbour goes to the least of the closed neighbourhood.
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: the smaller neighbours, and the node itself, go to their least.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        pairs = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc-edges", replaces=pairs)
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.union(centres)
