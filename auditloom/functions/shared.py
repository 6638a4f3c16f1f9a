"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset (tests on one machine) a local
    temporary folder takes its place.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="auditloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def temporary_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below one folder of this application that goes when its driver ends."""
    base = f"{shared_dir(spark)}/auditloom-{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Paths of the tables that are still kept, in the order in which they were made.
_kept: list[str] = []


def materialize(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    ``replaces`` is a table made here before that nothing reads any more; its
    files go.
    """
    spark = df.sparkSession
    path = temporary_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    _kept.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    old = None if replaces is None else replaces.__dict__.get("_stored_at")
    if old in _kept:
        _kept.remove(old)
        _delete(spark, old)
    return out


def settle(make: Callable[[], DataFrame], spark: SparkSession, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """``make()`` materialised; every other table that was made for it goes, and so does ``replaces``."""
    before = len(_kept)
    out = materialize(make(), name)
    for path in _kept[before:-1]:
        _delete(spark, path)
    del _kept[before:-1]
    old = None if replaces is None else replaces.__dict__.get("_stored_at")
    if old in _kept:
        _kept.remove(old)
        _delete(spark, old)
    return out
