"""Attack labels and process counters from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: dotted report sections inside an attack-chain name.
SECTION = r"_(\d+(\.\d+)*)(?=_|$|\s|;)"
#: The counters' columns.
IO_SCHEMA = "sample_ts double, pid long, uid long, comm string, syscr long, syscw long, read_bytes long, write_bytes long, rchar long, wchar long"
CMDLINE_SCHEMA = "sample_ts double, pid long, uid long, cmdline string"


def _ids(rows: DataFrame, value: Column) -> DataFrame:
    return rows.select(F.upper(F.trim(value)).alias("uuid")).where("uuid is not null and uuid <> ''").distinct()


def load(spark: SparkSession, source: str, path: str) -> DataFrame:
    """S-19, S-20: distinct upper-case uuids of a label file.

    ``PM``: text before the first comma. ``FL``: a JSON list or object of
    lists, or plain lines. ``WW``: a csv with a ``uuid`` column, padded names
    allowed; edge files are not supported. ``RV``: JSON lines with ``actorID``
    and ``objectID``. Any other source has no labels.
    """
    name = path.rsplit("/", 1)[-1].lower()
    if source == "PM":
        return _ids(spark.read.text(path), F.substring_index("value", ",", 1))
    if source == "FL" and name.endswith(".json"):
        # The file is one JSON value: its strings that are not keys.
        text = spark.read.text(path, wholetext=True)
        listed = F.from_json("value", "array<string>")
        by_key = F.flatten(F.map_values(F.from_json("value", "map<string,array<string>>")))
        return _ids(text.select(F.explode(F.when(F.trim("value").startswith("["), listed).otherwise(by_key)).alias("u")), F.col("u"))
    if source == "FL":
        return _ids(spark.read.text(path), F.col("value"))
    if source == "WW":
        if "edge" in name:
            raise NotImplementedError("edge labels of this source")
        return _ids(_ww(spark, path), F.col("uuid"))
    if source == "RV":
        rows = spark.read.schema("actorID string, objectID string").json(path)
        return _ids(rows.select(F.explode(F.array("actorID", "objectID")).alias("u")), F.col("u"))
    return spark.createDataFrame([], "uuid string")


def _ww(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return rows.toDF(*[c.strip() for c in rows.columns])


def sections(rows: DataFrame, uuid: str = "uuid", chain: str = "attack_chain") -> DataFrame:
    """S-21: every section that each uuid's chain names."""
    return rows.select(F.upper(F.trim(F.col(uuid))).alias("uuid"), F.explode(F.regexp_extract_all(F.col(chain), F.lit(SECTION), F.lit(1))).alias("section")).distinct()


def labels_by_section(spark: SparkSession, path: str) -> DataFrame:
    return sections(_ww(spark, path))


def section_key(report: Column) -> Column:
    """P-19: the leading dotted number."""
    return F.nullif(F.regexp_extract(F.trim(report), r"^(\d+(?:\.\d+)*)", 1), F.lit(""))


def process_io(spark: SparkSession, path: str, first: str = "", last: str = "~") -> DataFrame:
    """S-22: counters of ``io_*.tsv`` files whose stem lies in a range of hours."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=IO_SCHEMA, pathGlobFilter="io_*.tsv")
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^io_(.*)\.tsv$", 1)
    return rows.where(stem.between(first, last)).select("sample_ts", "pid", "comm", "syscr", "syscw")
