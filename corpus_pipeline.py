"""Corpus preparation in five stages; each stage's result is written as Parquet and read by the next.

1. quality     documents that the classifier rejects go;
2. ngram_join  of documents connected by 5-word shingle similarity of 0.8 or more, that of the least id stays;
3. secrets     secrets are replaced by a mark;
4. mix         sources are repeated or cut to their target weights;
5. bpe         texts become token ids, checked by decoding them again.

All but the last keep the columns of ``documents``. A null or empty text has no
words: it has a score like any text, is in no group, holds no secret, keeps its
one row in the mix, and has no ids. Rows without an id are in no group, so all
of them stay. Rows of one id are one document: it stays or goes as a whole, with
all its different texts; of rows that agree in id and text the least by the other
columns stays. Empty tables give empty results. Further columns travel along;
their names don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import bpe, jaccard, mixing, quality, secrets
from auditloom.llm.common import prepare, settle


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold."""
    prepare(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, into="_score").where(F.col("_score") >= quality.THRESHOLD).select(*docs.columns)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies."""
    prepare(spark)
    found = jaccard.components(docs, n=5, num=80, den=100)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    one = one.groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("_"), *rest)).alias("_least")).select("doc_id", "text", *[F.col("_least")[c].alias(c) for c in rest])
    return one.select(*docs.columns).union(docs.where("doc_id is null"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced."""
    prepare(spark)
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document."""
    prepare(spark)
    return mixing.mix_rows(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and whether they decode to its text."""
    import public_tokenizers

    prepare(spark)
    coded = bpe.encode_decode(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return coded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality", quality_stage),
    ("ngram_join", ngram_join_stage),
    ("secrets", secrets_stage),
    ("mix", mix_stage),
    ("bpe", bpe_stage),
]

#: The classifier is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        # What a stage wrote on its way goes with it, and so does its input.
        docs = settle(lambda s=stage, d=docs: s(spark, d, sf_dir), spark, f"stage-{name}", replaces=docs)
    return docs
