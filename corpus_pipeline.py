"""A training-data pipeline of five stages over `documents`; each stage works on all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm import bpe, mixing, secrets, simhash, toxicity
from umbra.llm.common import crc, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents predicted toxic; the model learns from `documents` and `labels` as op1 does."""
    learn = spark.read.parquet(f"{sf_dir}/documents.parquet").where(crc(F.col("doc_id"), 5) != 0)
    model = toxicity.fit(learn, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model).select(*COLUMNS)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, that with the smallest id: a Jaccard
    similarity of five-word shingles of 0.8 or more; candidates are told by 256-bit fingerprints, each link is recomputed.

    A row is told by its id and its text, so different texts with one id are judged separately; null ids come last.
    """
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h"))
    docs = docs.withColumn("_row", row)
    near = simhash.near_copies(docs, key="_row")
    keep = near.where("doc_id = component_id").select(F.col("doc_id").alias("_row")).distinct()
    return docs.join(keep, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret found in any layer by a mark."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as its source's rate and its draw say; copies are rows with the same doc_id."""
    m = mixing.mix(docs, keep=("text", "lang", "n_chars"))
    return m.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with the digests of the ids and of the decoded bytes."""
    return bpe.public(docs)


STAGES = [("toxicity", toxic_out), ("simhash", near_copies_out), ("secrets", secrets_out), ("mixing", mixed), ("bpe", encoded)]
#: SQL can't express the stages: test_pipeline_stages in tests/llm/test_data.py holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result but the last is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
