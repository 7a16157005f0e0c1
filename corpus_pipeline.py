"""Documents to shards: quality rules, near-duplicates, decontamination, mixing, sharding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm.decontaminate import decontaminate
from cloakframe.llm.mixing import mix
from cloakframe.llm.near_dup import counted, near_duplicates
from cloakframe.llm.quality import quality
from cloakframe.llm.sharding import shards
from cloakframe.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality(docs).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id, once.

    Rows of one id are one document; of those with equal texts one stays. Texts without words are in no group, and
    rows without id keep their place, as they cannot be named.
    """
    near = near_duplicates(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max("kept").alias("kept"), F.count("*").alias("n"))
    listed = counted(near.where("NOT kept OR n > 1").select("doc_id", F.col("kept").alias("_repeated")))
    marked = docs.join(listed, "doc_id", "left")
    once = marked.where("_repeated IS NULL").select(*docs.columns)
    if not listed.where("_repeated").take(1):
        return once
    return once.unionByName(marked.where("_repeated").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(~F.col("contaminated")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix(docs).where("repeats > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot."""
    return shards(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
