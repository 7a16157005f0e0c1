"""Equivalence classes: rows that share all quasi-identifier values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.definition import STAR
from cloakframe.operators.ranking import null_safe


def is_suppressed(qid: Sequence[str]) -> Column:
    """True for rows in which every quasi-identifier is ``*``."""
    condition = F.lit(True)
    for q in qid:
        condition = condition & F.col(q).eqNullSafe(F.lit(STAR))
    return condition


def drop_suppressed(df: DataFrame, qid: Sequence[str]) -> DataFrame:
    return df.filter(~is_suppressed(qid))


def class_sizes(df: DataFrame, qid: Sequence[str], name: str = "n", weight: str | None = None) -> DataFrame:
    """Rows per class; with a ``weight`` each line stands for that many rows."""
    return df.groupBy(*qid).agg((F.sum(weight) if weight else F.count("*")).alias(name))


def class_target_counts(df: DataFrame, qid: Sequence[str], target: str) -> DataFrame:
    return df.groupBy(*qid, target).agg(F.count("*").alias("n"))


def class_summary(df: DataFrame, qid: Sequence[str], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Number and size of classes; the suppressed class is counted apart."""
    flagged = class_sizes(df, [*by, *qid], weight=weight).withColumn("_s", is_suppressed(qid))
    kept = F.when(~F.col("_s"), F.col("n"))
    return flagged.groupBy(*by).agg(
        F.count(kept).alias("classes"),
        F.avg(kept).alias("avg_size"),
        F.min(kept).alias("min_size"),
        F.max(kept).alias("max_size"),
        F.coalesce(F.sum(F.when(F.col("_s"), F.col("n"))), F.lit(0)).alias("suppressed"),
        F.coalesce(F.sum(kept), F.lit(0)).alias("sample_size"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_size"),
    )


def size_histogram(df: DataFrame, qid: Sequence[str]) -> DataFrame:
    """How many classes there are of each size."""
    return class_sizes(df, qid).groupBy("n").agg(F.count("*").alias("classes"))


def surviving_histogram(population: DataFrame, sample: DataFrame, qid: Sequence[str]) -> DataFrame:
    """Per population class size: all classes, and those still met in the sample."""
    joined = null_safe(class_sizes(population, qid), class_sizes(sample, qid, "m"), qid, "left")
    return joined.groupBy("n").agg(F.count("*").alias("classes"), F.count("m").alias("surviving"))


def with_class_size(df: DataFrame, qid: Sequence[str], name: str = "class_size") -> DataFrame:
    """Attach to each row the size of its class.

    Partial counts are joined back instead of using a window, so that a huge class
    is neither sorted nor buffered in one task.
    """
    return null_safe(df, class_sizes(df, qid, name), qid, "left")


def class_ratio(sample: DataFrame, population: DataFrame, qid: Sequence[str]) -> DataFrame:
    """Sample size over population size of every class met on either side."""
    joined = null_safe(class_sizes(sample, qid, "n_sample"), class_sizes(population, qid, "n_population"), qid, "full")
    return joined.withColumn("ratio", F.coalesce(F.col("n_sample") / F.col("n_population"), F.lit(0.0)))


def common_classes(population: DataFrame, sample: DataFrame, qid: Sequence[str]) -> DataFrame:
    return null_safe(class_sizes(population, qid, "n_population"), class_sizes(sample, qid, "n_sample"), qid)


def before_after(before: DataFrame, after: DataFrame, qid: Sequence[str]) -> DataFrame:
    joined = null_safe(class_sizes(before, qid, "n_before"), class_sizes(after, qid, "n_after"), qid, "left")
    return joined.withColumn("n_after", F.coalesce("n_after", F.lit(0)))


def fully_suppressed(df: DataFrame, cells: Sequence[str], qid: Sequence[str], weight: str | None = None) -> DataFrame:
    """Per experiment cell: does it hold nothing but suppressed rows?"""
    return df.groupBy(*cells).agg(
        (F.sum(weight) if weight else F.count("*")).alias("n_rows"), F.bool_and(is_suppressed(qid)).alias("fully_suppressed")
    )


def unusable_samples(df: DataFrame, cells: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """Cells whose sample is empty or knows fewer than two target values."""
    per_target = df.groupBy(*keys, target).agg(F.count("*").alias("_n"))
    stats = per_target.groupBy(*keys).agg(F.sum("_n").alias("n_rows"), F.count(target).alias("n_targets"))
    joined = null_safe(cells.select(*keys), stats, keys, "left").fillna(0, ["n_rows", "n_targets"])
    return joined.withColumn("unusable", (F.col("n_rows") == 0) | (F.col("n_targets") < 2))
