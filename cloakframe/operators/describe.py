"""Descriptive statistics, distributions and aggregate functions on values."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.definition import STAR
from cloakframe.operators.anonymize import group_median, group_mode, group_quantiles
from cloakframe.operators.ranking import null_safe


def value_distribution(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Count and share of each value; also the frequency distribution of an attribute."""
    counts = df.groupBy(*by, column).agg(F.count("*").alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("_t"))
    joined = null_safe(counts, total, by) if by else counts.withColumn("_t", total.scalar())
    return joined.select(*by, column, "n", (F.col("n") / F.col("_t")).alias("share"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of rows for every pair of values that occurs."""
    counts = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n").alias("t")).scalar())


def long_format(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, x)``: all numeric columns below each other, read in one scan."""
    lines = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns]
    return df.select(F.explode(F.array(*lines)).alias("_r")).select("_r.*")


def summary_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One line per numeric column.

    Moments come from one pass; mode and median from counts of distinct values.
    """
    x, values = F.col("x"), long_format(df, columns)
    moments = values.groupBy("column").agg(
        F.count(x).alias("n"), F.count_if(x.isNull()).alias("nulls"),
        F.min(x).alias("min"), F.max(x).alias("max"), (F.max(x) - F.min(x)).alias("range"),
        F.avg(x).alias("mean"), F.exp(F.avg(F.when(x > 0, F.log(x)))).alias("geometric_mean"),
        F.var_samp(x).alias("sample_variance"), F.var_pop(x).alias("population_variance"),
        F.stddev_samp(x).alias("std"), F.kurtosis(x).alias("kurtosis"),
    )
    median = group_median(values, ["column"], "x")
    mode = group_mode(values, ["column"], "x")
    return null_safe(null_safe(moments, median, ["column"], "left"), mode, ["column"], "left")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per column, quartiles interpolated."""
    x, values = F.col("x"), long_format(df, columns)
    q = group_quantiles(values, ["column"], "x", [0.25, 0.5, 0.75])
    wide = q.groupBy("column").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    moments = values.groupBy("column").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return null_safe(moments, wide, ["column"], "left")


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns in one aggregate."""
    pairs = list(itertools.combinations_with_replacement(columns, 2))
    wide = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    lines = []
    for a, b in pairs:
        r = F.col(f"`{a}|{b}`").alias("r")
        lines.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r))
        if a != b:
            lines.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), r))
    return wide.select(F.explode(F.array(*lines)).alias("r")).select("r.*")


def trend(df: DataFrame, time: str, value: str, unit: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.date_trunc(unit, time).alias("period")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


# ------------------------------------------------------------- value aggregates


def common_prefix(low: Column, high: Column) -> Column:
    """Longest common prefix of a set of strings, read off its least and greatest."""
    longest = F.least(F.length(low), F.length(high))
    hit = F.aggregate(
        F.sequence(F.lit(1), F.greatest(longest, F.lit(1))), F.lit(0),
        lambda acc, i: F.when((i <= longest) & (F.substr(low, F.lit(1), i) == F.substr(high, F.lit(1), i)), i).otherwise(acc),
    )
    return F.substr(low, F.lit(1), hit)


def aggregate_values(df: DataFrame, keys: Sequence[str], column: str, function: str, length: int | None = None) -> DataFrame:
    """One text per group: ``set``, ``prefix_set``, ``common_prefix``,
    ``common_prefix_redacted``, ``bounds`` or ``interval``."""
    c = F.col(column)
    text = c.cast("string")
    if function in ("set", "prefix_set"):
        if function == "prefix_set":
            text = F.substr(text, F.lit(1), F.lit(length or 1))
        distinct = df.filter(c.isNotNull()).select(*keys, text.alias("_t")).distinct()
        joined = F.concat_ws(", ", F.sort_array(F.collect_list("_t")))
        return distinct.groupBy(*keys).agg(F.concat(F.lit("{"), joined, F.lit("}")).alias("value"))
    if function.startswith("common_prefix"):
        ends = df.groupBy(*keys).agg(F.min(text).alias("_lo"), F.max(text).alias("_hi"), F.max(F.length(text)).alias("_len"))
        prefix = common_prefix(F.col("_lo"), F.col("_hi"))
        if function == "common_prefix_redacted":
            prefix = F.rpad(prefix, F.col("_len"), F.lit(STAR))
        return ends.select(*keys, prefix.alias("value"))
    low, high = F.min(c).cast("string"), F.max(c).cast("string")
    opening, closing = {"bounds": ("[", "]"), "interval": ("[", "[")}[function]
    return df.groupBy(*keys).agg(F.concat(F.lit(opening), low, F.lit(", "), high, F.lit(closing)).alias("value"))
