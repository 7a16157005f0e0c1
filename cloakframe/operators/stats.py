"""Statistics over experiment grids: folds x k x sample rate x strategy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.functions.text import mean_spread, range_text
from cloakframe.operators.ranking import null_safe


def generalization_stats(stats: DataFrame) -> DataFrame:
    """Per k and chosen node: number of runs and mean ± std over them.

    ``stats``: fold, k, node and the four run figures.
    """
    figures = {"suppressed": "suppressed_cnt", "sample_size": "sample_size", "classes": "eq_cnt", "avg_size": "avg_eq_size"}
    aggs = [F.count("*").alias("n_runs")]
    for c in figures:
        aggs += [F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}")]
    grouped = stats.groupBy("k", "node").agg(*aggs)
    return grouped.select(
        "k", "node", "n_runs", *[mean_spread(F.col(f"_m_{c}"), F.col(f"_s_{c}")).alias(name) for c, name in figures.items()])


def fold_grid(cells: DataFrame, keys: Sequence[str], values: DataFrame, folds: int) -> DataFrame:
    """Every cell x fold x value: the frame missing counts are found on."""
    listed = values.columns[0]
    array = values.agg(F.sort_array(F.collect_set(listed)).alias("v")).scalar()
    return (
        cells.select(*keys).distinct()
        .withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(folds)])))
        .withColumn(listed, F.explode(array))
    )


def target_count_stats(counts: DataFrame, grid: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """Rows per target value over folds. The mean ignores folds without the value;
    the range counts them as 0."""
    joined = null_safe(grid, counts, [*keys, "fold", target], "left")
    agg = joined.groupBy(*keys, target).agg(
        F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"),
        F.min(F.coalesce("n", F.lit(0))).alias("min"), F.max(F.coalesce("n", F.lit(0))).alias("max"))
    return agg.select(
        *keys, target, "mean", "std", "min", "max",
        mean_spread(F.col("mean"), F.col("std")).alias("text"), range_text(F.col("min"), F.col("max")).alias("range"))


def missing_targets(counts: DataFrame, grid: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    return null_safe(grid, counts, [*keys, "fold", target], "left_anti")


def classes_per_target(pairs: DataFrame, grid: DataFrame, keys: Sequence[str], qid: Sequence[str], target: str) -> DataFrame:
    """Classes met per target value over folds; a missing value counts as 0 throughout."""
    distinct = pairs.select(*keys, "fold", target, *qid).distinct()
    counts = distinct.groupBy(*keys, "fold", target).agg(F.count("*").alias("n"))
    joined = null_safe(grid, counts, [*keys, "fold", target], "left").fillna(0, ["n"])
    return joined.groupBy(*keys, target).agg(
        F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.min("n").alias("min"), F.max("n").alias("max"))


def survivor_stats(common: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean size of the classes a sample still meets, in population and sample.

    Averaged within a fold (0 if none is met), then over folds; population std.
    """
    per_fold = common.groupBy(*keys, "fold").agg(F.avg("n_population").alias("p"), F.avg("n_sample").alias("s"))
    joined = null_safe(cells.select(*keys, "fold").distinct(), per_fold, [*keys, "fold"], "left").fillna(0.0, ["p", "s"])
    return joined.groupBy(*keys).agg(
        F.avg("p").alias("mean_population"), F.stddev_pop("p").alias("std_population"),
        F.avg("s").alias("mean_sample"), F.stddev_pop("s").alias("std_sample"))


def biggest(df: DataFrame, value: Column, cell: Sequence[str], name: str) -> DataFrame:
    """Largest value and the (first) cell it occurs in."""
    first = F.struct(-value, *cell)
    return df.agg(F.max(value).alias(name), F.min_by(F.struct(*cell), first).alias("_at")).select(name, "_at.*").filter(F.col(name) > 0)


def matrix(df: DataFrame, row: str, column: str, values: Sequence, value: Column) -> DataFrame:
    """One line per ``row``, one column per listed ``column`` value."""
    wide = df.groupBy(row).pivot(column, list(values)).agg(value)
    return wide.select(row, *[F.col(f"`{v}`").alias(f"{column}_{str(v).replace('.', '_')}") for v in values])


MEASURES = ("precision", "recall", "f1")


def fold_mean_std(report: DataFrame, cells: DataFrame, keys: Sequence[str], folds: int, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Mean, std (n-1), min and max over folds; absent folds count as 0.

    ``report`` is wide: keys, fold, label and the measures.
    """
    frame = cells.select(*keys, "label").distinct().withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(folds)])))
    joined = null_safe(frame, report, [*keys, "fold", "label"], "left").fillna(0.0, list(measures))
    aggs = []
    for m in measures:
        aggs += [F.avg(m).alias(f"mean_{m}"), F.stddev_samp(m).alias(f"std_{m}"), F.min(m).alias(f"min_{m}"), F.max(m).alias(f"max_{m}")]
    return joined.groupBy(*keys, "label").agg(*aggs)


def long_report(report: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One line per measure, as the result grids are compared."""
    lines = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in measures])
    return report.withColumn("_l", F.explode(lines)).select(*keys, "_l.*")


def flatten_report(texts: DataFrame, keys: Sequence[str], json: str = "json") -> DataFrame:
    """Nested report JSON ``{label: {measure: value}}`` as lines, NaN and gaps as 0."""
    kind = T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))
    parsed = texts.withColumn("_r", F.from_json(json, kind))
    labels = parsed.select(*keys, F.explode("_r").alias("label", "_m"))
    return labels.select(*keys, "label", F.explode("_m").alias("metric", "value")).withColumn(
        "value", F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)))


def grid_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two result grids aligned on their cells; ``diff`` = first - second."""
    left = a.select(*keys, F.col("value").alias("value_a"))
    right = b.select(*keys, F.col("value").alias("value_b"))
    return null_safe(left, right, keys).withColumn("diff", F.col("value_a") - F.col("value_b"))


def figure_series(grid: DataFrame, unsampled: DataFrame, baseline: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Bars with error: mean, mean-min below and max-mean above.

    ``unsampled`` (no b) joins as b=1; ``baseline`` (one line per label) is attached.
    """
    rows = grid.unionByName(unsampled.withColumn("b", F.lit(1.0)))
    mean = F.col(f"mean_{measure}")
    bars = rows.select(
        *keys, mean.alias("mean"), (mean - F.col(f"min_{measure}")).alias("below"), (F.col(f"max_{measure}") - mean).alias("above"))
    base = baseline.select("label", F.col(f"mean_{measure}").alias("baseline"))
    return null_safe(bars, base, ["label"], "left")
