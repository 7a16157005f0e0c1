"""Exact-size samples and cross-validation folds.

Sample sizes are settled on the table of classes, never on rows; rows are then taken
in the order of a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.functions.hashing import hash_int, order_hash
from cloakframe.operators.classes import class_sizes, drop_suppressed
from cloakframe.operators.ranking import (
    ROWS_PER_TASK,
    first_of_each,
    null_safe,
    ranked,
    with_cut_position,
)
from cloakframe.session import materialize


OVERSAMPLE_RANGE = 250_000  # rows of one value that a task of ``oversample`` ranks


def _share(b: float) -> float:
    if not 0.0 <= b <= 1.0:
        raise ValueError("sample size must be in range [0, 1]")
    return float(b)


def sample_amount(n: Column, b: float | Column) -> Column:
    b = F.lit(_share(b)) if not isinstance(b, Column) else b
    return F.floor(n.cast("double") * b).cast("bigint")


# ---------------------------------------------------------------- random samples


def random_sample(df: DataFrame, b: float, ids: Sequence[str], seed: int) -> DataFrame:
    """``floor(N*b)`` rows without replacement."""
    quota = df.agg(sample_amount(F.count("*"), b).alias("quota"))
    return first_of_each(df, [], quota, order_hash(seed, ids))


def train_test(df: DataFrame, train: float, ids: Sequence[str], seed: int) -> DataFrame:
    """Adds ``split``: ``train`` for ``floor(N*train)`` rows, ``test`` for the rest."""
    quota = df.agg(sample_amount(F.count("*"), train).alias("quota")).withColumn("slot", F.lit(0))
    placed = with_cut_position(df, "_cut", quota, order_hash(seed, ids))
    empty = quota.select("quota").scalar() == 0
    return placed.withColumn("split", F.when(empty | (F.col("_cut") > 0), "test").otherwise("train")).drop("_cut")


def k_fold(df: DataFrame, folds: int, ids: Sequence[str], seed: int) -> DataFrame:
    """Adds ``fold`` (0-based); the first ``N % folds`` folds hold one row more.

    Only the fold boundaries are looked up; rows are assigned by comparing their
    hash with them, so neither a global sort nor a single-task window is needed.
    """
    bounds = (
        df.agg(F.count("*").alias("n"))
        .select("n", F.explode(F.array(*[F.lit(i) for i in range(1, folds)])).alias("slot"))
        .select(
            "slot",
            (F.col("slot") * F.floor(F.col("n") / folds) + F.least(F.col("slot"), F.col("n") % folds))
            .cast("bigint")
            .alias("quota"),
        )
    )
    return with_cut_position(df, "fold", bounds, order_hash(seed, ids))


# ------------------------------------------------------------ stratified samples


def _le(n: np.ndarray, ratio: float) -> np.ndarray:
    """Largest j with ``j / n <= ratio`` in double arithmetic."""
    j = np.floor(n * ratio)
    j += (j + 1) / n <= ratio
    return j - (j / n > ratio)


def _settle(hist: pd.DataFrame, cells: Sequence[str]) -> pd.DataFrame:
    """Smallest ratio whose classes fill the quota, found by bisection.

    Works on the histogram of class sizes: k distinct sizes need k(k+1)/2 rows, so
    one cell has at most sqrt(2N) lines whatever the number of classes.
    """
    n, c = hist["n"].to_numpy(float), hist["classes"].to_numpy(float)
    quota = int(hist["quota"].iloc[0])
    low, high = np.int64(0), np.float64(1.0).view(np.int64)
    while low < high and quota > 0:
        mid = low + (high - low) // 2
        if (c * _le(n, mid.view(np.float64))).sum() >= quota:
            high = mid
        else:
            low = mid + 1
    ratio = float(np.int64(high).view(np.float64)) if quota > 0 else 0.0
    full = _le(n, ratio)
    tied = (full > 0) & (full / n == ratio)
    spare = int((c * (full - tied)).sum())
    row = {k: [hist[k].iloc[0]] for k in cells}
    return pd.DataFrame({**row, "ratio": [ratio], "ties": [quota - spare]})


def stratified_sizes(
    classes: DataFrame,
    cells: Sequence[str],
    items: Sequence[str],
    quotas: DataFrame,
    seed: int,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """How many rows each class gives so that every cell reaches its quota.

    ``classes``: cells, items, ``n``. ``quotas``: cells, ``quota``. The result adds
    ``s``. Each next row goes to the class whose sampled share would be smallest;
    classes that tie for the last rows are taken in hash order.
    """
    cells, items = list(cells), list(items)
    hist = classes.groupBy(*cells, "n").agg(F.count("*").alias("classes"))
    hist = null_safe(hist, quotas, cells) if cells else hist.withColumn("quota", quotas.select("quota").scalar())
    fields = "".join(f"`{k}` {classes.schema[k].dataType.simpleString()}, " for k in cells)
    settled = hist.groupBy(*cells).applyInPandas(
        lambda pdf: _settle(pdf, cells), f"{fields}ratio double, ties bigint"
    )
    # The classes with their cell's ratio are read several times below.
    if cells:
        joined = null_safe(classes, settled, cells)
    else:
        joined = classes.withColumn("_s", settled.select(F.struct("ratio", "ties").alias("s")).scalar())
        joined = joined.select(*classes.columns, "_s.ratio", "_s.ties")
    joined = materialize(joined, "classes")
    n, ratio = F.col("n").cast("double"), F.col("ratio")
    guess = F.floor(n * ratio).cast("double")
    up = F.when((guess + 1) / n <= ratio, guess + 1).otherwise(guess)
    full = F.when(up / n > ratio, up - 1).otherwise(up)
    sized = joined.withColumn("_full", full).withColumn(
        "_tied", (F.col("_full") > 0) & (F.col("_full") / n == ratio)
    )
    tied = ranked(
        sized.filter("_tied").select(*cells, *items, "ties"),
        cells,
        items,
        order_hash(seed, [*cells, *items]),
        rank="_tie_rank",
        rows_per_task=rows_per_task,
    )
    last = tied.filter(F.col("_tie_rank") <= F.col("ties")).select(*cells, *items, F.lit(1).alias("_win"))
    out = null_safe(sized, last, [*cells, *items], "left").withColumn(
        "s",
        (F.col("_full") - F.when(F.col("_tied"), 1).otherwise(0) + F.coalesce("_win", F.lit(0))).cast("bigint"),
    )
    return out.drop("ratio", "ties", "_full", "_tied", "_win")


def take_sizes(df: DataFrame, keys: Sequence[str], sizes: DataFrame, ids: Sequence[str], seed: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The first ``s`` rows of every class in hash order."""
    sizes = materialize(sizes.select(*keys, F.col("n").alias("_n"), "s"), "sizes")
    wanted = null_safe(df, sizes.filter("s > 0").select(*keys, "s"), keys)
    rows = ranked(wanted, keys, ids, order_hash(seed, ids), rank="_rank", rows_per_task=rows_per_task, sizes=sizes.drop("s"))
    return rows.filter("_rank <= s").drop("_rank", "s")


def stratified_sample(df: DataFrame, qid: Sequence[str], b: float, ids: Sequence[str], seed: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``floor(N*b)`` rows spread over the classes in proportion to their size."""
    classes = class_sizes(df, qid)
    quotas = classes.agg(sample_amount(F.coalesce(F.sum("n"), F.lit(0)), b).alias("quota"))
    sizes = stratified_sizes(classes, [], qid, quotas, seed, rows_per_task)
    return take_sizes(df, qid, sizes, ids, seed, rows_per_task)


def even_amounts(counts: DataFrame, cells: Sequence[str], target: str, quotas: DataFrame, seed: int) -> DataFrame:
    """Spread each cell's quota equally over its target values.

    Values too small for their part give all they have; the rest is shared equally
    by the larger ones, the odd rows going to the first in hash order.
    """
    cells = list(cells)
    scope = cells or [F.lit(0)]
    keyed = null_safe(counts, quotas, cells) if cells else counts.withColumn("quota", quotas.scalar())
    w = Window.partitionBy(*scope)
    by_size = w.orderBy("n", target)
    before = F.coalesce(F.sum("n").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    position = F.row_number().over(by_size)
    marked = (
        keyed.withColumn("_left", F.count("*").over(w) - position + 1)
        .withColumn("_full", before + F.col("n") * F.col("_left") <= F.col("quota"))
        .withColumn("_spent", F.sum(F.when(F.col("_full"), F.col("n")).otherwise(0)).over(w))
        .withColumn("_open", F.sum(F.when(F.col("_full"), 0).otherwise(1)).over(w))
    )
    order = Window.partitionBy(*scope, "_full").orderBy(order_hash(seed, [*cells, target]), target)
    rest = F.col("quota") - F.col("_spent")
    share = F.floor(rest / F.col("_open")) + F.when(F.row_number().over(order) <= rest % F.col("_open"), 1).otherwise(0)
    out = marked.withColumn("amount", F.when(F.col("_full"), F.col("n")).otherwise(share).cast("bigint"))
    return out.drop("_left", "_full", "_spent", "_open", "quota")


def balanced_sizes(pairs: DataFrame, cells: Sequence[str], qid: Sequence[str], target: str, quotas: DataFrame, seed: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Sizes per (cell, target, class): equal over targets, proportional over classes."""
    cells = list(cells)
    counts = pairs.groupBy(*cells, target).agg(F.sum("n").alias("n"))
    amounts = even_amounts(counts, cells, target, quotas, seed).withColumnRenamed("amount", "quota").drop("n")
    return stratified_sizes(pairs, [*cells, target], qid, amounts, seed, rows_per_task)


def balanced_sample(df: DataFrame, qid: Sequence[str], target: str, b: float, ids: Sequence[str], seed: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``floor(N*b)`` rows, equally many per target value where there are enough."""
    if target not in df.columns:
        raise ValueError(f"target {target} is not a column")
    pairs = df.groupBy(target, *qid).agg(F.count("*").alias("n"))
    quotas = pairs.agg(sample_amount(F.coalesce(F.sum("n"), F.lit(0)), b).alias("quota"))
    sizes = balanced_sizes(pairs, [], qid, target, quotas, seed, rows_per_task)
    return take_sizes(df, [target, *qid], sizes, ids, seed, rows_per_task)


def certainty_cap_sizes(sample_classes: DataFrame, population_classes: DataFrame, cells: Sequence[str], qid: Sequence[str], b: float | Column, tolerance: float) -> DataFrame:
    """Class sizes after capping the certainty ``n / n_population`` at ``b(1+tolerance)``."""
    keys = [*cells, *qid]
    joined = null_safe(sample_classes, population_classes.withColumnRenamed("n", "n_population"), keys, "left")
    cap = (b if isinstance(b, Column) else F.lit(float(b))) * F.lit(1.0 + tolerance)
    certainty = F.coalesce(F.col("n") / F.col("n_population"), F.lit(0.0))
    return joined.withColumn(
        "s", F.when(certainty < cap, F.col("n")).otherwise(F.floor(F.col("n") / certainty * cap)).cast("bigint")
    )


def certainty_cap(sample: DataFrame, population: DataFrame, qid: Sequence[str], b: float, tolerance: float, ids: Sequence[str], seed: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Thin out classes whose sampled share is above ``b(1+tolerance)``; suppressed rows go."""
    sample, population = drop_suppressed(sample, qid), drop_suppressed(population, qid)
    sizes = certainty_cap_sizes(class_sizes(sample, qid), class_sizes(population, qid), [], qid, b, tolerance)
    return take_sizes(sample, qid, sizes, ids, seed, rows_per_task)


# ------------------------------------------------------------------- balancing


def undersample(df: DataFrame, target: str, ids: Sequence[str], seed: int) -> DataFrame:
    """Every target value reduced to the size of the rarest."""
    counts = class_sizes(df, [target])
    quotas = counts.select(target, counts.agg(F.min("n").alias("m")).scalar().alias("quota"))
    return first_of_each(df, [target], quotas, order_hash(seed, ids))


def oversample(df: DataFrame, target: str, ids: Sequence[str], seed: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Every target value raised to the size of the commonest, with replacement.

    Adds ``draw`` (0 for an original row). Ranks are settled in short ranges, as many tasks as the rows need, and the
    draws of all rarer values are made where they are numbered, spread over the cluster.
    """
    counts = materialize(class_sizes(df, [target]), "counts")
    sizes = counts.select(target, F.col("n").alias("_n"))
    rows = ranked(df, [target], ids, order_hash(seed, ids), rank="_rank", rows_per_task=min(rows_per_task, OVERSAMPLE_RANGE), sizes=sizes)
    most = counts.agg(F.max("n")).first()[0] or 0
    deficits = counts.select(target, "n", (F.lit(most) - F.col("n")).alias("deficit")).filter("deficit > 0")
    lines = df.sparkSession.range(1, most + 1).select(F.col("id").alias("draw"))
    wanted = deficits.agg(F.collect_list(F.struct(target, "n", "deficit")).alias("w")).scalar()
    draws = (
        lines.withColumn("_w", F.explode(wanted))
        .filter(F.col("draw") <= F.col("_w.deficit"))
        .select(F.col("draw"), F.col(f"_w.{target}").alias(target), F.col("_w.n").alias("_n"))
        .withColumn("_rank", hash_int(order_hash(seed, [target, "draw"])) % F.col("_n") + 1)
        .drop("_n")
    )
    extra = null_safe(draws, rows, [target, "_rank"]).select(*df.columns, "draw")
    return df.withColumn("draw", F.lit(0).cast("bigint")).unionByName(extra)


def spread_equally(groups: DataFrame, key: str, amount: int | Column, seed: int) -> DataFrame:
    """``amount`` over all groups in equal parts, the remainder in hash order."""
    amount = F.lit(amount) if isinstance(amount, int) else amount
    total = groups.agg(F.count("*").alias("g")).scalar()
    placed = ranked(groups, [], [key], order_hash(seed, [key]), rank="_rank")
    part = F.floor(amount / total) + F.when(F.col("_rank") <= amount % total, 1).otherwise(0)
    return placed.withColumn("part", part.cast("bigint")).drop("_rank")


SAMPLERS = {"random": random_sample, "stratified": stratified_sample, "balanced": balanced_sample}
