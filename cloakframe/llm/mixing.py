"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.session import materialize

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Runs without blank or 0x09-0x0D; none for NULL."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), "")
    return F.size(words).cast("bigint")


def targets(sources: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``: the water-filling.

    Sources in order of their names (code points, NULL last) weigh ``weights``, repeating. With sources sorted by
    cap / weight, the capped ones are a prefix: a source is capped if the level left to it and all later ones, (total -
    caps before) / (weights from here on), exceeds its own cap / weight. The rest share what the caps leave. This is
    where repeated clamping and resharing ends. One row per source is sorted in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    cap = F.col("source_size") * float(max_epochs)
    by_level = Window.orderBy("_level", F.col("source").asc_nulls_last())
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        sources.withColumn("_weight", weight).withColumn("_level", F.col("source_size") / F.col("_weight"))
        .withColumn("_cap", cap)
        .withColumn("_caps", F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_weights", F.sum("_weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_capped", (F.col("_total") - F.col("_caps")) * F.col("_weight") > F.col("_cap") * F.col("_weights"))
        .withColumn("_left", F.max(F.when(F.col("_capped"), F.col("_caps") + F.col("_cap")).otherwise(0.0)).over(everything))
        .withColumn("_sharing", F.sum(F.when(F.col("_capped"), 0.0).otherwise(F.col("_weight"))).over(everything))
    )
    shared = F.col("_weight") * (F.col("_total") - F.col("_left")) / F.col("_sharing")
    return filled.select("source", "source_size", F.when(F.col("_capped"), F.col("_cap")).otherwise(shared).alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = 3, seed: int = 7, text: str = "text",
) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target``, ``repeats`` and ``taken`` = size * repeats.

    A source takes every document ``floor(target / source_size)`` times and, for the remainder, once more in order of a
    seeded hash of the doc_id until the next document would lead further from the target. The cut is found on a histogram of
    4096 hash ranges for each source and inside one of these, so a source with a third of all rows needs no task of its
    own. ``docs`` meets one row per source again, by a broadcast if Spark measures that table as small.

    NULL and empty texts have size 0; NULL sources are one source; rows with equal hash and size in a source (repeated
    rows) are taken alike; an empty table gives no rows. Columns of ``docs`` that bear a result's name are replaced.
    """
    results = ("size", "source_size", "target", "repeats", "taken")
    docs = docs.drop(*(c for c in results if c in docs.columns))
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = materialize(docs.select("source", word_count(F.col(text)).alias("size"), order.alias("h")), "sizes")
    bucket = F.substring("h", 1, 3)
    histogram = materialize(rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n")), "histogram")
    planned = materialize(
        targets(histogram.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets")

    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plan = planned.select(F.col("source").alias("_source"), "rest")
    cuts = (
        histogram.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn("upto", F.sum("n").over(running))
        .where("upto > rest").groupBy("source", "rest").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("cut"))
        .select(F.col("source").alias("_source"), F.col("cut.bucket").alias("_bucket"), F.col("cut.before").alias("before"), "rest"))
    cuts = materialize(cuts, "cuts")
    inside = rows.withColumn("bucket", bucket).join(cuts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    ties = inside.groupBy("source", "h", "size").agg(F.sum("size").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    ordered = Window.partitionBy("source").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        ties.withColumn("upto", F.col("before") + F.sum("n").over(ordered)).where("upto - n / 2 <= rest")
        .groupBy("source").agg(F.max(F.struct("h", "size")).alias("last")))
    # Below the cut's bucket all are taken; a source without a cut has no remainder to reach, or takes all for it.
    ends = cuts.join(last, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "_source", F.coalesce("last.h", "_bucket").alias("end_h"), F.coalesce("last.size", F.lit(-1)).alias("end_size"))
    decided = materialize(
        planned.join(ends, F.col("source").eqNullSafe(F.col("_source")), "left").select(
            F.col("source").alias("_source"), "source_size", "target", "whole", "end_h", "end_size"), "decided")

    joined = docs.withColumn("size", word_count(F.col(text))).withColumn("_h", order).join(
        decided, F.col("source").eqNullSafe(F.col("_source")))
    more = F.col("end_h").isNull() | (F.col("_h") < F.col("end_h")) | ((F.col("_h") == F.col("end_h")) & (F.col("size") <= F.col("end_size")))
    # With nothing left over there is no extra copy, not even of empty documents before the first with words.
    extra = F.when(more & (F.col("target") > F.col("whole") * F.col("source_size")), 1).otherwise(0)
    return joined.withColumn("repeats", (F.col("whole") + extra).cast("int")).withColumn(
        "taken", F.col("size") * F.col("repeats")).select(*docs.columns, *results)
