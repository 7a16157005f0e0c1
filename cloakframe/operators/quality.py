"""Quality of a generalized table, measured on distinct raw tuples with counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.definition import STAR, Definition
from cloakframe.operators import lattice as L
from cloakframe.operators.privacy import Model, class_verdicts
from cloakframe.operators.ranking import null_safe
from cloakframe.session import materialize


def coded(df: DataFrame, definition: Definition, node: dict[str, int], models: Sequence[Model]) -> DataFrame:
    """Distinct raw tuples with, per attribute, label, leaves and domain after
    publishing at ``node``; suppressed tuples carry the whole domain."""
    extra = sorted({c for m in models for c in m.columns})
    qid, prepared = definition.qid, L.prepare(df, definition, extra)
    at = prepared.base
    for q in qid:
        lookup = prepared.levels.filter((F.col("attribute") == q) & (F.col("level") == node[q]))
        lookup = lookup.select(
            F.col("raw").alias("_raw"), F.col("label").alias(f"g_{q}"), F.col("leaves").alias(f"lf_{q}"), F.col("domain").alias(f"dm_{q}"))
        at = at.join(lookup, F.col(q).cast("string").eqNullSafe(F.col("_raw"))).drop("_raw")
    keys = [f"g_{q}" for q in qid]
    verdicts = class_verdicts(at, keys, models).select(*keys, "n", "ok")
    out = null_safe(at, verdicts, keys)
    ok = F.col("ok")
    for q in qid:
        out = out.withColumns({
            f"lf_{q}": F.when(ok, F.col(f"lf_{q}")).otherwise(F.col(f"dm_{q}")),
            f"h_{q}": F.when(ok, F.lit(node[q])).otherwise(F.lit(definition.hierarchy(q).height)),
            f"g_{q}": F.when(ok, F.col(f"g_{q}")).otherwise(F.lit(STAR)),
        })
    return materialize(out, "coded")


def _mean(c: Column) -> Column:
    return F.sum(c * F.col("cnt")) / F.sum("cnt")


def ambiguity(code: DataFrame, qid: Sequence[str]) -> DataFrame:
    product = F.lit(1.0)
    for q in qid:
        product = product * F.col(f"lf_{q}")
    return code.agg(_mean(product).alias("ambiguity"))


def aecs(code: DataFrame, qid: Sequence[str]) -> DataFrame:
    sizes = code.groupBy(*[f"g_{q}" for q in qid]).agg(F.sum("cnt").alias("n"))
    return sizes.agg((F.sum("n") / F.count("*")).alias("aecs"))


def discernibility(code: DataFrame, qid: Sequence[str]) -> DataFrame:
    """Each row costs its class size, a suppressed row the table size."""
    sizes = code.groupBy(*[f"g_{q}" for q in qid], "ok").agg(F.sum("cnt").alias("n"))
    n = F.col("n").cast("double")
    return sizes.agg(
        (F.sum(F.when(F.col("ok"), n * n).otherwise(0.0)) + F.sum(F.when(F.col("ok"), 0.0).otherwise(n)) * F.sum(n)).alias("discernibility"))


def granularity(code: DataFrame, qid: Sequence[str]) -> DataFrame:
    loss = F.lit(0.0)
    for q in qid:
        loss = loss + L.cell_loss(F.col(f"lf_{q}"), F.col(f"dm_{q}"))
    return code.agg((F.lit(1.0) - _mean(loss / len(qid))).alias("granularity"))


def precision(code: DataFrame, definition: Definition) -> DataFrame:
    share = F.lit(0.0)
    for q in definition.qid:
        share = share + F.col(f"h_{q}") / F.lit(definition.hierarchy(q).height)
    return code.agg((F.lit(1.0) - _mean(share / len(definition.qid))).alias("precision"))


def entropy(code: DataFrame, qid: Sequence[str]) -> DataFrame:
    """Bits lost per attribute: raw frequency against that of the published label."""
    parts = None
    for q in qid:
        raw = code.groupBy(F.col(q).cast("string").alias("raw"), F.col(f"g_{q}").alias("label")).agg(F.sum("cnt").alias("c"))
        f_raw = raw.groupBy("raw").agg(F.sum("c").alias("f_raw"))
        f_label = code.groupBy(F.col(f"g_{q}").alias("label")).agg(F.sum("cnt").alias("f_label"))
        joined = null_safe(null_safe(raw, f_raw, ["raw"]), f_label, ["label"])
        share = F.least(F.lit(1.0), F.col("f_raw") / F.col("f_label"))
        one = joined.agg(F.lit(q).alias("attribute"), F.sum(-F.col("c") * F.log2(share)).alias("bits"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def attribute_squared_error(code: DataFrame, numbers: dict[str, Column]) -> DataFrame:
    """1 - SSE/SST per numeric attribute; a label stands for the mean of its raw values.

    Sums are shifted by the overall mean before squaring to keep their precision.
    """
    parts = None
    for q, number in numbers.items():
        valued = code.select(F.col(f"g_{q}").alias("label"), "cnt", number.cast("double").alias("x")).filter("x is not null")
        mean = valued.agg((F.sum(F.col("x") * F.col("cnt")) / F.sum("cnt")).alias("m")).scalar()
        d = F.col("x") - mean
        groups = valued.groupBy("label").agg(
            F.sum("cnt").alias("n"), F.sum(d * F.col("cnt")).alias("s"), F.sum(d * d * F.col("cnt")).alias("ss"))
        inside = F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n"))
        one = groups.agg(F.lit(q).alias("attribute"), (F.lit(1.0) - F.try_divide(inside, F.sum("ss"))).alias("quality"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def record_squared_error(code: DataFrame, qid: Sequence[str], numbers: dict[str, Column]) -> DataFrame:
    """As above over all numeric attributes scaled to [0, 1] and whole classes."""
    names = list(numbers)
    valued = code.select(*[F.col(f"g_{q}") for q in qid], "cnt", *[numbers[q].cast("double").alias(f"x_{q}") for q in names])
    ends = valued.agg(F.struct(*[F.struct(
        F.min(f"x_{q}").alias("lo"), F.max(f"x_{q}").alias("hi"),
        (F.sum(F.col(f"x_{q}") * F.col("cnt")) / F.sum("cnt")).alias("m")).alias(q) for q in names]).alias("e")).scalar()
    scaled = valued.withColumn("_e", ends)
    sums = [F.sum("cnt").alias("n")]
    for q in names:
        span = F.col(f"_e.{q}.hi") - F.col(f"_e.{q}.lo")
        d = F.when(span > 0, (F.col(f"x_{q}") - F.col(f"_e.{q}.m")) / span).otherwise(F.lit(0.0))
        sums += [F.sum(d * F.col("cnt")).alias(f"s_{q}"), F.sum(d * d * F.col("cnt")).alias(f"ss_{q}")]
    groups = scaled.groupBy(*[f"g_{q}" for q in qid]).agg(*sums)
    inside, total = F.lit(0.0), F.lit(0.0)
    for q in names:
        inside = inside + F.col(f"ss_{q}") - F.col(f"s_{q}") * F.col(f"s_{q}") / F.col("n")
        total = total + F.col(f"ss_{q}")
    return groups.agg((F.lit(1.0) - F.try_divide(F.sum(inside), F.sum(total))).alias("quality"))
