"""Builders and queries for generalization hierarchies.

Intervals, dates and redaction are pure column expressions. Order and priority
hierarchies depend on all values of a column and are built as tables of its
distinct values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.definition import STAR, Definition, Hierarchy
from cloakframe.operators.ranking import null_safe, ordered_positions


def redaction(width: int, right_to_left: bool = True, align_left: bool = True, pad: str = " ", mark: str = STAR, alphabet: int | None = None) -> Hierarchy:
    """One more character masked per level; values are padded to ``width``.

    With the size of the ``alphabet``, ``i`` masked characters stand for
    ``alphabet^i`` values when loss is measured.
    """

    def level(i: int):
        def apply(c: Column) -> Column:
            text = c.cast("string")
            full = F.rpad(text, width, pad) if align_left else F.lpad(text, width, pad)
            masked = F.repeat(F.lit(mark), F.lit(i))
            if right_to_left:
                return F.concat(F.substring(full, 1, width - i), masked)
            return F.concat(masked, F.substring(full, i + 1, width - i))

        return apply

    exprs = tuple(level(i) for i in range(1, width + 1))
    sizes = tuple(float(alphabet) ** i for i in range(width + 1)) if alphabet else None
    return Hierarchy(height=width, exprs=exprs, leaves=sizes)


def dates(granularities: Sequence[str]) -> Hierarchy:
    """``month``, ``week_year``, ``quarter_year``, ``year`` in that order, then ``*``."""
    known = {
        "week_year": lambda c: F.concat(
            F.lpad(F.weekofyear(c).cast("string"), 2, "0"), F.lit("/"), F.extract(F.lit("YEAROFWEEK"), c).cast("string")
        ),
        "month": lambda c: F.date_format(c, "yyyy-MM"),
        "quarter_year": lambda c: F.concat(F.quarter(c).cast("string"), F.lit("/"), F.year(c).cast("string")),
        "year": lambda c: F.year(c).cast("string"),
    }
    return Hierarchy.functional(*[known[g] for g in granularities], lambda c: F.lit(STAR))


def _label(low: Column, high: Column, decimals: int) -> Column:
    kind = "bigint" if decimals == 0 else f"decimal(30,{decimals})"
    return F.concat(F.lit("["), low.cast(kind).cast("string"), F.lit(", "), high.cast(kind).cast("string"), F.lit("["))


@dataclass(frozen=True)
class Bound:
    """One end of an interval hierarchy.

    From ``coding`` on (below or above) values get a bound label. Values between ``snap`` and ``coding`` belong to the interval
    at ``snap``, which is extended to ``coding``. Values beyond ``last`` are out of range and have no label.
    """

    snap: float
    coding: float
    last: float

    @staticmethod
    def of(x: float | Bound, beyond: float) -> Bound:
        return x if isinstance(x, Bound) else Bound(x, x, beyond)


def _searched(value: Column, edges: Sequence[float], low: int, high: int) -> Column:
    """Which of the spans ``low`` to ``high`` that begin at sorted ``edges`` holds ``value``, by halving."""
    if low == high:
        return F.lit(low)
    middle = (low + high + 1) // 2
    return F.when(value < F.lit(edges[middle]), _searched(value, edges, low, middle - 1)).otherwise(_searched(value, edges, middle, high))


def intervals(
    widths: Sequence[float],
    origin: float,
    low: float | Bound,
    high: float | Bound,
    fanouts: Sequence[Sequence[int]] = (),
    labels: Sequence[Sequence[str]] = (),
    decimals: int = 0,
) -> Hierarchy:
    """Base intervals repeated over ``[low, high[``, then grouped level by level.

    ``widths`` are the base intervals from ``origin`` on and repeat with their total
    width as period; ``fanouts[i]`` tells how many intervals of the level below each
    group of level ``i`` joins and repeats likewise. Values below ``low`` or from
    ``high`` on get a bound label, NULL stays NULL and the top level is ``*``; a ``Bound``
    parts snapping, bound labels and the range itself.
    ``labels[i]``, if given, name the groups of one period of level ``i``.
    """
    bottom, top = Bound.of(low, -math.inf), Bound.of(high, math.inf)
    levels: list[list[float]] = [list(widths)]
    for group in fanouts:
        below, merged, position = levels[-1], [], 0
        for size in group:
            merged.append(sum(below[(position + j) % len(below)] for j in range(size)))
            position += size
        levels.append(merged)

    def level(i: int):
        spans = levels[i]
        period = float(sum(spans))
        starts = [float(sum(spans[:j])) for j in range(len(spans))]

        def apply(c: Column) -> Column:
            v = c.cast("double")
            inner = v
            if bottom.snap > bottom.coding:
                inner = F.greatest(inner, F.lit(float(bottom.snap)))
            if top.snap < top.coding:
                inner = F.least(inner, F.lit(math.nextafter(top.snap, -math.inf)))
            base = F.lit(float(origin)) + F.floor((inner - F.lit(float(origin))) / F.lit(period)).cast("double") * F.lit(period)
            at = _searched(inner - base, starts, 0, len(spans) - 1)
            if i < len(labels) and labels[i]:
                text = F.array(*[F.lit(x) for x in labels[i]])[at]
            else:
                begin = base + F.array(*[F.lit(x) for x in starts])[at]
                end = base + F.array(*[F.lit(x + float(w)) for x, w in zip(starts, spans, strict=True)])[at]
                if bottom.snap > bottom.coding:
                    begin = F.when(begin <= F.lit(float(bottom.snap)), F.lit(float(bottom.coding))).otherwise(begin)
                if top.snap < top.coding:
                    end = F.when(end >= F.lit(float(top.snap)), F.lit(float(top.coding))).otherwise(end)
                text = _label(begin, end, decimals)
            return (
                F.when(v.isNull() | (v < F.lit(bottom.last)) | (v >= F.lit(top.last)), F.lit(None).cast("string"))
                .when(v < F.lit(float(bottom.coding)), F.lit(f"<{bottom.coding:g}"))
                .when(v >= F.lit(float(top.coding)), F.lit(f">={top.coding:g}"))
                .otherwise(text)
            )

        return apply

    return Hierarchy.functional(*[level(i) for i in range(len(levels))], lambda c: F.lit(STAR))


def order_table(df: DataFrame, column: str, fanouts: Sequence[int]) -> DataFrame:
    """Distinct values in order, joined in groups of ``fanouts[0]``, those in groups
    of ``fanouts[1]`` and so on; labels show the ends of a group."""
    values = df.select(F.col(column).alias("value")).filter("value is not null").distinct()
    placed = ordered_positions(values, ["value"])
    size, levels = 1, [F.col("value").cast("string")]
    for i, fanout in enumerate(fanouts):
        size *= fanout
        group = f"_g{i}"
        placed = placed.withColumn(group, F.floor((F.col("_rank") - 1) / size))
        ends = placed.groupBy(group).agg(F.min("value").alias(f"_lo{i}"), F.max("value").alias(f"_hi{i}"))
        placed = null_safe(placed, ends, [group])
        levels.append(F.concat(F.lit("["), F.col(f"_lo{i}").cast("string"), F.lit(", "), F.col(f"_hi{i}").cast("string"), F.lit("]")))
    return placed.select(F.col("value").cast("string").alias("value"), F.array(*levels, F.lit(STAR)).alias("levels"))


def priority_table(values: DataFrame, column: str, priority: str, max_levels: int) -> DataFrame:
    """Values by priority: level ``i`` masks the lowest ``i/(max_levels-1)`` of them.

    The highest priorities stay visible longest; the top level masks everything.
    """
    steps = max_levels - 1
    distinct = values.groupBy(F.col(column).cast("string").alias("value")).agg(F.max(priority).alias("_p"))
    total = distinct.agg(F.count("*").alias("c")).scalar()
    placed = ordered_positions(distinct, ["_p", "value"], "_r").withColumn("_c", total)
    levels = [F.col("value")]
    for i in range(1, steps + 1):
        hidden = F.col("_r") <= F.ceil(F.col("_c") * F.lit(i) / F.lit(steps))
        levels.append(F.when(hidden, F.lit(STAR)).otherwise(F.col("value")))
    return placed.select("value", F.array(*levels).alias("levels"))


def edges(table: DataFrame) -> DataFrame:
    """Distinct child-parent pairs, with the level of the child."""
    pairs = table.select(F.posexplode(F.arrays_zip(
        F.slice("levels", F.lit(1), F.size("levels") - 1).alias("child"),
        F.slice("levels", F.lit(2), F.size("levels") - 1).alias("parent"),
    )).alias("level", "pair"))
    return pairs.select("level", "pair.child", "pair.parent").distinct()


def level_sizes(table: DataFrame) -> DataFrame:
    """How many different values each level has."""
    exploded = table.select(F.posexplode("levels").alias("level", "label"))
    return exploded.groupBy("level").agg(F.count_distinct("label").alias("values"))


def generalize(df: DataFrame, definition: Definition, node: dict[str, int]) -> DataFrame:
    """Replace each quasi-identifier by its label at the level of ``node``.

    Values an explicit hierarchy does not list become NULL.
    """
    replaced = {}
    for q, level in node.items():
        h = definition.hierarchy(q)
        if h.exprs is not None:
            replaced[q] = F.col(q).cast("string") if level == 0 else h.exprs[level - 1](F.col(q)).cast("string")
        else:
            lookup = h.table.select(F.col("value").alias(f"_v_{q}"), F.col("levels")[level].alias(f"_g_{q}"))
            df = df.join(lookup, F.col(q).cast("string") == F.col(f"_v_{q}"), "left")
            replaced[q] = F.col(f"_g_{q}")
    columns = df.columns
    return df.select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in columns if not c.startswith(("_v_", "_g_"))])
