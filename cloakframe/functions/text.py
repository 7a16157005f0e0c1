"""Scalar expressions on strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.definition import STAR


def mean_spread(mean: Column, spread: Column) -> Column:
    """``mean ± spread`` with one decimal; an undefined spread prints ``nan``."""

    def one(c: Column) -> Column:
        return F.when(c.isNull(), F.lit("nan")).otherwise(F.format_string("%.1f", F.bround(c, 1)))

    return F.concat(one(mean), F.lit(" ± "), one(spread))


def range_text(low: Column, high: Column) -> Column:
    return F.concat(F.lit("["), low.cast("string"), F.lit(", "), high.cast("string"), F.lit("]"))


def decimal_comma(c: Column) -> Column:
    """A number as text with a decimal comma."""
    return F.translate(c.cast("string"), ".", ",")


def parse_decimal_comma(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def range_bounds(c: Column) -> tuple[Column, Column]:
    """Lower and upper number of a range such as ``[20, 40[``."""
    pattern = r"^.(-?\d+), (-?\d+).$"
    return (
        F.regexp_extract(c, pattern, 1).try_cast("double"),
        F.regexp_extract(c, pattern, 2).try_cast("double"),
    )


def range_midpoint(c: Column) -> Column:
    low, high = range_bounds(c)
    return F.when(F.contains(c, F.lit(STAR)), F.lit(None)).otherwise((low + high) / 2)
