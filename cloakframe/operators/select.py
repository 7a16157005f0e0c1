"""Selecting rows, masking, cleansing and describing columns."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.definition import STAR
from cloakframe.functions.hashing import order_hash
from cloakframe.operators.ranking import first_of_each, null_safe, ranked


class Selector:
    """Boolean condition in the order a user says it.

    ``Selector.field("a").equals("x").or_().equals("y")`` reuses field ``a``. ``and_``
    binds stronger than ``or_``; use ``group`` for brackets.
    """

    def __init__(self, alternatives: tuple[tuple[Column, ...], ...] = ((),), name: str | None = None):
        self._alternatives, self._name = alternatives, name

    @classmethod
    def field(cls, name: str) -> Selector:
        return cls(name=name)

    def on(self, name: str) -> Selector:
        return Selector(self._alternatives, name)

    def _add(self, condition: Column) -> Selector:
        *done, last = self._alternatives
        return Selector((*done, (*last, condition)), self._name)

    def equals(self, value) -> Selector:
        return self._add(F.col(self._name) == F.lit(value))

    def group(self, inner: Selector) -> Selector:
        return self._add(inner.column())

    def and_(self) -> Selector:
        return self

    def or_(self) -> Selector:
        return Selector((*self._alternatives, ()), self._name)

    def column(self) -> Column:
        terms = [functools.reduce(lambda a, b: a & b, group) for group in self._alternatives if group]
        return functools.reduce(lambda a, b: a | b, terms)


def where(df: DataFrame, selector: Selector) -> DataFrame:
    return df.filter(selector.column())


def subset_rows(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose number is listed; also the view of an output on a subset."""
    return df.join(ids.select(id_col).distinct(), id_col, "left_semi")


def subset_match(df: DataFrame, other: DataFrame, columns: Sequence[str], ids: Sequence[str], other_ids: Sequence[str], seed: int = 0) -> DataFrame:
    """Rows that occur in another table, as often as they occur there.

    Both sides number their copies of a tuple, so that two copies there select two
    rows here.
    """
    left = ranked(df, columns, ids, order_hash(seed, ids), rank="_copy")
    right = ranked(other, columns, other_ids, order_hash(seed, other_ids), rank="_copy").select(*columns, "_copy")
    return null_safe(left, right, [*columns, "_copy"], "left_semi").drop("_copy")


def mark_subset(df: DataFrame, ids: DataFrame, id_col: str, name: str = "in_subset") -> DataFrame:
    listed = ids.select(id_col).distinct().withColumn(name, F.lit(True))
    return df.join(listed, id_col, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def mask(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Identifying attributes keep their place but show only ``*``."""
    return df.withColumns({c: F.lit(STAR) for c in columns})


def replace_value(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column)))


# The value types a column of text may be declared as.
TYPES = ("string", "integer", "decimal", "date")


def parsed(c: Column, kind: str, fmt: str | None = None) -> Column:
    """The value of text under a declared type, NULL where it does not parse."""
    if kind == "integer":
        return F.when(F.rlike(c, F.lit(r"^[+-]?\d+$")), c.try_cast("bigint"))
    if kind == "decimal":
        return F.when(F.rlike(c, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), c.try_cast("double"))
    if kind == "date":
        return F.try_to_timestamp(c, F.lit(fmt or "yyyy-MM-dd")).cast("date")
    return c


def cleanse(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Text that is no value of the declared type becomes NULL."""
    return df.withColumns(
        {c: F.when(parsed(F.col(c), kind).isNotNull(), F.col(c)) for c, kind in declared.items()}
    )


def detect_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of non-NULL values that fit each type, all columns in one pass."""
    sums = []
    for c in columns:
        sums.append(F.count(c).alias(f"{c}|all"))
        sums += [F.count(parsed(F.col(c), t)).alias(f"{c}|{t}") for t in TYPES]
    totals = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).agg(*sums)
    lines = [
        F.struct(
            F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"`{c}|{t}`").alias("matches"),
            F.try_divide(F.col(f"`{c}|{t}`"), F.col(f"`{c}|all`")).alias("fraction"),
        )
        for c in columns for t in TYPES
    ]
    return totals.select(F.explode(F.array(*lines)).alias("r")).select("r.*")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    totals = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns], F.count("*").alias("_n"))
    lines = [F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls"), F.col("_n").alias("n_rows")) for c in columns]
    return totals.select(F.explode(F.array(*lines)).alias("r")).select("r.*")


def peek(df: DataFrame, n: int, ids: Sequence[str], seed: int) -> DataFrame:
    """``n`` rows picked by seeded hash."""
    size = df.agg(F.least(F.count("*"), F.lit(n)).cast("bigint").alias("quota"))
    return first_of_each(df, [], size, order_hash(seed, ids))
