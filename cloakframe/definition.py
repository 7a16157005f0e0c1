"""Column roles and generalization hierarchies of a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAR = "*"


@dataclass(frozen=True)
class Hierarchy:
    """Levels of one attribute; level 0 is the raw value.

    Either ``exprs`` (one Column function per level above the raw value, so that
    generalizing needs no join at all) or ``table`` (``value``, ``levels`` with
    ``levels[0] = value``) is given. ``leaves``, if given, states how many values a
    label of each level may stand for, instead of counting the listed ones.
    """

    height: int
    exprs: tuple[Callable[[Column], Column], ...] | None = None
    table: DataFrame | None = None
    leaves: tuple[float, ...] | None = None

    @staticmethod
    def functional(*exprs: Callable[[Column], Column]) -> Hierarchy:
        return Hierarchy(height=len(exprs), exprs=tuple(exprs))

    @staticmethod
    def explicit(table: DataFrame, height: int) -> Hierarchy:
        return Hierarchy(height=height, table=table)

    @staticmethod
    def from_columns(df: DataFrame, columns: Sequence[str]) -> Hierarchy:
        """Rows ``value; level 1; ...; top`` as they stand in a hierarchy file."""
        levels = F.array(*[F.col(c).cast("string") for c in columns])
        table = df.select(F.col(columns[0]).cast("string").alias("value"), levels.alias("levels"))
        return Hierarchy(height=len(columns) - 1, table=table)

    @staticmethod
    def trivial() -> Hierarchy:
        """Raw value or ``*``; also serves attributes without a hierarchy."""
        return Hierarchy.functional(lambda c: F.lit(STAR))

    def levels(self, column: Column) -> Column:
        """All levels of a functional hierarchy as one array."""
        raw = column.cast("string")
        return F.array(raw, *[e(column).cast("string") for e in self.exprs])

    def materialize(self, df: DataFrame, column: str) -> DataFrame:
        """``(value, levels)`` for every listed value, or every value in ``df``."""
        if self.table is not None:
            return self.table
        values = df.select(column).distinct()
        return values.select(
            F.col(column).cast("string").alias("value"), self.levels(F.col(column)).alias("levels")
        )


@dataclass(frozen=True)
class Definition:
    """Roles of the columns of one table."""

    qid: tuple[str, ...]
    hierarchies: dict[str, Hierarchy] = field(default_factory=dict)
    identifying: tuple[str, ...] = ()
    insensitive: tuple[str, ...] = ()
    sensitive: tuple[str, ...] = ()
    target: str | None = None
    cat: tuple[str, ...] = ()
    num: tuple[str, ...] = ()
    weights: dict[str, float] = field(default_factory=dict)

    def hierarchy(self, attribute: str) -> Hierarchy:
        return self.hierarchies.get(attribute) or Hierarchy.trivial()

    def weight(self, attribute: str) -> float:
        return float(self.weights.get(attribute, 1.0))

    @property
    def heights(self) -> tuple[int, ...]:
        return tuple(self.hierarchy(a).height for a in self.qid)
