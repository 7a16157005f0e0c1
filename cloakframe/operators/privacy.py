"""Privacy models as predicates on aggregates of equivalence classes.

Every model works on a counted table (keys, model columns, ``cnt``), so the same code
judges published rows and all nodes of a lattice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.definition import Hierarchy
from cloakframe.operators.ranking import ROWS_PER_TASK, dealt_by_range, last_below, null_safe, running_total
from cloakframe.session import materialize

EPS = 1e-9  # tolerance for comparisons of accumulated floating point sums


@dataclass(frozen=True)
class Model:
    """Base of all models: ``columns`` it reads and a ``measure`` per class.

    ``monotone``: a class that holds still holds with any other class merged into it, so that no row is suppressed at a
    node that isn't at one below.
    """

    monotone = False

    @property
    def columns(self) -> tuple[str, ...]:
        return ()

    def measure(self, counted: DataFrame, keys: Sequence[str]) -> DataFrame | None:
        """``keys`` and ``value`` for models that need more than the class size."""
        return None

    def verdict(self, n: Column, value: Column | None) -> Column:
        return F.lit(True)

    def table_verdict(self, classes: Column, records: Column) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class KAnonymity(Model):
    k: int

    monotone = True

    def verdict(self, n, value):
        return n >= self.k


@dataclass(frozen=True)
class _Sensitive(Model):
    attribute: str

    @property
    def columns(self):
        return (self.attribute,)

    def pairs(self, counted: DataFrame, keys: Sequence[str]) -> DataFrame:
        return counted.groupBy(*keys, self.attribute).agg(F.sum("cnt").alias("_pc"))


@dataclass(frozen=True)
class DistinctLDiversity(_Sensitive):
    l: int

    monotone = True

    def measure(self, counted, keys):
        return self.pairs(counted, keys).groupBy(*keys).agg(F.count("*").alias("value"))

    def verdict(self, n, value):
        return value >= self.l


@dataclass(frozen=True)
class EntropyLDiversity(_Sensitive):
    l: float

    def measure(self, counted, keys):
        c = F.col("_pc").cast("double")
        total = F.sum(c)
        entropy = F.log(total) - F.sum(c * F.log(c)) / total
        return self.pairs(counted, keys).groupBy(*keys).agg(entropy.alias("value"))

    def verdict(self, n, value):
        return value >= F.lit(math.log(self.l) - EPS)


@dataclass(frozen=True)
class RecursiveCLDiversity(_Sensitive):
    c: float
    l: int

    def measure(self, counted, keys):
        w = Window.partitionBy(*keys).orderBy(F.col("_pc").desc(), F.col(self.attribute))
        sorted_counts = self.pairs(counted, keys).withColumn("_r", F.row_number().over(w))
        first = F.max(F.when(F.col("_r") == 1, F.col("_pc")))
        tail = F.coalesce(F.sum(F.when(F.col("_r") >= self.l, F.col("_pc"))), F.lit(0))
        # positive while c times the tail outweighs the commonest value
        return sorted_counts.groupBy(*keys).agg((F.lit(float(self.c)) * tail - first).alias("value"))

    def verdict(self, n, value):
        return value > EPS


@dataclass(frozen=True)
class OrderedTCloseness(_Sensitive):
    t: float

    def measure(self, counted, keys):
        """Mean gap between the cumulative shares of a class and of the table, over the values but the last.

        A class's share only changes at its own values. Between two of them the table's grows, so the gaps before it passes
        the class's share and those after sum up from prefix sums of the table's shares. Where the table passes in
        between, the place is looked up by range; no class is held as an array, none walks over values it lacks.
        """
        v = self.attribute
        total = materialize(counted.groupBy(v).agg(F.sum("cnt").alias("_q")), "values")
        facts = total.agg(F.count("*").alias("m"), F.sum("_q").alias("t")).first()
        m, rows = facts["m"], facts["t"] or 0
        parts = max(1, -(-m // ROWS_PER_TASK))
        at = dealt_by_range(total, [v], parts)
        at = running_total(at, [v], F.lit(1).cast("bigint"), "_i")
        at = running_total(at, [v], F.col("_q"), "_c")
        # _i: position from 1; _c: rows up to the value; _s: the sum of _c over the values up to it.
        table = materialize(running_total(at, [v], F.col("_c").cast("decimal(38,0)"), "_s").drop("_part"), "prefixes")
        pairs = null_safe(self.pairs(counted, keys), table, [v])
        inside = Window.partitionBy(*keys).orderBy("_i")
        whole = F.sum("_pc").over(Window.partitionBy(*keys))
        after = [F.lead(c).over(inside) for c in ("_i", "_q", "_c", "_s")]
        end = table.agg(F.max("_s").alias("s")).scalar()
        steps = pairs.select(
            *keys, "_i", "_c", (F.col("_s") - F.col("_c")).alias("_under"), F.row_number().over(inside).alias("_first"),
            (F.sum("_pc").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) * F.lit(float(rows)) / whole).alias("_x"),
            F.coalesce(after[0], F.lit(m + 1)).alias("_next"),  # the gap reaches up to the value before the next one
            F.coalesce(after[2] - after[1], F.lit(rows)).alias("_top"), F.coalesce(after[3] - after[2], end).alias("_upto"),
        )
        steps = steps.withColumn("_apart", (F.col("_c") < F.col("_x")) & (F.col("_top") >= F.col("_x")))
        kept = materialize(steps.withColumn("_id", F.monotonically_increasing_id()), "steps")
        asked = kept.where("_apart").select("_id", F.col("_x").alias("_key"))
        points = table.select(F.col("_c").cast("double").alias("_key"), "_i", "_s")
        met = last_below(points, asked, "_key", parts).select("_id", F.col("_point._i").alias("_at"), F.col("_point._s").alias("_sum"))
        # Up to _at the table's share is below the class's.
        flat = F.when(F.col("_c") >= F.col("_x"), F.col("_i") - 1).otherwise(F.col("_next") - 1)
        flat_sum = F.when(F.col("_c") >= F.col("_x"), F.col("_under")).otherwise(F.col("_upto"))
        found = kept.join(met, "_id", "left").withColumn("_at", F.coalesce("_at", flat)).withColumn("_sum", F.coalesce("_sum", flat_sum))
        below = F.col("_x") * (F.col("_at") - F.col("_i") + 1) - (F.col("_sum") - F.col("_under")).cast("double")
        above = (F.col("_upto") - F.col("_sum")).cast("double") - F.col("_x") * (F.col("_next") - 1 - F.col("_at"))
        start = F.when(F.col("_first") == 1, F.col("_under").cast("double")).otherwise(F.lit(0.0))
        distance = F.sum(below + above + start) / (float(rows or 1) * max(m - 1, 1))
        return found.groupBy(*keys).agg((distance if m > 1 else F.lit(0.0)).alias("value"))

    def verdict(self, n, value):
        return value <= F.lit(self.t + EPS)


@dataclass(frozen=True)
class HierarchicalTCloseness(_Sensitive):
    t: float
    hierarchy: Hierarchy

    def measure(self, counted, keys):
        """Earth mover's distance, level by level on a tree of the class's own values.

        A node is the path of labels above it. Only subtrees that hold rows of a class can have more mass than expected;
        all others lack exactly their expected mass, so at each inner node the mass moved is min(surplus,
        surplus - (p - q)) from the touched children alone. Each level is merged from the one below it, with its
        expected mass and the cost so far, so levels shrink and the rows are read once.
        """
        height = self.hierarchy.height
        table = self.hierarchy.materialize(counted, self.attribute)
        lookup = table.select(F.col("value").alias("_v"), F.col("levels").alias("_lv"))
        top = table.agg(F.max(F.col("levels")[height])).scalar()
        # A value that is not listed, such as NULL, is a leaf of its own right under the top.
        own = F.concat(F.lit("\0"), F.coalesce(F.col(self.attribute).cast("string"), F.lit("\0")))
        levels = F.coalesce(F.col("_lv"), F.concat(F.array_repeat(own, height), F.array(F.coalesce(top, F.lit("*")))))

        def placed(rows, count, name):
            path = rows.join(lookup, F.col(self.attribute).cast("string") == F.col("_v"), "left").withColumn("_path", levels)
            return path.groupBy(*[k for k in keys if k in rows.columns], "_path").agg(F.sum(count).alias(name))

        pairs = self.pairs(counted, keys)
        every = materialize(placed(counted.groupBy(self.attribute).agg(F.sum("cnt").alias("cnt")), "cnt", "_q"), "leaves")
        grand = every.agg(F.sum("_q").alias("g")).scalar()
        zero = F.lit(0.0)
        at = null_safe(placed(pairs, "_pc", "_p"), every, ["_path"])
        at = null_safe(at, pairs.groupBy(*keys).agg(F.sum("_pc").alias("_n")), keys).withColumn("_cost", zero)
        for h in range(1, height + 1):
            parent = F.slice("_path", 2, height - h + 1).alias("_path")
            surplus = F.sum(F.greatest(F.col("_p") / F.col("_n") - F.col("_q") / grand, zero))
            merged = at.groupBy(*keys, parent).agg(
                surplus.alias("_surplus"), F.sum("_p").alias("_p"), F.max("_n").alias("_n"), F.sum("_cost").alias("_cost"))
            every = every.groupBy(parent).agg(F.sum("_q").alias("_q"))
            lack = F.col("_surplus") - (F.col("_p") / F.col("_n") - F.col("_q") / grand)
            moved = F.least(F.col("_surplus"), F.greatest(lack, zero)) * F.lit(h / height)
            at = null_safe(merged, every, ["_path"]).withColumn("_cost", F.col("_cost") + moved).drop("_surplus")
        return at.groupBy(*keys).agg(F.sum("_cost").alias("value"))

    def verdict(self, n, value):
        return value <= F.lit(self.t + EPS)


@dataclass(frozen=True)
class DPresence(Model):
    """Share of the class inside the research subset, flagged by a boolean column."""

    low: float
    high: float
    subset: str = "in_subset"

    @property
    def columns(self):
        return (self.subset,)

    def measure(self, counted, keys):
        inside = F.sum(F.when(F.col(self.subset), F.col("cnt")).otherwise(0))
        return counted.groupBy(*keys).agg((inside / F.sum("cnt")).alias("value"))

    def verdict(self, n, value):
        return (value >= F.lit(self.low - EPS)) & (value <= F.lit(self.high + EPS))


@dataclass(frozen=True)
class KMap(Model):
    """Classes that hold rows of the subset must have ``k`` rows in the population."""

    k: int
    subset: str = "in_subset"

    @property
    def columns(self):
        return (self.subset,)

    def measure(self, counted, keys):
        inside = F.sum(F.when(F.col(self.subset), F.col("cnt")).otherwise(0))
        return counted.groupBy(*keys).agg(inside.alias("value"))

    def verdict(self, n, value):
        return (value == 0) | (n >= self.k)


@dataclass(frozen=True)
class Inclusion(Model):
    """Only restricts the evaluation to classes with rows of the subset."""

    subset: str = "in_subset"

    @property
    def columns(self):
        return (self.subset,)

    def measure(self, counted, keys):
        inside = F.sum(F.when(F.col(self.subset), F.col("cnt")).otherwise(0))
        return counted.groupBy(*keys).agg(inside.alias("value"))

    def verdict(self, n, value):
        return value > 0


def poisson_below(k: int, rate: float) -> float:
    """P(X < k) for a Poisson variable."""
    return sum(math.exp(-rate + i * math.log(rate) - math.lgamma(i + 1)) for i in range(k)) if rate > 0 else 1.0


def smallest_sample_class(k: int, significance: float, fraction: float) -> int:
    """Least class size whose estimated population class is below ``k`` seldom enough."""
    n = 1
    while poisson_below(k, n / fraction) > significance:
        n += 1
    return n


@dataclass(frozen=True)
class KMapEstimated(Model):
    """k-map with the population class size estimated from the sampling fraction."""

    k: int
    significance: float
    fraction: float

    def verdict(self, n, value):
        return n >= smallest_sample_class(self.k, self.significance, self.fraction)


@dataclass(frozen=True)
class AverageReidentificationRisk(Model):
    risk: float

    def table_verdict(self, classes, records):
        return (records == 0) | (classes / records <= F.lit(self.risk + EPS))


@dataclass(frozen=True)
class Profitability(Model):
    """Cost-benefit models.

    A record of a class of size n is attacked if gain/n exceeds the cost. Without
    attacks allowed, attacked records must go; otherwise those the publisher would
    lose on. With a ``subset``, n counts the population the subset was drawn from.
    """

    costs: tuple[tuple[str, float], ...]
    no_attack: bool = False
    subset: str | None = None

    @property
    def columns(self):
        return (self.subset,) if self.subset else ()

    def attacked(self, n: Column) -> Column:
        c = dict(self.costs)
        return F.lit(c["adversary_gain"]) / n > F.lit(c["adversary_cost"])

    def measure(self, counted, keys):
        if not self.subset:
            return counted.groupBy(*keys).agg(F.max("info_loss").alias("value")) if "info_loss" in counted.columns else None
        inside = F.sum(F.when(F.col(self.subset), F.col("cnt")).otherwise(0))
        loss = F.max("info_loss") if "info_loss" in counted.columns else F.lit(0.0)
        return counted.groupBy(*keys).agg(F.when(inside > 0, loss).otherwise(F.lit(None)).alias("value"))

    def verdict(self, n, value):
        if self.no_attack:
            return ~self.attacked(n)
        c = dict(self.costs)
        info = value if value is not None else F.lit(0.0)
        earned = F.lit(c["publisher_benefit"]) * (F.lit(1.0) - F.coalesce(info, F.lit(0.0)))
        return F.when(self.attacked(n), earned - F.lit(c["publisher_loss"]) / n).otherwise(earned) > 0


def class_verdicts(counted: DataFrame, keys: Sequence[str], models: Sequence[Model], extra: Sequence[Column] = ()) -> DataFrame:
    """Classes with size ``n``, one ``value_i`` per measuring model and ``ok``."""
    classes = counted.groupBy(*keys).agg(F.sum("cnt").alias("n"), *extra)
    ok = F.lit(True)
    for i, model in enumerate(models):
        measured = model.measure(counted, keys)
        value = None
        if measured is not None:
            classes = null_safe(classes, measured.withColumnRenamed("value", f"value_{i}"), keys)
            value = F.col(f"value_{i}")
        ok = ok & model.verdict(F.col("n"), value)
    return classes.withColumn("ok", F.coalesce(ok, F.lit(False)))


def table_predicate(models: Sequence[Model], classes: Column, records: Column) -> Column:
    held = F.lit(True)
    for model in models:
        held = held & model.table_verdict(classes, records)
    return held


def check(df: DataFrame, keys: Sequence[str], models: Sequence[Model]) -> DataFrame:
    """Judge every equivalence class of a table."""
    columns = sorted({c for m in models for c in m.columns})
    keep = [c for c in ("info_loss",) if c in df.columns]
    counted = df.groupBy(*keys, *columns, *keep).agg(F.count("*").alias("cnt"))
    if len(columns) > 1:
        counted = materialize(counted, "counted")  # read by every measure, the rows once
    return class_verdicts(counted, keys, models)
