"""Exact ranks and order statistics inside groups that may be very large.

A window over a group runs in one task. The functions here split every group that
is larger than one task should sort into ranges of the (uniform) order hash, rank
inside the ranges and add the count of the lower ranges, so the result is the exact
``row_number`` while no task sees more than about ``ROWS_PER_TASK`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.functions.hashing import uniform
from cloakframe.session import materialize

ROWS_PER_TASK = 2_000_000
_ALL = "_all"


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; keys appear once.

    Keys that cannot be NULL on one side are compared plainly.
    """
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = None
    for k in keys:
        a, b = F.col(k), F.col(f"_r_{k}")
        term = a.eqNullSafe(b) if left.schema[k].nullable and right.schema[k].nullable else a == b
        condition = term if condition is None else condition & term
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how == "full":
        merged = [F.coalesce(F.col(k), F.col(f"_r_{k}")).alias(k) for k in keys]
        return joined.select(
            *merged,
            *[c for c in left.columns if c not in keys],
            *[c for c in right.columns if c not in keys],
        )
    return joined.drop(*[f"_r_{k}" for k in keys])


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    hash_col: Column,
    rank: str = "rank",
    size: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """``row_number() over (partition by keys order by hash, order)``, skew-safe.

    The size of the largest group is read first: from ``sizes`` (keys, ``_n``) if the
    caller has counted already, else in one pass over the key columns. While it fits
    a task the plain window is the cheapest plan.
    """
    df = df.withColumn("_h", hash_col)
    keys = list(keys)
    if not keys:
        df, keys = df.withColumn(_ALL, F.lit(0)), [_ALL]
    if sizes is None:
        sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    largest, total = sizes.agg(F.max("_n"), F.sum("_n")).first()
    if (largest or 0) <= rows_per_task:
        w = Window.partitionBy(*keys)
        out = df.withColumn(rank, F.row_number().over(w.orderBy("_h", *order)).cast("bigint"))
        if size:
            out = out.withColumn(size, F.count("*").over(w))
        return out.drop("_h", _ALL)

    parts = F.ceil(F.col("_n") / F.lit(rows_per_task))
    sized = df.withColumn("_n", sizes.select("_n").scalar()) if keys == [_ALL] else null_safe(df, sizes, keys)
    sized = sized.withColumn(
        "_part", F.floor(uniform(F.col("_h")) * parts).cast("bigint")
    )
    # Only groups of several parts have offsets: at most 2N / rows_per_task rows.
    offsets = (
        sized.filter(F.col("_n") > rows_per_task)
        .groupBy(*keys, "_part")
        .agg(F.count("*").alias("_c"))
        .withColumn(
            "_before",
            F.sum("_c").over(
                Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .drop("_c")
    )
    inside = Window.partitionBy(*keys, "_part").orderBy("_h", *order)
    # As many tasks as there are ranges, or adaptive execution would merge them by their packed size.
    dealt = sized.repartition(-(-total // rows_per_task), *keys, "_part")
    out = null_safe(
        dealt.withColumn("_rn", F.row_number().over(inside).cast("bigint")), offsets, [*keys, "_part"], "left"
    ).withColumn(rank, F.col("_rn") + F.coalesce("_before", F.lit(0)))
    if size:
        out = out.withColumn(size, F.col("_n"))
    return out.drop("_h", "_n", "_part", "_rn", "_before", _ALL)


def dealt_by_range(values: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``values``, written in ranges of ``order`` with the number ``_part`` of each; Spark samples the bounds.

    Without ``parts`` there are as many as shuffles have, less those that adaptive execution merges.
    """
    dealt = values.repartitionByRange(parts, *order) if parts else values.repartitionByRange(*order)
    return materialize(dealt.withColumn("_part", F.spark_partition_id()), "ranges")


def running_total(dealt: DataFrame, order: Sequence[str], column: Column, name: str) -> DataFrame:
    """``dealt`` with the sum of ``column`` over all rows up to each one, in the order they were dealt in.

    A range is summed up in its task, and what earlier ranges hold is added: one line for each range meets the others.
    """
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_part").agg(F.sum(column).alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    return dealt.withColumn("_sum", F.sum(column).over(inside)).join(before, "_part").withColumn(
        name, F.col("_sum") + F.col("_before")).drop("_sum", "_before")


def ordered_positions(values: DataFrame, order: Sequence[str], rank: str = "_rank", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Global position of distinct values in their own order, from 1: the place in a range plus the ranges before it."""
    values = materialize(values, "values")
    dealt = dealt_by_range(values, order, max(1, -(-values.count() // rows_per_task)))
    return running_total(dealt, order, F.lit(1).cast("bigint"), rank).drop("_part")


def last_below(points: DataFrame, queries: DataFrame, key: str, parts: int) -> DataFrame:
    """``queries`` with ``_point``, the row of ``points`` with the largest ``key`` below theirs (NULL if there is none).

    Both are dealt by ranges of ``key`` together; what a range needs of earlier ones is their last point.
    """
    held = F.struct(*points.columns)
    empty = F.lit(None).cast(points.select(held.alias("p")).schema["p"].dataType)
    asked = F.struct(*queries.columns)
    none = F.lit(None).cast(queries.select(asked.alias("q")).schema["q"].dataType)
    both = points.select(key, F.lit(1).alias("_kind"), held.alias("_own"), none.alias("_asked")).unionByName(
        queries.select(key, F.lit(0).alias("_kind"), empty.alias("_own"), asked.alias("_asked")))
    dealt = dealt_by_range(both, [key], parts)
    inside = Window.partitionBy("_part").orderBy(key, "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.groupBy("_part").agg(F.max_by("_own", F.when(F.col("_kind") == 1, F.col(key))).alias("_end"))
    carried = ends.select("_part", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    found = dealt.withColumn("_last", F.last("_own", ignorenulls=True).over(inside)).where("_kind = 0").join(carried, "_part")
    return found.select("_asked.*", F.coalesce("_last", "_carried").alias("_point"))


def content_hash(df: DataFrame) -> Column:
    """Hex digest of whole rows, equal for equal rows; maps are compared by their JSON."""
    cells = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), *cells)), 16, "0") for k in (0, 1)])


def _narrowed(lines: DataFrame, keys: Sequence[str], level: str) -> DataFrame:
    """The value of ``level`` in which the ``_need``-th row of each ``(keys, slot)`` lies, with the need inside it.

    ``lines``: keys, slot, ``_need``, ``level`` and the number of rows ``_c`` behind a line.
    """
    merged = lines.groupBy(*keys, "slot", level).agg(F.sum("_c").alias("_c"), F.first("_need").alias("_need"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "slot").orderBy(level).rowsBetween(Window.unboundedPreceding, 0))
    placed = merged.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_c"))
    found = placed.filter((F.col("_before") < F.col("_need")) & (F.col("_need") <= F.col("_upto")))
    return found.select(*keys, "slot", level, (F.col("_need") - F.col("_before")).alias("_need"), F.col("_c").alias("same"))


def hash_cuts(df: DataFrame, keys: Sequence[str], quotas: DataFrame, hash_col: Column) -> tuple[DataFrame, Column]:
    """Where the ``quota``-th row of every group stands, without sorting the groups, and the place of a row.

    ``quotas`` holds ``keys``, ``slot`` and ``quota``. A histogram of 16-bit hash prefixes finds the prefix in which the
    wanted rank falls; of the rows behind it (1/65536 of the group) those of equal hash are merged to find the hash.
    Only where ids repeat at a cut, one more reading orders their rows by content, again prefix first. The first result,
    written once, is ``keys, slot, _at`` (a place), and of the ``same`` rows of that place ``take`` belong to the quota.
    """
    keys = list(keys)
    source = df.select(*keys, hash_col.alias("_h")).withColumn("_bucket", F.substring("_h", 1, 4))
    histogram = source.groupBy(*keys, "_bucket").agg(F.count("*").alias("_c"))
    if keys:
        lines = null_safe(histogram, quotas.select(*keys, "slot", F.col("quota").alias("_need")), keys)
    else:  # a handful of ranks of the whole table: no join
        few = quotas.agg(F.collect_list(F.struct("slot", F.col("quota").alias("_need"))).alias("q")).scalar()
        lines = histogram.withColumn("_q", few).withColumn("_q", F.explode("_q")).select("*", "_q.slot", "_q._need")
    edge = _narrowed(lines, keys, "_bucket").drop("same")
    inside = null_safe(source, edge, [*keys, "_bucket"])
    inside = inside.groupBy(*keys, "slot", "_h").agg(F.count("*").alias("_c"), F.first("_need").alias("_need"))
    names = [*keys, "slot", F.col("_need").alias("take"), "same"]
    cuts = materialize(_narrowed(inside, keys, "_h").select(*names, F.col("_h").alias("_at")), "cuts")
    if cuts.filter("take < same").isEmpty():
        return cuts, hash_col

    content = content_hash(df)
    source = df.select(*keys, hash_col.alias("_h"), content.alias("_content"))
    edge = cuts.select(*keys, "slot", F.col("_at").alias("_h"), F.col("take").alias("_need"))
    inside = null_safe(source, edge, [*keys, "_h"])
    inside = inside.groupBy(*keys, "slot", "_h", "_content").agg(F.count("*").alias("_c"), F.first("_need").alias("_need"))
    inside = materialize(inside.withColumn("_prefix", F.substring("_content", 1, 4)), "repeated")
    prefix = _narrowed(inside, keys, "_prefix").drop("same")
    inside = null_safe(inside.drop("_need"), prefix, [*keys, "slot", "_prefix"])
    found = _narrowed(inside, keys, "_content")
    found = null_safe(found, edge.select(*keys, "slot", "_h"), [*keys, "slot"])
    return materialize(found.select(*names, F.concat("_h", "_content").alias("_at")), "cuts"), F.concat(hash_col, content)


def _equal_rows(df: DataFrame, keys: Sequence[str], cuts: DataFrame, place: Column) -> DataFrame:
    """Rows of the places whose equal rows a cut parts, with their place ``_at`` and numbered by ``_rn`` from 1.

    They are alike, so they are counted and written out again, a million at a time: no task holds them all.
    """
    chunk = 1_000_000
    parted = cuts.filter("take < same").select(*keys, "_at").distinct()
    rows = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    at = null_safe(df.select(*keys, rows.alias("_row"), place.alias("_at")), parted, [*keys, "_at"])
    counted = at.groupBy(*keys, "_at").agg(F.first("_row").alias("_row"), F.count("*").alias("_c"))
    chunks = counted.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_c") - 1) / chunk)))).repartition("_at", "_k")
    base = F.col("_k") * chunk
    return chunks.withColumn("_rn", F.explode(F.sequence(base + 1, F.least(base + chunk, F.col("_c"))))).select("_row.*", "_at", "_rn")


def first_of_each(df: DataFrame, keys: Sequence[str], quotas: DataFrame, hash_col: Column) -> DataFrame:
    """Keep the first ``quota`` rows of every group in hash order, exactly so many also where ids repeat.

    For few, possibly huge groups: rows are only filtered against the cut of their
    group, never shuffled for ranking.
    """
    keys = list(keys)
    cuts, place = hash_cuts(df, keys, quotas.withColumn("slot", F.lit(0)), hash_col)
    limits = cuts.select(*keys, "_at", (F.col("take") == F.col("same")).alias("_whole"))
    placed = df.withColumn("_place", place)
    if keys:
        marked = null_safe(placed, limits, keys)
    else:
        limit = limits.agg(F.max(F.struct("_at", "_whole")).alias("c")).scalar()
        marked = placed.withColumns({"_at": limit["_at"], "_whole": limit["_whole"]})
    kept = marked.filter((F.col("_place") < F.col("_at")) | ((F.col("_place") == F.col("_at")) & F.col("_whole"))).select(*df.columns)
    if limits.filter("NOT _whole").isEmpty():
        return kept
    equal = null_safe(_equal_rows(df, keys, cuts, place), cuts.select(*keys, "_at", "take"), [*keys, "_at"])
    return kept.unionByName(equal.filter("_rn <= take").select(*df.columns))


def with_cut_position(df: DataFrame, name: str, quotas: DataFrame, hash_col: Column) -> DataFrame:
    """Adds how many of the wanted ranks lie before a row; a map-side comparison."""
    cuts, place = hash_cuts(df, [], quotas, hash_col)
    array = cuts.agg(F.sort_array(F.collect_list(F.struct("_at", "take"))).alias("cuts")).scalar()

    def counted(rows: DataFrame, number: Column) -> DataFrame:
        passed = lambda c: (c["_at"] < F.col("_at")) | ((c["_at"] == F.col("_at")) & (c["take"] < number))
        return rows.withColumn("_cuts", array).withColumn(name, F.size(F.filter("_cuts", passed))).select(*df.columns, name)

    placed = df.withColumn("_at", place)
    parted = cuts.filter("take < same")
    if parted.isEmpty():
        return counted(placed, F.lit(0))
    split = parted.agg(F.collect_set("_at").alias("c")).scalar()
    rest = placed.withColumn("_split", split).filter(~F.array_contains("_split", F.col("_at")))
    return counted(rest, F.lit(0)).unionByName(counted(_equal_rows(df, [], cuts, place), F.col("_rn")))
