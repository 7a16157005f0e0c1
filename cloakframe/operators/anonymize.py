"""Producing a published table: search, generalize, suppress, recode, aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.definition import STAR, Definition
from cloakframe.operators import lattice as L
from cloakframe.operators.hierarchies import generalize
from cloakframe.operators.privacy import Model, check
from cloakframe.operators.ranking import dealt_by_range, null_safe
from cloakframe.session import materialize


def suppress(df: DataFrame, qid: Sequence[str], models: Sequence[Model], flag: str | None = None) -> DataFrame:
    """``*`` in all quasi-identifiers of classes that violate a model."""
    verdicts = check(df, qid, models).select(*qid, "ok")
    joined = null_safe(df, verdicts, qid, "left")
    bad = ~F.col("ok")
    out = joined.select(
        *[F.when(bad, F.lit(STAR)).otherwise(F.col(c)).alias(c) if c in qid else F.col(c) for c in df.columns],
        *([bad.alias(flag)] if flag else []),
    )
    return out


def publish(df: DataFrame, definition: Definition, node: dict[str, int], models: Sequence[Model], flag: str | None = None) -> DataFrame:
    """Generalize to a node and suppress what still violates the models."""
    return suppress(generalize(df, definition, node), definition.qid, models, flag)


def anonymize(
    df: DataFrame,
    definition: Definition,
    models: Sequence[Model],
    quality: L.Quality = L.Quality(),
    suppression: float = 0.0,
    low: dict[str, int] | None = None,
    high: dict[str, int] | None = None,
) -> tuple[DataFrame, dict[str, int] | None]:
    """Best node and the table published at it; everything ``*`` if none is valid."""
    best = L.search(df, definition, models, quality, suppression, low, high)
    if best is None:
        return df.withColumns({q: F.lit(STAR) for q in definition.qid}), None
    node = L.node_levels(definition, best["node"])
    return publish(df, definition, node, models), node


def run_stats(published: DataFrame, definition: Definition, node: dict[str, int], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """One line per run, in the layout of the statistics files; with a ``weight`` a line stands for that many rows."""
    from cloakframe.operators.classes import class_summary

    s = class_summary(published, definition.qid, by, weight)
    return s.select(
        *by,
        F.array(*[F.lit(node[q]) for q in definition.qid]).alias("node"),
        F.array(*[F.lit(q) for q in definition.qid]).alias("QID"),
        F.col("suppressed").alias("suppressed in sample"),
        F.col("sample_size").alias("sample size"),
        F.col("input_size").alias("input size"),
        F.col("classes").alias("equivalence classes"),
        F.col("avg_size").alias("average EQ size"),
    )


# --------------------------------------------------------- grids over folds and k


def train_counts(counts: DataFrame, keys: Sequence[str], folds: int, fold: str = "fold", carry: Sequence[str] = ()) -> DataFrame:
    """Counts per training set: all rows less those of the fold held out.

    ``counts``: keys, fold, ``cnt``. Neither rows nor raw tuples are copied once per
    training set, only the merged counts. ``carry`` are figures equal within a key.
    """
    own = [F.sum(F.when(F.col(fold) == i, F.col("cnt")).otherwise(0)).alias(f"_{i}") for i in range(folds)]
    merged = counts.groupBy(*keys).agg(F.sum("cnt").alias("_t"), *own, *[F.max(c).alias(c) for c in carry])
    sets = F.array(*[F.struct(F.lit(i).alias("f"), (F.col("_t") - F.col(f"_{i}")).alias("c")) for i in range(folds)])
    spread = merged.withColumn("_s", F.explode(sets))
    return spread.select(*keys, F.col("_s.f").alias(fold), F.col("_s.c").alias("cnt"), *carry).filter("cnt > 0")


def grid_search(
    df: DataFrame,
    definition: Definition,
    folds: int,
    ks: Sequence[int],
    ls: Sequence[float] | None = None,
    sensitive: str | None = None,
    fold: str = "fold",
    gs: float = 0.5,
    chosen: Sequence[tuple[int, ...]] | None = None,
) -> DataFrame:
    """Best node of every (training fold, k[, l]) in one plan, suppression unlimited.

    k-anonymity and entropy-l-diversity only compare two numbers per class (its size
    and its entropy), so the classes of all folds and nodes are built once and each
    parameter pair is a filter on them.
    """
    chosen = L.nodes(definition) if chosen is None else list(chosen)
    extra = [sensitive] if sensitive else []
    prepared = L.prepare(df, definition, [*extra, fold])
    classes_of = ["node", *[f"g_{q}" for q in definition.qid]]
    wide = L.expanded(prepared, definition, chosen, [fold, *extra])
    train = train_counts(wide, [*classes_of, *extra], folds, fold, ["cell_loss"])
    keys = [fold, *classes_of]
    if sensitive:
        c = F.col("cnt").cast("double")
        classes = train.groupBy(*keys).agg(
            F.sum("cnt").alias("n"), F.max("cell_loss").alias("cell_loss"),
            (F.log(F.sum(c)) - F.sum(c * F.log(c)) / F.sum(c)).alias("entropy"),
        )
        params = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(l)).alias("l")) for k in ks for l in ls])
        ok = (F.col("n") >= F.col("p.k")) & (F.col("entropy") >= F.log(F.col("p.l")) - 1e-9)
        names = ["k", "l"]
    else:
        classes = train.withColumnRenamed("cnt", "n")
        params = F.array(*[F.struct(F.lit(k).alias("k")) for k in ks])
        ok, names = F.col("n") >= F.col("p.k"), ["k"]
    g, s = min(1.0, 2 * (1 - gs)), min(1.0, 2 * gs)
    scored = (
        classes.withColumn("p", F.explode(params))
        .withColumn("ok", ok)
        .groupBy(fold, *[F.col(f"p.{x}").alias(x) for x in names], "node")
        .agg(
            F.sum("n").alias("input_size"),
            F.coalesce(F.sum(F.when(~F.col("ok"), F.col("n"))), F.lit(0)).alias("suppressed"),
            F.count(F.when(F.col("ok"), 1)).alias("classes"),
            (F.sum(F.col("n") * F.when(F.col("ok"), g * F.col("cell_loss")).otherwise(F.lit(s))) / F.sum("n")).alias("loss"),
        )
        .withColumn("level", F.aggregate(F.split("node", ","), F.lit(0), lambda a, x: a + x.cast("int")))
    )
    order = F.struct(F.round("loss", 9), "level", "node")
    best = scored.groupBy(fold, *names).agg(
        F.min_by(F.struct("node", "input_size", "suppressed", "classes", "loss"), order).alias("b"))
    return best.select(
        fold, *names, "b.*",
        (F.col("b.input_size") - F.col("b.suppressed")).alias("sample_size"),
        F.try_divide(F.col("b.input_size") - F.col("b.suppressed"), F.col("b.classes")).alias("avg_size"),
    )


def train_rows(df: DataFrame, folds: int, fold: str = "fold") -> DataFrame:
    """Every row once per training set it belongs to; ``fold`` names the set."""
    every = F.array(*[F.lit(i) for i in range(folds)])
    return df.withColumn(fold, F.explode(F.filter(every, lambda i: i != F.col(fold))))


def publish_grid(df: DataFrame, qid: Sequence[str], ks: Sequence[int], cells: Sequence[str]) -> DataFrame:
    """k-anonymous versions of generalized rows for all k at once, ``*`` where too rare.

    Adds ``k``. Class sizes are counted once for all k.
    """
    from cloakframe.operators.classes import with_class_size

    sized = with_class_size(df, [*cells, *qid], "_n").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return sized.withColumns({q: F.when(F.col("_n") < F.col("k"), F.lit(STAR)).otherwise(F.col(q)) for q in qid}).drop("_n")


def publish_counts(counts: DataFrame, qid: Sequence[str], ks: Sequence[int], cells: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """``publish_grid`` of merged rows ``(cells, qid, carry, cnt)``, for figures that need class counts only."""
    from cloakframe.operators.classes import class_sizes

    keys = [*cells, *qid]
    if carry:
        sized = null_safe(counts, class_sizes(counts, keys, "_n", "cnt"), keys)
    else:
        sized = class_sizes(counts, keys, "cnt", "cnt").withColumn("_n", F.col("cnt"))
    sized = sized.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    starred = sized.withColumns({q: F.when(F.col("_n") < F.col("k"), F.lit(STAR)).otherwise(F.col(q)) for q in qid})
    return class_sizes(starred, [*cells, "k", *qid, *carry], "cnt", "cnt")


# ------------------------------------------------------------------ local recoding


def local_recoding(
    df: DataFrame,
    definition: Definition,
    models: Sequence[Model],
    min_share: float,
    quality: L.Quality = L.Quality(gs=0.0),
) -> DataFrame:
    """Anonymize again and again what the last round had to suppress.

    Each round must generalize ``min_share`` of all rows, so there are 1 / ``min_share``
    rounds at most; the loop ends when none can or nothing is left. Adds ``round`` (0 for rows suppressed in the end). Rounds are
    written to the shared folder, so a lost executor costs one round, not all.
    """
    total = df.count()
    rest, done = df, None
    step = max(1.0, min_share * total)
    left, number = total, 0
    while left >= step:
        number += 1
        limit = max(0.0, 1.0 - step / left)
        chosen = L.scores(rest, definition, models, quality, limit)
        best = L.optimum(chosen).first()
        if best is None:
            break
        node = L.node_levels(definition, best["node"])
        lifted = rest.withColumns({f"_raw_{q}": F.col(q) for q in definition.qid})
        judged = materialize(publish(lifted, definition, node, models, "_bad"), "recode")
        raws = [f"_raw_{q}" for q in definition.qid]
        good = judged.filter("not _bad").drop("_bad", *raws).withColumn("round", F.lit(number))
        done = good if done is None else done.unionByName(good)
        back = {q: F.col(f"_raw_{q}") for q in definition.qid}
        rest = judged.filter("_bad").withColumns(back).drop("_bad", *raws)
        left = best["suppressed"]
        if left == 0:
            return done
    stars = rest.withColumns({q: F.lit(STAR) for q in definition.qid}).withColumn("round", F.lit(0))
    return stars if done is None else done.unionByName(stars)


# ---------------------------------------------------------------- greedy searches


def greedy(
    df: DataFrame,
    definition: Definition,
    models: Sequence[Model],
    quality: L.Quality = L.Quality(),
    suppression: float = 0.0,
    steps: int | None = None,
    top_down: bool = False,
) -> DataFrame:
    """Best-first walk through a lattice too large to list.

    A walk has as many rounds as the heights add up to, or ``steps`` if that is given. If it is cut
    before it meets a valid node, the top node stands in; no row means that this is not valid either.

    Each round scores the neighbours of the current node in one job. Bottom-up climbs
    until a valid node is met and no neighbour improves it; top-down descends while a
    valid neighbour loses less. The best valid node met is returned.
    """
    prepared = L.prepare(df, definition, L.search_columns(definition, models, quality), quality.kind == "entropy")
    heights = definition.heights
    at = heights if top_down else tuple(0 for _ in heights)
    seen: dict[tuple[int, ...], dict] = {}

    def judge(candidates):
        new = [n for n in candidates if n not in seen]
        if new:
            for row in L.scores(df, definition, models, quality, suppression, new, prepared).collect():
                seen[tuple(int(x) for x in row["node"].split(","))] = row.asDict()
        return [(seen[n], n) for n in candidates]

    rank = lambda pair: (round(pair[0]["loss"], 9), pair[0]["level"], pair[0]["node"])
    judge([at])
    for _ in range(sum(heights) if steps is None else steps):
        delta = -1 if top_down else 1
        moves = [at[:i] + (at[i] + delta,) + at[i + 1:] for i in range(len(at))]
        moves = [m for m in moves if all(0 <= x <= h for x, h in zip(m, heights))]
        judged = judge(moves)
        if top_down:
            judged = [p for p in judged if p[0]["valid"]]
        if not judged:
            break
        best = min(judged, key=rank)
        if seen[at]["valid"] and not rank(best) < rank((seen[at], at)):
            break
        at = best[1]
    if not any(row["valid"] for row in seen.values()):
        judge([tuple(heights)])
    valid = [row for row in seen.values() if row["valid"]]
    best = min(valid, key=lambda r: (round(r["loss"], 9), r["level"], r["node"]), default=None)
    rows = [tuple(best[c] for c in ("node", "level", "rows", "suppressed", "classes", "loss"))] if best else []
    return df.sparkSession.createDataFrame(
        rows, "node string, level int, rows bigint, suppressed bigint, classes bigint, loss double")


# --------------------------------------------------------------- microaggregation


def group_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group; NULLs do not count."""
    return group_quantiles(df, keys, value, [0.5]).select(*keys, F.col("value").alias(name))


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], weight: str | None = None) -> DataFrame:
    """Exact interpolated quantiles per group as ``(keys, prob, value)``; with a ``weight`` a line stands for that many rows.

    Equal values are merged before the shuffle and dealt into ranges of group and value, so that a group of any size is
    spread over tasks. A value's last rank is the count up to it in its range and that of the group's earlier ranges; the
    values that hold the wanted ranks are then picked by a partial aggregate. No sketch, and no switch by size.
    """
    size = F.sum(weight) if weight else F.count("*")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(size.alias("_c"))
    dealt = dealt_by_range(counts, [*keys, "_v"])
    parts = dealt.groupBy(*keys, "_part").agg(F.sum("_c").alias("_held"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *keys, "_part", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_held").over(Window.partitionBy(*keys)).alias("_n"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = null_safe(dealt.withColumn("_upto", F.sum("_c").over(inside)), offsets, [*keys, "_part"]).withColumn(
        "_upto", F.col("_upto") + F.col("_before"))
    picked = []
    for p in probs:
        rank = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = (F.min(F.when(F.col("_upto") >= end(rank) + 1, F.col("_v"))) for end in (F.floor, F.ceil))
        picked.append(F.struct(F.lit(float(p)).alias("prob"), (low + (high - low) * F.max(rank - F.floor(rank))).alias("value")))
    return placed.groupBy(*keys).agg(F.array(*picked).alias("_p")).select(*keys, F.inline("_p"))


def group_mode(df: DataFrame, keys: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """Commonest value per group, the least one among equals."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_c"), F.col(value))).alias(name))


def microaggregate(df: DataFrame, qid: Sequence[str], column: str, how: str, name: str | None = None) -> DataFrame:
    """Replace a number by an aggregate over its class; NULLs do not count.

    ``how``: ``mean``, ``geomean``, ``mode`` or ``median``. The aggregates are computed
    per class with partial sums and joined back, never by a window over the rows.
    """
    c = F.col(column)
    if how == "mean":
        agg = df.groupBy(*qid).agg(F.avg(c).alias("_m"))
    elif how == "geomean":
        agg = df.groupBy(*qid).agg(F.exp(F.avg(F.log(c))).alias("_m"))
    elif how == "mode":
        agg = group_mode(df, qid, column, "_m")
    elif how == "median":
        agg = group_median(df, qid, column, "_m")
    else:
        raise ValueError(f"unknown aggregate {how}")
    return null_safe(df, agg, qid, "left").withColumn(name or column, F.col("_m")).drop("_m")
