"""The lattice of generalization nodes, scored on the table of distinct tuples."""

from __future__ import annotations

import functools
import heapq
import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from cloakframe.definition import Definition
from cloakframe.operators.privacy import Model, class_verdicts, table_predicate
from cloakframe.operators.ranking import null_safe
from cloakframe.session import materialize

MAX_NODES_PER_JOB = 4096
MAX_VARYING = 6  # beyond, nodes share little and fewer of them are expanded together
NODES_TOGETHER = 16


def node_name(levels: Sequence[int]) -> str:
    return ",".join(str(x) for x in levels)


def nodes(definition: Definition, low: dict[str, int] | None = None, high: dict[str, int] | None = None) -> list[tuple[int, ...]]:
    """All nodes between two bounds; equal bounds pin an attribute to one level."""
    spans = [
        range((low or {}).get(q, 0), (high or {}).get(q, h) + 1) for q, h in zip(definition.qid, definition.heights)
    ]
    return sorted(itertools.product(*spans))


def nodes_table(df: DataFrame, definition: Definition, chosen: Sequence[tuple[int, ...]]) -> DataFrame:
    rows = [(node_name(n), *n, sum(n)) for n in chosen]
    fields = "node string, " + ", ".join(f"`l_{q}` int" for q in definition.qid) + ", level int"
    return df.sparkSession.createDataFrame(rows, fields)


def base_table(df: DataFrame, definition: Definition, extra: Sequence[str] = ()) -> DataFrame:
    """Distinct raw tuples with their count ``cnt``, written to the shared folder.

    The only pass over the rows. Its size is bounded by the product of the attribute
    domains, and everything the search does afterwards reads it instead of the rows.
    """
    return materialize(df.groupBy(*definition.qid, *extra).agg(F.count("*").alias("cnt")), "tuples")


def level_tables(base: DataFrame, definition: Definition, bits: bool = False) -> DataFrame:
    """``(attribute, raw, level, label, leaves, domain)`` for all values in use.

    ``leaves`` counts the listed values under a label, ``domain`` all listed values.
    Values an explicit hierarchy does not list have no label and lose everything.
    With ``bits`` also the bits lost per value, and the most it can lose.
    """
    used, listed = [], []
    for q in definition.qid:
        h = definition.hierarchy(q)
        name = lambda d: d.select(F.lit(q).alias("attribute"), "value", "levels")
        table = h.materialize(base, q)
        listed.append(name(table))
        if h.table is not None:
            values = base.select(F.col(q).cast("string").alias("value")).distinct()
            none = F.array_repeat(F.lit(None).cast("string"), h.height + 1)
            table = null_safe(values, table, ["value"], "left").withColumn("levels", F.coalesce("levels", none))
        used.append(name(table))
    listed, used = (functools.reduce(DataFrame.unionByName, x) for x in (listed, used))
    leaves = (
        listed.select("attribute", F.posexplode("levels").alias("level", "label"))
        .groupBy("attribute", "level", "label").agg(F.count("*").alias("leaves"))
    )
    domains = listed.groupBy("attribute").agg(F.count("*").alias("domain"))
    long = used.select("attribute", F.col("value").alias("raw"), F.posexplode("levels").alias("level", "label"))
    long = null_safe(null_safe(long, leaves, ["attribute", "level", "label"], "left"), domains, ["attribute"])
    long = long.withColumn("leaves", F.coalesce("leaves", "domain"))
    for q in definition.qid:
        stated = definition.hierarchy(q).leaves
        if stated:
            mine, sizes = F.col("attribute") == q, F.array(*[F.lit(x) for x in stated])
            long = long.withColumn("leaves", F.when(mine, sizes[F.col("level")]).otherwise(F.col("leaves")))
            long = long.withColumn("domain", F.when(mine, F.lit(stated[-1])).otherwise(F.col("domain")))
    if not bits:
        return long
    counts = functools.reduce(DataFrame.unionByName, [
        base.groupBy(F.col(q).cast("string").alias("raw")).agg(F.sum("cnt").alias("_f")).select(F.lit(q).alias("attribute"), "*")
        for q in definition.qid
    ])
    known = null_safe(long, counts, ["attribute", "raw"])
    labels = known.groupBy("attribute", "level", "label").agg(F.sum("_f").alias("_g"))
    total = base.agg(F.sum("cnt").alias("t")).scalar()
    return null_safe(known, labels, ["attribute", "level", "label"]).select(
        *long.columns, (-F.log2(F.col("_f") / F.col("_g"))).alias("bits"), (-F.log2(F.col("_f") / total)).alias("most"))


@dataclass(frozen=True)
class Quality:
    """How a node is scored; lower is better.

    ``kind``: ``loss``, ``height``, ``entropy``, ``classification`` or ``payout``.
    """

    kind: str = "loss"
    gs: float = 0.5
    costs: dict[str, float] | None = None
    no_attack: bool = False


def cell_loss(leaves: Column, domain: Column) -> Column:
    return F.when(domain > 1, (leaves - 1) / (domain - 1)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Prepared:
    """The tables a search reads again and again, both in the shared folder."""

    base: DataFrame
    levels: DataFrame
    bits: bool
    domains: dict[str, float]
    tops: dict[str, str]  # label of attributes whose values are all listed and end in one
    coded: DataFrame | None = None  # the tuples with all their labels, see ``coded_tuples``


def prepare(df: DataFrame, definition: Definition, extra: Sequence[str] = (), bits: bool = False) -> Prepared:
    """One pass over the rows for the distinct tuples, then one over those for all levels."""
    base = base_table(df, definition, extra)
    levels = materialize(level_tables(base, definition, bits), "levels")
    heights = F.create_map(*[x for q, h in zip(definition.qid, definition.heights) for x in (F.lit(q), F.lit(h))])
    top = F.when(F.col("level") == heights[F.col("attribute")], F.coalesce("label", F.lit("")))
    unlisted = F.count_if((F.col("level") == 0) & F.col("label").isNull() & F.col("raw").isNotNull())
    facts = levels.groupBy("attribute").agg(
        F.max("domain").cast("double").alias("domain"), F.min(top).alias("low"), F.max(top).alias("high"), unlisted.alias("unlisted"))
    rows = facts.collect()  # one line per quasi-identifier
    tops = {r["attribute"]: r["low"] for r in rows if r["low"] == r["high"] and not r["unlisted"]}
    return Prepared(base, levels, bits, {r["attribute"]: r["domain"] for r in rows}, tops)


def expanded(
    prepared: Prepared, definition: Definition, chosen: Sequence[tuple[int, ...]], keep: Sequence[str] = ()
) -> DataFrame:
    """The distinct tuples of every node with their count and loss.

    Attributes are generalized one after the other, merging equal tuples in between,
    so a high level is reached from the few tuples of the level table below it rather
    than from all raw tuples: the rows expanded are about the sum, not the product,
    of the levels. Attributes all nodes leave raw or hide altogether need no lookup,
    so of many columns only those in between cost a join.
    """
    qid, base, bits = definition.qid, prepared.base, prepared.bits
    total = sum(definition.weight(q) for q in qid)
    zero = F.lit(0.0)
    figures = {"cell_loss": F.max, "info_loss": F.max, "info_most": F.max}
    if bits:
        figures.update(bits=F.sum, most=F.sum)
    pinned = {i: chosen[0][i] for i in range(len(qid)) if not bits and qid[i] in prepared.tops and len({n[i] for n in chosen}) == 1}
    hidden = [i for i, level in pinned.items() if level == definition.heights[i]]
    raw = [i for i, level in pinned.items() if level == 0 and i not in hidden]
    sizes = prepared.domains
    start = {
        "cell_loss": sum(definition.weight(qid[i]) / total for i in hidden if sizes[qid[i]] > 1),
        "info_loss": sum(math.log(sizes[qid[i]]) for i in hidden),
        "info_most": sum(math.log(sizes[qid[i]]) for i in [*hidden, *raw]),
    }
    shown = [q for i, q in enumerate(qid) if i not in hidden]
    at = base.select(*shown, *keep, "cnt", *[F.lit(float(start.get(c, 0.0))).alias(c) for c in figures])
    order = sorted((i for i in range(len(qid)) if i not in hidden and i not in raw), key=lambda i: -definition.heights[i])
    if not order:
        at = at.groupBy(*shown, *keep).agg(F.sum("cnt").alias("cnt"), *[f(c).alias(c) for c, f in figures.items()])
    for done, i in enumerate(order):
        q, w = qid[i], definition.weight(qid[i]) / total
        lookup = prepared.levels.filter(F.col("attribute") == q).select(
            F.col("raw").alias("_raw"), F.col("level").alias(f"l_{q}"), F.col("label").alias(f"g_{q}"),
            "leaves", "domain", *([F.col("bits").alias("_b"), F.col("most").alias("_m")] if bits else []))
        lookup = lookup.filter(F.col(f"l_{q}").isin(sorted({n[i] for n in chosen})))
        at = at.join(lookup, F.col(q).cast("string").eqNullSafe(F.col("_raw")))
        so_far = order[: done + 1]
        prefixes = sorted({tuple(n[j] for j in so_far) for n in chosen})
        possible = 1
        for j in so_far:
            possible *= len({n[j] for n in chosen})
        if len(prefixes) < possible:
            name = F.concat_ws(",", *[F.col(f"l_{qid[j]}").cast("string") for j in so_far])
            at = at.filter(name.isin([node_name(x) for x in prefixes]))
        grown = {
            "cell_loss": F.col("cell_loss") + F.lit(w) * cell_loss(F.col("leaves"), F.col("domain")),
            "info_loss": F.col("info_loss") + F.log(F.col("leaves").cast("double")),
            "info_most": F.col("info_most") + F.log(F.col("domain").cast("double")),
        }
        if bits:
            scale = F.lit(w * len(qid)) * F.col("cnt")
            grown.update(bits=F.col("bits") + scale * F.col("_b"), most=F.col("most") + scale * F.col("_m"))
        keys = [*[x for j in so_far for x in (f"l_{qid[j]}", f"g_{qid[j]}")], *[qid[j] for j in [*order[done + 1:], *raw]], *keep]
        at = at.groupBy(*keys).agg(F.sum("cnt").alias("cnt"), *[f(grown[c]).alias(c) for c, f in figures.items()])
    level = lambda i: F.lit(str(pinned[i])) if i in hidden or i in raw else F.col(f"l_{qid[i]}").cast("string")
    label = lambda i: F.lit(prepared.tops[qid[i]]) if i in hidden else F.col(qid[i]).cast("string") if i in raw else F.col(f"g_{qid[i]}")
    return at.select(
        F.concat_ws(",", *[level(i) for i in range(len(qid))]).alias("node"),
        *[label(i).alias(f"g_{q}") for i, q in enumerate(qid)], *keep, "cnt", "cell_loss",
        F.when(F.col("info_most") > 0, F.col("info_loss") / F.col("info_most")).otherwise(zero).alias("info_loss"),
        *(["bits", "most"] if bits else []),
    )


def coded_tuples(prepared: Prepared, definition: Definition, keep: Sequence[str] = ()) -> DataFrame:
    """The distinct tuples with, for each attribute, number and loss of its label on every level; written once.

    Any node is then one aggregation of short keys, without lookups: where few tuples merge on the way up, joins of one
    attribute after the other cost more than they save. A value listed several times counts as often, as in ``expanded``.
    """
    labels = prepared.levels.select("attribute", "level", "label").distinct()
    labels = materialize(labels.withColumn("code", F.monotonically_increasing_id()), "labels")
    known = null_safe(prepared.levels, labels, ["attribute", "level", "label"])
    known = known.groupBy("attribute", "raw", "level").agg(
        F.max(F.struct("code", cell_loss(F.col("leaves"), F.col("domain")).alias("loss"), F.log(F.col("leaves").cast("double")).alias("info"))).alias("at"),
        F.count("*").alias("_times"))
    known = materialize(known.groupBy("attribute", "raw").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("level", "at"))), lambda x: x["at"]).alias("_at"), F.max("_times").alias("_times")), "codes")
    out = prepared.base
    for q in definition.qid:
        lookup = known.where(F.col("attribute") == q).select("raw", F.col("_at").alias(f"c_{q}"), F.col("_times").alias("_t"))
        out = out.join(lookup, F.col(q).cast("string").eqNullSafe(F.col("raw"))).withColumn("cnt", F.col("cnt") * F.col("_t")).drop("raw", "_t")
    return materialize(out.select(*[f"c_{q}" for q in definition.qid], *keep, "cnt"), "coded")


def expanded_coded(prepared: Prepared, definition: Definition, chosen: Sequence[tuple[int, ...]], keep: Sequence[str] = ()) -> DataFrame:
    """``expanded`` from the coded tuples, with numbers in place of the labels."""
    qid = definition.qid
    total, most = sum(definition.weight(q) for q in qid), sum(math.log(prepared.domains[q]) for q in qid)
    wanted = F.array(*[F.struct(F.lit(node_name(n)).alias("node"), *[F.lit(x).alias(f"l_{q}") for q, x in zip(qid, n, strict=True)]) for n in chosen])
    at = lambda q: F.get(F.col(f"c_{q}"), F.col(f"_n.l_{q}"))
    cell = functools.reduce(lambda a, b: a + b, [F.lit(definition.weight(q) / total) * at(q)["loss"] for q in qid])
    info = functools.reduce(lambda a, b: a + b, [at(q)["info"] for q in qid])
    spread = prepared.coded.withColumn("_n", F.explode(wanted)).select(
        "_n.node", *[at(q)["code"].alias(f"g_{q}") for q in qid], *keep, "cnt", cell.alias("cell_loss"), info.alias("_info"))
    out = spread.groupBy("node", *[f"g_{q}" for q in qid], *keep).agg(
        F.sum("cnt").alias("cnt"), F.max("cell_loss").alias("cell_loss"), F.max("_info").alias("_info"))
    return out.withColumn("info_loss", F.col("_info") / most if most > 0 else F.lit(0.0)).drop("_info")


def payout(n: Column, info_loss: Column, costs: dict[str, float], no_attack: bool) -> Column:
    """What the publisher earns per record of a class of size ``n``."""
    benefit, loss = F.lit(costs["publisher_benefit"]), F.lit(costs["publisher_loss"])
    attacked = F.lit(costs["adversary_gain"]) / n > F.lit(costs["adversary_cost"])
    earned = benefit * (F.lit(1.0) - info_loss)
    if no_attack:
        return F.when(attacked, F.lit(0.0)).otherwise(earned)
    return F.when(attacked, earned - loss / n).otherwise(earned)


def search_columns(definition: Definition, models: Sequence[Model], quality: Quality) -> list[str]:
    """Columns besides the quasi-identifiers that models and quality look at."""
    target = {definition.target} if quality.kind == "classification" else set()
    return sorted({c for m in models for c in m.columns} | target)


def scores(
    df: DataFrame,
    definition: Definition,
    models: Sequence[Model],
    quality: Quality = Quality(),
    suppression: float = 0.0,
    chosen: Sequence[tuple[int, ...]] | None = None,
    prepared: Prepared | None = None,
) -> DataFrame:
    """One line per node: loss, suppressed rows, classes left and validity.

    All nodes of a batch are one plan: expand the distinct tuples, count classes,
    judge them, sum up per node. The rows are read once, by ``prepare``.
    """
    chosen = nodes(definition) if chosen is None else list(chosen)
    extra = search_columns(definition, models, quality)
    prepared = prepared or prepare(df, definition, extra, quality.kind == "entropy")
    varying = sum(len({n[i] for n in chosen}) > 1 for i in range(len(definition.qid)))
    batch = NODES_TOGETHER if varying > MAX_VARYING else MAX_NODES_PER_JOB
    parts = [
        _score_batch(prepared, definition, models, quality, suppression, chosen[i:i + batch], extra)
        for i in range(0, len(chosen), batch)
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def _score_batch(prepared, definition, models, quality, suppression, chosen, extra):
    keys = ["node", *[f"g_{q}" for q in definition.qid]]
    bits = quality.kind == "entropy"
    wide = (expanded if prepared.coded is None else expanded_coded)(prepared, definition, chosen, extra)
    if len(models) > 1 or any(m.columns for m in models) or quality.kind == "classification":
        wide = materialize(wide, "nodes")  # each measure reads it
    sums = [F.sum("bits").alias("bits"), F.sum("most").alias("most")] if bits else []
    classes = class_verdicts(wide, keys, models, [F.max("cell_loss").alias("cell_loss"), F.max("info_loss").alias("info_loss"), *sums])
    if quality.kind == "classification":
        major = wide.groupBy(*keys, definition.target).agg(F.sum("cnt").alias("_t")).groupBy(*keys).agg(F.max("_t").alias("majority"))
        classes = null_safe(classes, major, keys)
    n, bad = F.col("n"), ~F.col("ok")
    scored = classes.groupBy("node").agg(
        F.sum(n).alias("rows"),
        F.sum(F.when(bad, n).otherwise(0)).alias("suppressed"),
        F.count(F.when(~bad, n)).alias("classes"),
        _node_loss(quality, n, bad).alias("_sum"),
    )
    heights = sum(definition.heights)
    if quality.kind == "height":
        loss = F.aggregate(F.split("node", ","), F.lit(0), lambda a, x: a + x.cast("int")).cast("double")
    elif quality.kind == "payout":
        loss = -F.col("_sum")
    elif quality.kind == "entropy":
        loss = F.col("_sum")
    else:
        loss = F.col("_sum") / F.col("rows")
    valid = F.col("suppressed") <= F.lit(float(suppression)) * F.col("rows")
    valid = valid & table_predicate(models, F.col("classes"), F.col("rows") - F.col("suppressed"))
    return scored.select(
        "node",
        F.aggregate(F.split("node", ","), F.lit(0), lambda a, x: a + x.cast("int")).alias("level"),
        "rows", "suppressed", "classes", loss.alias("loss"), valid.alias("valid"),
    )


def _node_loss(quality: Quality, n: Column, bad: Column) -> Column:
    if quality.kind == "loss":
        g, s = min(1.0, 2 * (1 - quality.gs)), min(1.0, 2 * quality.gs)
        return F.sum(n * F.when(bad, F.lit(s)).otherwise(F.lit(g) * F.col("cell_loss")))
    if quality.kind == "entropy":
        return F.sum(F.when(bad, F.col("most")).otherwise(F.col("bits")))
    if quality.kind == "classification":
        return F.sum(F.when(bad, n).otherwise(n - F.col("majority")))
    if quality.kind == "payout":
        each = payout(n, F.col("info_loss"), quality.costs, quality.no_attack)
        return F.sum(F.when(bad, F.lit(0.0)).otherwise(n * F.greatest(each, F.lit(0.0)) if not quality.no_attack else n * each))
    return F.lit(0.0) if quality.kind != "height" else F.sum(F.lit(0.0))


def optimum(scored: DataFrame) -> DataFrame:
    """The valid node of least loss; ties go to the lower level, then the lower name."""
    order = F.struct(F.round("loss", 9), "level", "node")
    return scored.filter("valid").agg(F.min_by(F.struct(*scored.columns), order).alias("best")).filter(
        "best is not null"
    ).select("best.*")


def node_levels(definition: Definition, name: str) -> dict[str, int]:
    return dict(zip(definition.qid, (int(x) for x in name.split(","))))


# ------------------------------------------------------------------ search without listing the lattice


def least_losses(prepared: Prepared, definition: Definition, quality: Quality) -> list[list[float]]:
    """For each attribute and level, what it adds to the loss of every node at that level or above, whatever is suppressed.

    The mean loss of an attribute's cells needs the counts of its own values only. A suppressed row loses ``s``, which may
    be less than its cells do; cells are weighed by the smaller factor, so the sum stays below the loss of any node above.
    """
    if quality.kind == "height":
        return [[float(level) for level in range(h + 1)] for h in definition.heights]
    if quality.kind != "loss":
        return [[0.0] * (h + 1) for h in definition.heights]
    counts = functools.reduce(DataFrame.unionByName, [
        prepared.base.groupBy(F.col(q).cast("string").alias("raw")).agg(F.sum("cnt").alias("_f")).select(F.lit(q).alias("attribute"), "*")
        for q in definition.qid
    ])
    weighed = null_safe(prepared.levels, counts, ["attribute", "raw"]).groupBy("attribute", "level").agg(
        (F.sum(F.col("_f") * cell_loss(F.col("leaves"), F.col("domain"))) / F.sum("_f")).alias("mean"))
    means = {(r["attribute"], r["level"]): r["mean"] for r in weighed.collect()}  # a line for each level of an attribute
    factor = min(1.0, 2 * (1 - quality.gs), 2 * quality.gs) / sum(definition.weight(q) for q in definition.qid)
    out = []
    for q, h in zip(definition.qid, definition.heights, strict=True):
        steps = [factor * definition.weight(q) * means.get((q, level), 0.0) for level in range(h + 1)]
        # Nodes above a level include those at it: what any of them adds at least.
        out.append([min(steps[level:]) for level in range(h + 1)])
    return out


def nested(prepared: Prepared) -> bool:
    """Whether every label has one label above it, so that classes only merge on the way up."""
    ladder = prepared.levels.groupBy("attribute", "raw").agg(
        F.array_sort(F.collect_list(F.struct("level", F.coalesce("label", F.lit("\0")).alias("label")))).alias("_l"))
    steps = F.transform(F.sequence(F.lit(1), F.size("_l") - 1), lambda k: F.struct(
        F.get("_l", k - 1).alias("under"), F.get("_l", k)["label"].alias("over")))
    pairs = ladder.where(F.size("_l") > 1).select("attribute", F.inline(steps))
    return pairs.groupBy("attribute", "under").agg((F.min("over") != F.max("over")).alias("apart")).where("apart").isEmpty()


class Frontier:
    """The part of a lattice that may still hold a better node, as cones: a node and all nodes above it.

    Cones are taken in order of their least loss. With monotone models a node that fails fails with all nodes below it, so
    a cone that begins below a known failure is replaced by the cones that leave it behind in one attribute. No list of
    all nodes is made.
    """

    def __init__(self, low: Sequence[int], high: Sequence[int], least: Sequence[Sequence[float]], monotone: bool):
        self.low, self.high, self.least, self.monotone = tuple(low), tuple(high), least, monotone
        self.failed: list[tuple[int, ...]] = []
        self.heap: list[tuple[float, int, tuple[int, ...]]] = []
        self.seen: set[tuple[int, ...]] = set()
        self.add(self.low)

    def bound(self, node: Sequence[int]) -> float:
        return sum(steps[level] for steps, level in zip(self.least, node, strict=True))

    def add(self, node: tuple[int, ...]) -> None:
        if node not in self.seen:
            self.seen.add(node)
            heapq.heappush(self.heap, (self.bound(node), sum(node), node))

    def again(self, node: tuple[int, ...]) -> None:
        self.seen.discard(node)
        self.add(node)

    def raise_from(self, node: tuple[int, ...], to: Sequence[int]) -> None:
        """The cones above ``node`` that pass ``to`` in one attribute."""
        for i, level in enumerate(to):
            if level < self.high[i]:
                self.add((*node[:i], level + 1, *node[i + 1:]))

    def fail(self, node: tuple[int, ...]) -> None:
        if self.monotone and not self.fails(node):
            self.failed = [f for f in self.failed if not all(a <= b for a, b in zip(f, node, strict=True))] + [node]

    def take(self, n: int, limit: float) -> list[tuple[int, ...]]:
        """Up to ``n`` nodes that aren't known to fail, of cones that may hold a loss of ``limit`` or less."""
        taken: list[tuple[int, ...]] = []
        while self.heap and len(taken) < n and self.heap[0][0] <= limit:
            _, _, node = heapq.heappop(self.heap)
            above = [f for f in self.failed if all(a <= b for a, b in zip(node, f, strict=True))]
            if above:
                self.raise_from(node, max(above, key=sum))
            else:
                taken.append(node)
        return taken

    def fails(self, node: tuple[int, ...]) -> bool:
        return any(all(a <= b for a, b in zip(node, f, strict=True)) for f in self.failed)

    def path(self, node: tuple[int, ...], limit: float = math.inf) -> list[tuple[int, ...]]:
        """From ``node`` as high as the bound stays within ``limit``, always by the step that adds least to it."""
        out = [node]
        while out[-1] != self.high:
            at = out[-1]
            steps = [(self.least[i][at[i] + 1] - self.least[i][at[i]], i) for i in range(len(at)) if at[i] < self.high[i]]
            i = min(steps)[1]
            above = (*at[:i], at[i] + 1, *at[i + 1:])
            if self.bound(above) > limit:
                break
            out.append(above)
        return out


def search(
    df: DataFrame,
    definition: Definition,
    models: Sequence[Model],
    quality: Quality = Quality(),
    suppression: float = 0.0,
    low: dict[str, int] | None = None,
    high: dict[str, int] | None = None,
    prepared: Prepared | None = None,
    at_a_time: int = 16,
) -> Row | None:
    """The line of ``optimum`` without scoring all nodes: for definitions whose lattice is too large to list.

    Nodes are judged in batches, each one plan over the distinct tuples. For the nodes with the least possible losses the
    highest ones above them that may still beat the best are judged first, as their failure settles all below; for nodes
    that this leaves open, they and those halfway to the top follow. Nothing is left out that may be better than
    the best node known, so the result is that of all nodes. Losses other than ``loss`` and ``height`` have no bound, and
    models that aren't monotone or hierarchies that aren't nested settle nothing; less is passed over then.
    """
    extra = search_columns(definition, models, quality)
    prepared = prepared or prepare(df, definition, extra, quality.kind == "entropy")
    if not prepared.bits and sum(h > 0 for h in definition.heights) > MAX_VARYING:
        prepared = replace(prepared, coded=coded_tuples(prepared, definition, extra))
    start = [(low or {}).get(q, 0) for q in definition.qid]
    end = [(high or {}).get(q, h) for q, h in zip(definition.qid, definition.heights, strict=True)]
    least = least_losses(prepared, definition, quality)
    bounded = quality.kind in ("loss", "height")
    walk = Frontier(start, end, least, all(m.monotone for m in models) and nested(prepared))
    known: dict[tuple[int, ...], Row] = {}
    best: tuple | None = None

    def judge(wanted: Sequence[tuple[int, ...]]) -> None:
        nonlocal best
        new = sorted({n for n in wanted if n not in known})
        if not new:
            return
        for r in _score_batch(prepared, definition, models, quality, suppression, new, extra).collect():  # a line for each node
            node = tuple(int(x) for x in r["node"].split(","))
            known[node] = r
            rank = (round(r["loss"], 9), r["level"], r["node"])
            if not r["valid"]:
                walk.fail(node)
            elif best is None or rank < best:
                best = rank

    if walk.monotone:
        judge(walk.path(walk.low))
    while True:
        limit = best[0] + 2e-9 if best and bounded else math.inf
        taken = walk.take(at_a_time, limit)
        if not taken:
            break
        if walk.monotone and limit < math.inf:
            judge([walk.path(n, limit)[-1] for n in taken])
            for node in [n for n in taken if walk.fails(n)]:
                taken.remove(node)
                walk.again(node)
        probes = [(path := walk.path(n))[len(path) // 2] for n in taken] if walk.monotone else []
        judge([*taken, *probes])
        for node in taken:
            # A node that loses no more than its cone must is the best of it.
            if not (bounded and known[node]["valid"] and known[node]["loss"] <= walk.bound(node) + 1e-9):
                walk.raise_from(node, node)
    return None if best is None else known[tuple(int(x) for x in best[2].split(","))]
