"""Experiment grids: folds x k x sample rate, shared by several queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.definition import STAR
from cloakframe.operators import anonymize as A
from cloakframe.operators import sampling as S
from cloakframe.operators.classes import class_sizes, is_suppressed
from cloakframe.operators.ranking import null_safe
from cloakframe.plans.tables import FOLDS, GEN, ID, QID, QKEY, SEED, TARGET, generalized
from cloakframe.session import materialize

KS = [5, 20]
BS = [0.5, 0.1]
CELL = ["fold", "k"]
ROWS_BEFORE_COPIES = 250_000  # of a task that then writes out its rows once for each sample


def fold_rows(spark, sf) -> DataFrame:
    """The generalized rows with the fold that holds them out."""
    rows = materialize(generalized(spark, sf).select("o_orderkey", *QID, TARGET), "generalized")  # read for each step of the cuts
    return S.k_fold(rows, FOLDS, ID, SEED)


def own_counts(rows: DataFrame) -> DataFrame:
    """Merged rows ``(qid, target, fold, cnt)`` of ``fold_rows``."""
    return rows.groupBy(*QID, TARGET, "fold").agg(F.count("*").alias("cnt"))


def fold_counts(spark, sf) -> DataFrame:
    """Merged rows ``(qid, target, fold, cnt)`` of every training fold: whole counts less those held out."""
    rows = S.k_fold(generalized(spark, sf).select("o_orderkey", *QID, TARGET), FOLDS, ID, SEED)
    return A.train_counts(own_counts(rows), [*QID, TARGET], FOLDS)


def run_counts(spark, sf, ks=KS, carry=()) -> DataFrame:
    """Rows of every training fold, k-anonymous for every k, as counts ``(fold, k, qid, carry, cnt)``."""
    return A.publish_counts(fold_counts(spark, sf), QID, ks, ["fold"], carry)


def sample_sizes(classes: DataFrame) -> DataFrame:
    """Rows ``s`` that each class ``(fold, k, qid, n)`` gives to the stratified sample of every rate."""
    rates = F.array(*[F.lit(b) for b in BS])
    quotas = classes.groupBy(*CELL).agg(F.sum("n").alias("_t")).withColumn("b", F.explode(rates))
    quotas = quotas.select(*CELL, "b", S.sample_amount(F.col("_t"), F.col("b")).alias("quota"))
    return S.stratified_sizes(classes.withColumn("b", F.explode(rates)), [*CELL, "b"], QID, quotas, SEED)


def reaches(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """For each class and own fold, ``_cells``: how many of its rows, in hash order, each sample of (fold, k, b) takes.

    Folds are ranges of the same hash order, so the rows of a class stand in it fold by fold: a sample of ``s`` rows takes
    whole folds, less the one held out, and the first rows of the last. The most comes first.
    """
    own = [F.sum(F.when(F.col("fold") == i, F.col("cnt")).otherwise(0)).alias(f"_{i}") for i in range(FOLDS)]
    held = counts.groupBy(*QID).agg(*own).select(*QID, F.array(*[f"_{i}" for i in range(FOLDS)]).alias("_held"))
    cells = sizes.filter("s > 0").groupBy(*QID).agg(F.collect_list(F.struct("s", "fold", "k", "b")).alias("_sizes"))
    both = null_safe(held, cells, QID).withColumn("_own", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))))
    before = F.aggregate(F.slice("_held", 1, F.col("_own")), F.lit(0).cast("bigint"), lambda a, x: a + x)

    def reach(c):
        skipped = F.when(c["fold"] < F.col("_own"), F.get("_held", c["fold"])).otherwise(0)
        return F.struct((c["s"] - F.col("_before") + skipped).alias("reach"), c["fold"].alias("fold"), c["k"].alias("k"), c["b"].alias("b"))

    both = both.filter(F.get("_held", F.col("_own")) > 0).withColumn("_before", before)
    mine = F.transform(F.filter("_sizes", lambda c: c["fold"] != F.col("_own")), reach)
    mine = F.reverse(F.array_sort(F.filter(mine, lambda c: c["reach"] > 0)))
    return both.select(*QID, "_own", mine.alias("_cells"))


class Grid:
    """The stratified samples of every (fold, k) output at every rate, as marks on the rows.

    ``marked`` has each row once, with the number ``_m`` of the samples that reach it, of those its class and own fold
    list in ``reached``. Rows hidden in the class of stars, whose order is not that of their own class, are in ``starred``
    once for each sample; there are fewer than ``k`` of a class in a training set.
    """

    def __init__(self, rows: DataFrame):
        rows = materialize(rows, "folds")
        counts = materialize(own_counts(rows), "counts")
        trained = A.train_counts(counts, [*QID, TARGET], FOLDS)
        classes = materialize(A.publish_counts(trained, QID, KS, ["fold"]).withColumnRenamed("cnt", "n"), "classes")
        sizes = materialize(sample_sizes(classes), "sizes")
        hidden = is_suppressed(QID)
        groups = counts.groupBy(*QID, "fold").agg(F.sum("cnt").alias("_n"))
        self.reached = materialize(reaches(counts, sizes.filter(~hidden)).filter(F.size("_cells") > 0), "reached")
        keys = [*QID, "_own"]
        ranked = S.ranked(rows, [*QID, "fold"], ID, S.order_hash(SEED, ID), rank="_rank", sizes=groups).withColumnRenamed("fold", "_own")
        met = F.size(F.filter("_cells", lambda c: c["reach"] >= F.col("_rank")))
        marked = null_safe(ranked, self.reached, keys).withColumn("_m", met).filter("_m > 0")
        self.marked = materialize(marked.select(*keys, *ID, TARGET, "_m"), "marked")
        self.starred = materialize(self._starred(rows, trained, sizes.filter(hidden), classes.filter(hidden)), "starred")
        self.values = counts.select(TARGET).distinct()

    @staticmethod
    def _starred(rows: DataFrame, trained: DataFrame, sizes: DataFrame, classes: DataFrame) -> DataFrame:
        small = class_sizes(trained, ["fold", *QID], "_n", "cnt").withColumn("k", F.explode(F.array(*[F.lit(k) for k in KS])))
        small = small.filter((F.col("_n") < F.col("k")) | is_suppressed(QID)).groupBy(*QID).agg(F.collect_list(F.struct("fold", "k")).alias("_sets"))
        sets = F.filter("_sets", lambda c: c["fold"] != F.col("_own"))
        copies = null_safe(rows.withColumnRenamed("fold", "_own"), small, QID).select(*ID, TARGET, F.inline(sets))
        ranked = S.ranked(copies, CELL, ID, S.order_hash(SEED, ID), rank="_rank", sizes=classes.select(*CELL, F.col("n").alias("_n")))
        reached = null_safe(ranked, sizes.filter("s > 0").select(*CELL, "b", "s"), CELL).filter("_rank <= s")
        return reached.select(*CELL, *ID, *[F.lit(STAR).alias(q) for q in QID], TARGET, "b")

    def _of(self, marks: DataFrame) -> DataFrame:
        """A line of ``marks`` once for each sample that it is in."""
        return null_safe(marks, self.reached, [*QID, "_own"]).withColumn("_c", F.explode(F.slice("_cells", 1, F.col("_m"))))

    def samples(self) -> DataFrame:
        """The rows of all samples."""
        names = [*CELL, *ID, *QID, TARGET, "b"]
        dealt = self.marked.repartition(-(-self.marked.count() // ROWS_BEFORE_COPIES) or 1)
        drawn = self._of(dealt).select("_c.fold", "_c.k", *ID, *QID, TARGET, "_c.b")
        return drawn.select(*names).unionByName(self.starred.select(*names))

    def counts(self) -> DataFrame:
        """How many rows of a class and target value each sample has, ``(fold, k, b, qid, target, n)``; no row is copied."""
        names = [*CELL, "b", *QID, TARGET]
        lines = self.marked.groupBy(*QID, "_own", TARGET, "_m").agg(F.count("*").alias("n"))
        plain = self._of(lines).select("_c.fold", "_c.k", "_c.b", *QID, TARGET, "n")
        stars = self.starred.select(*names, F.lit(1).cast("bigint").alias("n"))
        return plain.unionByName(stars).groupBy(*names).agg(F.sum("n").alias("n"))


def sample_grid(spark, sf) -> Grid:
    return Grid(fold_rows(spark, sf))


def samples(spark, sf) -> DataFrame:
    return sample_grid(spark, sf).samples()


GRID = GEN + f""", folds AS (SELECT o_orderkey, CAST(ntile(10) OVER (ORDER BY md5('7|' || o_orderkey)) - 1 AS INTEGER) AS own FROM people),
  train AS (SELECT CAST(f.fold AS INTEGER) AS fold, o_orderkey, {QKEY}, price_bin FROM gen JOIN folds USING (o_orderkey), range(10) f(fold) WHERE f.fold <> own),
  pops AS (SELECT fold, CAST(k AS INTEGER) AS k, o_orderkey, price_bin, CASE WHEN cn < k THEN '*' ELSE n_name END AS n_name, CASE WHEN cn < k THEN '*' ELSE c_mktsegment END AS c_mktsegment,
      CASE WHEN cn < k THEN '*' ELSE o_orderdate END AS o_orderdate
    FROM (SELECT *, count(*) OVER (PARTITION BY fold, {QKEY}) AS cn FROM train), (VALUES (5), (20)) v(k))"""

STATS = GRID + f""", cl AS (SELECT fold, k, {QKEY}, count(*) AS n, n_name = '*' AND c_mktsegment = '*' AND o_orderdate = '*' AS st FROM pops GROUP BY ALL),
  stats AS (SELECT fold, k, CAST(coalesce(sum(n) FILTER (st), 0) AS BIGINT) AS suppressed, CAST(coalesce(sum(n) FILTER (NOT st), 0) AS BIGINT) AS sample_size, CAST(sum(n) AS BIGINT) AS input_size,
    count(*) FILTER (NOT st) AS classes, avg(n) FILTER (NOT st) AS avg_size FROM cl GROUP BY fold, k)"""

SAMPLES = GRID + f""", cellsize AS (SELECT fold, k, b, floor(count(*) * b) AS m FROM pops, (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.1 AS DOUBLE))) v(b) GROUP BY fold, k, b),
  rk AS (SELECT *, row_number() OVER (PARTITION BY fold, k, {QKEY} ORDER BY md5('7|' || o_orderkey)) AS j, count(*) OVER (PARTITION BY fold, k, {QKEY}) AS cn FROM pops),
  samples AS (SELECT * EXCLUDE (j, cn, m) FROM rk JOIN cellsize USING (fold, k)
    QUALIFY row_number() OVER (PARTITION BY fold, k, b ORDER BY CAST(j AS DOUBLE) / cn, md5(concat_ws('|', '7', fold, k, CAST(b AS VARCHAR), {QKEY})), {QKEY}) <= m)"""
