"""Preparing for, running and comparing classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe.operators import anonymize as A
from cloakframe.operators import classes as C
from cloakframe.operators import hierarchies as H
from cloakframe.operators import ml as M
from cloakframe.operators import sampling as S
from cloakframe.operators import stats as T
from cloakframe.operators.privacy import KAnonymity
from cloakframe.plans.grids import GRID, KS, fold_counts, run_counts
from cloakframe.plans.registry import register
from cloakframe.plans.tables import FOLDS, ID, NODE, PEOPLE, QID, QKEY, SEED, TARGET, definition, generalized, people
from cloakframe.session import materialize

CAT = ["n_name", "c_mktsegment", "o_orderdate", "o_orderpriority"]


def split(spark, sf):
    """First fold as test set, the others for training."""
    rows = materialize(S.k_fold(people(spark, sf), FOLDS, ID, SEED), "folds")
    return rows.filter("fold <> 0"), rows.filter("fold = 0")


TRAIN = PEOPLE + """, f AS (SELECT *, ntile(10) OVER (ORDER BY md5('7|' || o_orderkey)) - 1 AS fold FROM people), tr AS (SELECT * FROM f WHERE fold <> 0), te AS (SELECT * FROM f WHERE fold = 0)"""


@register("ordinal_encode", f"""WITH {TRAIN}, v AS (SELECT c_name, CAST(row_number() OVER (ORDER BY c_name) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT c_name FROM tr)),
  w AS (SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT o_orderpriority FROM tr))
  SELECT o_orderkey, coalesce(v.code, -1) AS c_name, coalesce(w.code, -1) AS o_orderpriority FROM te LEFT JOIN v USING (c_name) LEFT JOIN w USING (o_orderpriority)""")
def ordinal_encode(spark, sf):
    train, test = split(spark, sf)
    return M.ordinal_encode(train, test, ["c_name", "o_orderpriority"]).select("o_orderkey", "c_name", "o_orderpriority")


@register("standard_scale", f"WITH {TRAIN} SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM tr)) / (SELECT stddev_pop(o_totalprice) FROM tr), 6) AS o_totalprice FROM te")
def standard_scale(spark, sf):
    train, test = split(spark, sf)
    return M.standard_scale(train, test, ["o_totalprice"]).select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))


@register("one_hot", "SELECT o_orderkey, (o_orderstatus = 'F')::INTEGER AS \"o_orderstatus_F\", (o_orderstatus = 'O')::INTEGER AS \"o_orderstatus_O\", (o_orderstatus = 'P')::INTEGER AS \"o_orderstatus_P\" FROM orders")
def one_hot(spark, sf):
    return M.one_hot(people(spark, sf).select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"])


@register("ml_majority", f"WITH {PEOPLE} SELECT price_bin AS prediction, round(CAST(n AS DOUBLE) / sum(n) OVER (), 6) AS accuracy FROM (SELECT price_bin, count(*) AS n FROM people GROUP BY price_bin) QUALIFY row_number() OVER (ORDER BY n DESC, price_bin) = 1")
def ml_majority(spark, sf):
    return M.majority(people(spark, sf), TARGET).withColumn("accuracy", F.round("accuracy", 6))


def anonymized_split(spark, sf):
    """Training folds published at a node, test fold generalized to the same node."""
    train, test = split(spark, sf)
    d = definition(spark, sf)
    output = materialize(A.publish(train, d, NODE, [KAnonymity(10)]), "published")
    return output, materialize(H.generalize(test, d, NODE), "test")


def report(df):
    return df.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("ml_gbt_report")
def ml_gbt_report(spark, sf):
    """Stratified sample of the anonymized folds, suppressed rows dropped, boosted trees."""
    output, test = anonymized_split(spark, sf)
    drawn = materialize(C.drop_suppressed(S.stratified_sample(output, QID, 0.5, ID, SEED), QID), "train")
    return report(M.evaluate(drawn, test, TARGET, CAT, kind=M.GBT, rounds=3))


@register("ml_balanced_report")
def ml_balanced_report(spark, sf):
    """The same after reducing every target value to the size of the rarest."""
    output, test = anonymized_split(spark, sf)
    even = materialize(S.undersample(C.drop_suppressed(output, QID), TARGET, ID, SEED), "train")
    return report(M.evaluate(even, test, TARGET, CAT, kind=M.GBT, rounds=3))


@register("ml_baseline_report")
def ml_baseline_report(spark, sf):
    """Boosted trees on rows that are not anonymized."""
    train, test = split(spark, sf)
    as_year = lambda d: d.withColumn("o_orderdate", F.year("o_orderdate").cast("string"))
    return report(M.evaluate(as_year(train), as_year(test), TARGET, CAT, kind=M.GBT, rounds=3))


def compared(spark, sf, kind):
    """Input against output for one kind of classifier."""
    train, test = split(spark, sf)
    as_year = lambda d: d.withColumn("o_orderdate", F.year("o_orderdate").cast("string"))
    raw = report(M.evaluate(as_year(train), as_year(test), TARGET, CAT, kind=kind, rounds=5))
    output, general = anonymized_split(spark, sf)
    masked = report(M.evaluate(output, general, TARGET, CAT, kind=kind, rounds=5))
    return raw.withColumn("data", F.lit("input")).unionByName(masked.withColumn("data", F.lit("output")))


@register("ml_lr_report")
def ml_lr_report(spark, sf):
    return compared(spark, sf, M.LOGISTIC)


@register("ml_nb_report")
def ml_nb_report(spark, sf):
    return compared(spark, sf, M.BAYES)


@register("ml_rf_report")
def ml_rf_report(spark, sf):
    return compared(spark, sf, M.FOREST)


@register("ml_grid_report")
def ml_grid_report(spark, sf):
    """One report per k of the anonymized training folds."""
    train, test = split(spark, sf)
    d = definition(spark, sf)
    general = materialize(H.generalize(test, d, NODE), "test")
    parts = None
    for k in (5, 20):
        output = materialize(A.publish(train, d, NODE, [KAnonymity(k)]), "published")
        one = report(M.evaluate(C.drop_suppressed(output, QID), general, TARGET, CAT, kind=M.FOREST, rounds=5)).withColumn("k", F.lit(k))
        parts = one if parts is None else parts.unionByName(one)
    return parts


@register("ml_feature_elimination")
def ml_feature_elimination(spark, sf):
    output, test = anonymized_split(spark, sf)
    lines = M.eliminate_features(output, test, TARGET, CAT, [], keep=2, rounds=5)
    return lines.withColumn("accuracy", F.round("accuracy", 6))


# ------------------------------------------------- all folds and k from counts

STAR_ROW = " AND ".join(f"{q} = '*'" for q in QID)
BAYES_GRID = GRID + f""", tr AS (SELECT fold, k, price_bin AS t, {QKEY} FROM pops WHERE NOT ({STAR_ROW}) UNION ALL SELECT fold, 0, price_bin, {QKEY} FROM train),
  pri AS (SELECT fold, k, t, count(*) AS n FROM tr GROUP BY ALL), tot AS (SELECT fold, k, sum(n) AS total FROM pri GROUP BY ALL),
  """ + ",\n  ".join(f"""c_{q} AS (SELECT fold, k, t, {q}, count(*) AS c FROM tr GROUP BY ALL), v_{q} AS (SELECT fold, k, count(DISTINCT {q}) AS nv FROM tr GROUP BY ALL)""" for q in QID) + f""",
  te AS (SELECT own AS fold, CAST(k AS INTEGER) AS k, price_bin, {QKEY}, count(*) AS cnt FROM gen JOIN folds USING (o_orderkey), (VALUES (0), (5), (20)) v(k) GROUP BY ALL),
  sc AS (SELECT te.*, pri.t, ln(pri.n / total) + """ + " + ".join(f"ln((coalesce(c_{q}.c, 0) + 1e0) / (pri.n + v_{q}.nv))" for q in QID) + """ AS score
    FROM te LEFT JOIN pri USING (fold, k) LEFT JOIN tot USING (fold, k) """ + " ".join(
    f"LEFT JOIN v_{q} USING (fold, k) LEFT JOIN c_{q} ON c_{q}.fold = te.fold AND c_{q}.k = te.k AND c_{q}.t = pri.t AND c_{q}.{q} = te.{q}" for q in QID) + f"""),
  pred AS (SELECT fold, k, price_bin, cnt, t AS predicted FROM sc QUALIFY row_number() OVER (PARTITION BY fold, k, price_bin, {QKEY} ORDER BY round(-score, 9), t) = 1),
  conf AS (SELECT fold, k, price_bin, predicted, CAST(sum(cnt) AS BIGINT) AS cnt FROM pred GROUP BY ALL)"""


def bayes_confusion(spark, sf):
    """Naive Bayes on every training fold, raw (k = 0) and k-anonymous without suppressed rows, tested on the fold held out."""
    raw = fold_counts(spark, sf)
    published = C.drop_suppressed(run_counts(spark, sf, carry=[TARGET]), QID)
    train = published.unionByName(raw.withColumn("k", F.lit(0)).select(*published.columns))
    rows = S.k_fold(generalized(spark, sf).select("o_orderkey", *QID, TARGET), FOLDS, ID, SEED)
    held_out = rows.groupBy("fold", *QID, TARGET).agg(F.count("*").alias("cnt"))
    test = held_out.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (0, *KS)])))
    return M.bayes_grid(train, test, ["fold", "k"], TARGET, QID)


@register("ml_bayes_grid", f"WITH {BAYES_GRID} SELECT * FROM conf")
def ml_bayes_grid(spark, sf):
    """Confusion counts of 30 classifiers: ten folds, raw and two k."""
    return bayes_confusion(spark, sf)


@register("ml_bayes_summary", f"""WITH {BAYES_GRID}, lab AS (SELECT fold, k, label, sum(support) AS support, sum(hit) AS hit, sum(said) AS said FROM (
    SELECT fold, k, price_bin AS label, cnt AS support, CASE WHEN price_bin = predicted THEN cnt ELSE 0 END AS hit, 0 AS said FROM conf
    UNION ALL SELECT fold, k, predicted, 0, 0, cnt FROM conf) WHERE label IS NOT NULL GROUP BY ALL),
  pr AS (SELECT *, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r FROM lab),
  rep AS (SELECT fold, k, label, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pr),
  frame AS (SELECT k, label, fold FROM (SELECT DISTINCT k, label FROM rep), (SELECT DISTINCT fold FROM conf)),
  full_ AS (SELECT k, label, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall, coalesce(f1, 0) AS f1 FROM frame LEFT JOIN rep USING (k, label, fold))
  SELECT k, label, """ + ", ".join(
    f"round({f}({m}), 6) AS {n}_{m}" for m in T.MEASURES for f, n in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max"))) + " FROM full_ GROUP BY k, label")
def ml_bayes_summary(spark, sf):
    """Mean, std, least and largest precision, recall and f1 of each target value over all folds."""
    confusion = materialize(bayes_confusion(spark, sf), "confusion")
    full = M.classification_report(confusion, ["fold", "k"], TARGET, "predicted", "cnt")
    labels = full.where(~F.col("label").isin("macro avg", "weighted avg", "accuracy"))
    lines = T.fold_mean_std(labels, labels, ["k"], FOLDS)
    return lines.select("k", "label", *[F.round(c, 6).alias(c) for c in lines.columns if c not in ("k", "label")])
