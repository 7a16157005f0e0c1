"""Preparing tables for learning, fitting classifiers and reporting on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.definition import STAR
from cloakframe.functions.text import range_midpoint
from cloakframe.operators.ranking import null_safe, ordered_positions
from cloakframe.session import materialize

# ------------------------------------------------------------------ preparation


def only_star(df: DataFrame, columns: Sequence[str]) -> Column:
    """One struct with, per column, whether it holds nothing but ``*``."""
    flags = [(F.bool_and(F.col(c).eqNullSafe(F.lit(STAR)))).alias(c) for c in columns]
    return df.agg(F.struct(*flags).alias("f")).scalar()


def starred_to_number(df: DataFrame, columns: Sequence[str], value: int = -1) -> DataFrame:
    """Columns that are ``*`` in every row become a constant."""
    marked = df.withColumn("_f", only_star(df, columns))
    out = {c: F.when(F.col(f"_f.{c}"), F.lit(str(value))).otherwise(F.col(c)) for c in columns}
    return marked.withColumns(out).drop("_f")


def ranges_to_midpoints(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``[a, b[`` becomes (a+b)/2 and a column of only ``*`` becomes 0; other text that
    is a number keeps its value."""
    marked = df.withColumn("_f", only_star(df, columns))
    out = {
        c: F.when(F.col(f"_f.{c}"), F.lit(0.0)).otherwise(
            F.coalesce(range_midpoint(F.col(c).cast("string")), F.col(c).cast("string").try_cast("double")))
        for c in columns
    }
    return marked.withColumns(out).drop("_f")


def ordinal_encode(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Position of each value among the sorted values of ``train``; unknown ones are -1."""
    for c in columns:
        values = train.select(F.col(c).cast("string").alias("_v")).filter("_v is not null").distinct()
        values = ordered_positions(values, ["_v"])
        lookup = values.select(F.col("_v").alias(f"_v_{c}"), (F.col("_rank") - 1).cast("int").alias(f"_c_{c}"))
        joined = df.join(lookup, F.col(c).cast("string") == F.col(f"_v_{c}"), "left")
        df = joined.withColumn(c, F.coalesce(f"_c_{c}", F.lit(-1))).drop(f"_v_{c}", f"_c_{c}")
    return df


def standard_scale(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation, both measured on ``train``."""
    figures = train.agg(F.struct(*[
        F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).alias("f")).scalar()
    marked = df.withColumn("_f", figures)
    scaled = {
        c: (F.col(c) - F.col(f"_f.{c}.m")) / F.when(F.col(f"_f.{c}.s") > 0, F.col(f"_f.{c}.s")).otherwise(F.lit(1.0))
        for c in columns
    }
    return marked.withColumns(scaled).drop("_f")


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """One 0/1 column per listed value."""
    return df.select(*df.columns, *[(F.col(column) == v).cast("int").alias(f"{column}_{v}") for v in values]).drop(column)


# ----------------------------------------------------------------- the classifiers

GBT, LOGISTIC, BAYES, FOREST = "gbt", "logistic", "bayes", "forest"


def classifier(kind: str, rounds: int = 10, seed: int = 7, bins: int = 64):
    """Gradient boosting is binary in Spark, so one model per class there."""
    args = {"featuresCol": "features", "labelCol": "_label"}
    if kind == GBT:
        return OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=3, seed=seed, maxBins=bins, **args), **args)
    if kind == LOGISTIC:
        return LogisticRegression(maxIter=rounds, **args)
    if kind == BAYES:
        return NaiveBayes(**args)
    if kind == FOREST:
        return RandomForestClassifier(numTrees=rounds, maxDepth=5, seed=seed, maxBins=bins, **args)
    raise ValueError(f"unknown classifier {kind}")


def pipeline(kind: str, target: str, cat: Sequence[str], num: Sequence[str], rounds: int = 10, bins: int = 64) -> Pipeline:
    """Index (or one-hot for linear models) categories, assemble, fit."""
    stages = [StringIndexer(inputCol=target, outputCol="_label", handleInvalid="keep", stringOrderType="alphabetAsc")]
    indexed = [f"{c}_ix" for c in cat]
    if cat:
        stages.append(StringIndexer(inputCols=list(cat), outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"))
    if kind in (LOGISTIC, BAYES) and cat:
        hot = [f"{c}_hot" for c in cat]
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=hot, handleInvalid="keep"))
        indexed = hot
    stages += [VectorAssembler(inputCols=[*indexed, *num], outputCol="features", handleInvalid="keep"), classifier(kind, rounds, bins=bins)]
    return Pipeline(stages=stages)


def fit_predict(train: DataFrame, test: DataFrame, target: str, cat: Sequence[str], num: Sequence[str] = (), kind: str = GBT, rounds: int = 10) -> tuple[DataFrame, PipelineModel]:
    """``test`` with the column ``predicted`` in words of the target."""
    train = train.filter(F.col(target).isNotNull())
    bins = 64
    if kind in (GBT, FOREST) and cat:
        # Trees need a bin for each category, and one for unseen values.
        distinct = train.agg(*[F.count_distinct(c).alias(c) for c in cat]).first()
        bins = max(bins, max(distinct) + 2)
    model = pipeline(kind, target, cat, num, rounds, bins).fit(train)
    labels = F.array(*[F.lit(x) for x in model.stages[0].labels])
    predicted = model.transform(test)
    return predicted.withColumn("predicted", F.get(labels, F.col("prediction").cast("int"))).select(*test.columns, "predicted"), model


def evaluate(train: DataFrame, test: DataFrame, target: str, cat: Sequence[str], num: Sequence[str] = (), kind: str = GBT, rounds: int = 10) -> DataFrame:
    predicted, _ = fit_predict(train, test, target, cat, num, kind, rounds)
    counted = predicted.groupBy(target, "predicted").agg(F.count("*").alias("c"))
    return classification_report(counted, [], target, "predicted", "c")


def classification_report(confusion: DataFrame, keys: Sequence[str], label: str, prediction: str, weight: str) -> DataFrame:
    """Precision, recall, f1 and support per label, macro and weighted mean, accuracy.

    ``confusion`` holds counts; where a figure divides by zero it is 0.
    """
    keys = list(keys)
    keyed = confusion if keys else confusion.withColumn("_all", F.lit(0))
    ks = keys or ["_all"]
    c, same = F.col(weight), F.col(label) == F.col(prediction)
    real = keyed.groupBy(*ks, F.col(label).alias("label")).agg(
        F.sum(c).alias("support"), F.sum(F.when(same, c).otherwise(0)).alias("hit"), F.lit(0).cast("bigint").alias("said"))
    told = keyed.groupBy(*ks, F.col(prediction).alias("label")).agg(
        F.lit(0).cast("bigint").alias("support"), F.lit(0).cast("bigint").alias("hit"), F.sum(c).alias("said"))
    sums = real.unionByName(told).groupBy(*ks, "label").agg(*[F.sum(x).alias(x) for x in ("support", "hit", "said")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    per = sums.withColumn("precision", ratio(F.col("hit"), F.col("said"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    both = F.col("precision") + F.col("recall")
    per = per.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))
    total = F.sum("support")
    named = ("precision", "recall", "f1")
    means = per.groupBy(*ks).agg(
        F.struct(*[F.avg(m).alias(m) for m in named]).alias("macro avg"),
        F.struct(*[(F.sum(F.col(m) * F.col("support")) / total).alias(m) for m in named]).alias("weighted avg"),
        F.struct(*[(F.sum("hit") / total).alias(m) for m in named]).alias("accuracy"),
        total.alias("support"),
    )
    rows = F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"`{n}`").alias("m")) for n in ("macro avg", "weighted avg", "accuracy")])
    overall = means.select(*ks, "support", F.explode(rows).alias("r")).select(
        *keys, "r.label", *[F.col(f"r.m.{m}").alias(m) for m in named], "support")
    return per.select(*keys, "label", *named, "support").unionByName(overall)


def bayes_grid(train: DataFrame, test: DataFrame, cells: Sequence[str], target: str, cat: Sequence[str], weight: str = "cnt", alpha: float = 1.0) -> DataFrame:
    """Confusion counts ``(cells, target, predicted, weight)`` of a categorical naive Bayes classifier for every cell at once.

    ``train`` and ``test`` hold merged rows with their count for each cell (say fold and k). A classifier is no more than
    its counts: those of target values, and of target values with each attribute's value; all cells get theirs from one
    aggregate, and each different test tuple is scored once. Shares are smoothed by ``alpha``; an attribute has as many
    values as in the cell's training rows, and one that was never met has the smoothed share of nothing. Equal scores go to
    the first target value; cells without training rows predict NULL.
    """
    cells, cat = list(cells), list(cat)
    w = F.col(weight)
    # NULL is a value like any other.
    shown = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    lines = F.explode(F.array(*[F.struct(F.lit(i).alias("_a"), shown(c).alias("_v")) for i, c in enumerate(cat)])).alias("_l")
    known = train.where(F.col(target).isNotNull())
    counts = materialize(
        known.select(*cells, F.col(target).alias("_t"), w, lines).groupBy(*cells, "_t", "_l._a", "_l._v").agg(F.sum(w).alias("_c")), "likelihoods")
    priors = counts.where("_a = 0").groupBy(*cells, "_t").agg(F.sum("_c").alias("_n"))
    totals = priors.groupBy(*cells).agg(F.sum("_n").alias("_all"))
    values = counts.groupBy(*cells, "_a").agg(F.count_distinct("_v").alias("_values"))
    tuples = materialize(test.groupBy(*cells, target, *cat).agg(F.sum(w).alias(weight)).withColumn("_id", F.monotonically_increasing_id()), "tuples")
    asked = null_safe(tuples.select(*cells, "_id", F.posexplode(F.array(*[shown(c) for c in cat])).alias("_a", "_v")), priors, cells)
    met = null_safe(null_safe(asked, values, [*cells, "_a"]), counts, [*cells, "_t", "_a", "_v"], "left")
    share = F.log((F.coalesce("_c", F.lit(0)) + alpha) / (F.col("_n") + alpha * F.col("_values")))
    scored = null_safe(met.groupBy(*cells, "_id", "_t").agg(F.sum(share).alias("_s"), F.first("_n").alias("_n")), totals, cells)
    best = scored.groupBy("_id").agg(F.min_by("_t", F.struct(F.round(-(F.col("_s") + F.log(F.col("_n") / F.col("_all"))), 9), F.col("_t"))).alias("predicted"))
    return tuples.join(best, "_id", "left").groupBy(*cells, target, "predicted").agg(F.sum(w).alias(weight))


def majority(df: DataFrame, target: str) -> DataFrame:
    """The commonest target value, which a dummy classifier always predicts."""
    counts = df.groupBy(target).agg(F.count("*").alias("n"))
    return counts.agg(F.min_by(target, F.struct(-F.col("n"), F.col(target))).alias("prediction"), (F.max("n") / F.sum("n")).alias("accuracy"))


def eliminate_features(train: DataFrame, test: DataFrame, target: str, cat: Sequence[str], num: Sequence[str], keep: int, rounds: int = 10) -> DataFrame:
    """Drop the least important feature of a forest again and again.

    One line per round: the features used, the test accuracy and what was dropped.
    """
    lines, cat, num = [], list(cat), list(num)
    while True:
        predicted, model = fit_predict(train, test, target, cat, num, FOREST, rounds)
        accuracy = predicted.agg(F.avg((F.col(target).eqNullSafe(F.col("predicted"))).cast("double"))).first()[0]
        features = [*cat, *num]
        if len(features) <= keep:
            lines.append((len(features), ",".join(features), float(accuracy), None))
            break
        weights = model.stages[-1].featureImportances
        worst = min(range(len(features)), key=lambda i: (weights[i], features[i]))
        lines.append((len(features), ",".join(features), float(accuracy), features[worst]))
        cat = [c for c in cat if c != features[worst]]
        num = [c for c in num if c != features[worst]]
    return train.sparkSession.createDataFrame(lines, "n_features int, features string, accuracy double, dropped string")


def save_experiment(model: PipelineModel, report: DataFrame, path: str) -> None:
    """The fitted pipeline and its report, side by side."""
    model.write().overwrite().save(f"{path}/model")
    report.write.mode("overwrite").json(f"{path}/classification_report")


def load_experiment(path: str, report_schema: str) -> tuple[PipelineModel, DataFrame]:
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    return PipelineModel.load(f"{path}/model"), spark.read.schema(report_schema).json(f"{path}/classification_report")


__all__ = [
    "bayes_grid", "classification_report", "eliminate_features", "evaluate", "fit_predict", "majority", "one_hot",
    "ordinal_encode", "ranges_to_midpoints", "standard_scale", "starred_to_number",
]
