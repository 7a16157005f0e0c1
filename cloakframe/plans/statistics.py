"""Equivalence classes, descriptive statistics and statistics over grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe.operators import anonymize as A
from cloakframe.operators import classes as C
from cloakframe.operators import describe as D
from cloakframe.operators import hierarchies as H
from cloakframe.operators import ml as M
from cloakframe.operators import risk as R
from cloakframe.operators import sampling as S
from cloakframe.operators import stats as T
from cloakframe.operators.ranking import null_safe
from cloakframe.plans.grids import BS, CELL, GRID, KS, SAMPLES, run_counts, sample_grid, sample_sizes
from cloakframe.plans.registry import register
from cloakframe.plans.tables import (
    FOLDS, GEN, ID, PEOPLE, PUB, QID, QKEY, SAMPLE, SEED, TARGET,
    definition, generalized, people, published, table,
)
from cloakframe.session import materialize

STAR_ROW = "n_name = '*' AND c_mktsegment = '*' AND o_orderdate = '*'"


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---------------------------------------------------------- equivalence classes


@register("generalize_node", f"WITH {PEOPLE} SELECT o_orderkey, r_name AS n_name, c_mktsegment, quarter(o_orderdate) || '/' || year(o_orderdate) AS o_orderdate FROM people")
def generalize_node(spark, sf):
    node = {"n_name": 1, "c_mktsegment": 0, "o_orderdate": 2}
    return H.generalize(people(spark, sf), definition(spark, sf), node).select("o_orderkey", *QID)


@register("eq_classes", f"WITH {GEN} SELECT {QKEY}, count(*) AS n FROM gen GROUP BY ALL")
def eq_classes(spark, sf):
    return C.class_sizes(generalized(spark, sf), QID)


@register("target_counts", f"WITH {PEOPLE} SELECT price_bin, count(*) AS n FROM people GROUP BY ALL")
def target_counts(spark, sf):
    return C.class_sizes(people(spark, sf), [TARGET])


@register("eq_target_counts", f"WITH {GEN} SELECT {QKEY}, price_bin, count(*) AS n FROM gen GROUP BY ALL")
def eq_target_counts(spark, sf):
    return C.class_target_counts(generalized(spark, sf), QID, TARGET)


@register("eq_summary", f"""WITH {PUB}, c AS (SELECT {QKEY}, count(*) AS n, {STAR_ROW} AS st FROM pub GROUP BY ALL)
  SELECT count(*) FILTER (NOT st) AS classes, round(avg(n) FILTER (NOT st), 6) AS avg_size, min(n) FILTER (NOT st) AS min_size, max(n) FILTER (NOT st) AS max_size,
    CAST(coalesce(sum(n) FILTER (st), 0) AS BIGINT) AS suppressed, CAST(sum(n) FILTER (NOT st) AS BIGINT) AS sample_size, CAST(sum(n) AS BIGINT) AS input_size FROM c""")
def eq_summary(spark, sf):
    return rounded(C.class_summary(published(spark, sf), QID), ["avg_size"])


@register("eq_histogram", f"WITH {GEN} SELECT n, count(*) AS classes FROM (SELECT count(*) AS n FROM gen GROUP BY {QKEY}) GROUP BY n")
def eq_histogram(spark, sf):
    return C.size_histogram(generalized(spark, sf), QID)


PAIRED = f"{SAMPLE}, a AS (SELECT {QKEY}, count(*) AS n FROM pub GROUP BY ALL), b AS (SELECT {QKEY}, count(*) AS m FROM samp GROUP BY ALL)"


def pair(spark, sf):
    output = published(spark, sf)
    return output, S.stratified_sample(output, QID, 0.2, ID, SEED)


@register("eq_histogram_common", f"WITH {PAIRED} SELECT n, count(*) AS classes, count(m) AS surviving FROM a LEFT JOIN b USING ({QKEY}) GROUP BY n")
def eq_histogram_common(spark, sf):
    output, drawn = pair(spark, sf)
    return C.surviving_histogram(output, drawn, QID)


@register("eq_ratio", f"WITH {PAIRED} SELECT {QKEY}, m AS n_sample, n AS n_population, round(coalesce(CAST(m AS DOUBLE) / n, 0), 9) AS ratio FROM a FULL JOIN b USING ({QKEY})")
def eq_ratio(spark, sf):
    output, drawn = pair(spark, sf)
    return rounded(C.class_ratio(drawn, output, QID), ["ratio"], 9)


@register("eq_common", f"WITH {PAIRED} SELECT {QKEY}, n AS n_population, m AS n_sample FROM a JOIN b USING ({QKEY})")
def eq_common(spark, sf):
    output, drawn = pair(spark, sf)
    return C.common_classes(output, drawn, QID)


@register("row_eq_size", f"WITH {GEN} SELECT o_orderkey, count(*) OVER (PARTITION BY {QKEY}) AS class_size FROM gen")
def row_eq_size(spark, sf):
    return C.with_class_size(generalized(spark, sf), QID).select("o_orderkey", "class_size")


# --------------------------------------------------------------------- describe


@register("value_distribution", f"WITH {PEOPLE} SELECT price_bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM people GROUP BY price_bin")
def value_distribution(spark, sf):
    return rounded(D.value_distribution(people(spark, sf), TARGET), ["share"], 9)


@register("frequency", f"WITH {PUB} SELECT n_name, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM pub GROUP BY n_name")
def frequency(spark, sf):
    return rounded(D.value_distribution(published(spark, sf), "n_name"), ["share"], 9)


@register("contingency", f"WITH {PUB} SELECT n_name, c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM pub GROUP BY n_name, c_mktsegment")
def contingency(spark, sf):
    return rounded(D.contingency(published(spark, sf), "n_name", "c_mktsegment"), ["share"], 9)


def _summary_sql(c: str, source: str) -> str:
    return f"""SELECT '{c}' AS "column", count(x) AS n, count(*) FILTER (x IS NULL) AS nulls, min(x) AS min, max(x) AS max, round(max(x) - min(x), 6) AS range, round(avg(x), 6) AS mean,
    round(exp(avg(ln(x)) FILTER (x > 0)), 6) AS geometric_mean, round(var_samp(x), 4) AS sample_variance, round(var_pop(x), 4) AS population_variance, round(stddev_samp(x), 6) AS std,
    round(kurtosis_pop(x), 6) AS kurtosis, round(quantile_cont(x, 0.5), 6) AS median, (SELECT x FROM (SELECT CAST({c} AS DOUBLE) AS x, count(*) AS k FROM {source} WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY k DESC, x LIMIT 1) AS mode
    FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {source})"""


@register("summary_stats", _summary_sql("o_totalprice", "orders") + " UNION ALL " + _summary_sql("o_custkey", "orders").replace("> 0", "> 0"))
def summary_stats(spark, sf):
    out = D.summary_statistics(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"])
    out = rounded(out, ["range", "mean", "geometric_mean", "std", "kurtosis", "median"])
    return rounded(out, ["sample_variance", "population_variance"], 4)


@register("describe", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q1, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q3 FROM lineitem""" for c in ("l_quantity", "l_extendedprice", "l_linenumber")))
def describe(spark, sf):
    out = D.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_linenumber"])
    return rounded(out, ["mean", "std", "q1", "median", "q3"])


_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register("corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in _NUM for b in _NUM))
def corr_matrix(spark, sf):
    return rounded(D.correlation(table(spark, sf, "lineitem"), _NUM), ["r"])


@register("trend", "SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS period, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def trend(spark, sf):
    out = D.trend(table(spark, sf, "events"), "ts", "value", "day", ["event_type"])
    return rounded(out, ["mean"]).withColumn("period", F.date_format("period", "yyyy-MM-dd"))


_SET = "(SELECT DISTINCT r_name, {e} AS v FROM people)"


@register("agg_set", f"WITH {PEOPLE} SELECT r_name, '{{' || string_agg(v, ', ' ORDER BY v) || '}}' AS value FROM (SELECT DISTINCT r_name, n_name AS v FROM people) GROUP BY r_name")
def agg_set(spark, sf):
    return D.aggregate_values(people(spark, sf), ["r_name"], "n_name", "set")


@register("agg_prefix_set", f"WITH {PEOPLE} SELECT r_name, '{{' || string_agg(v, ', ' ORDER BY v) || '}}' AS value FROM (SELECT DISTINCT r_name, substr(n_name, 1, 8) AS v FROM people) GROUP BY r_name")
def agg_prefix_set(spark, sf):
    return D.aggregate_values(people(spark, sf), ["r_name"], "n_name", "prefix_set", 8)


def _prefix_sql(value: str) -> str:
    return f"""WITH {PEOPLE}, e AS (SELECT n_name, c_mktsegment, min(c_name) AS lo, max(c_name) AS hi, max(length(c_name)) AS len FROM people GROUP BY ALL)
  SELECT n_name, c_mktsegment, {value} AS value FROM (SELECT *, coalesce((SELECT max(i) FROM range(1, 40) t(i) WHERE i <= least(length(lo), length(hi)) AND substr(lo, 1, i) = substr(hi, 1, i)), 0) AS p FROM e)"""


@register("agg_common_prefix", _prefix_sql("substr(lo, 1, p)"))
def agg_common_prefix(spark, sf):
    return D.aggregate_values(people(spark, sf), ["n_name", "c_mktsegment"], "c_name", "common_prefix")


@register("agg_common_prefix_redacted", _prefix_sql("rpad(substr(lo, 1, p), len::INTEGER, '*')"))
def agg_common_prefix_redacted(spark, sf):
    return D.aggregate_values(people(spark, sf), ["n_name", "c_mktsegment"], "c_name", "common_prefix_redacted")


@register("agg_bounds", f"WITH {PEOPLE} SELECT n_name, '[' || min(o_orderkey) || ', ' || max(o_orderkey) || ']' AS value FROM people GROUP BY n_name")
def agg_bounds(spark, sf):
    return D.aggregate_values(people(spark, sf), ["n_name"], "o_orderkey", "bounds")


@register("agg_interval", f"WITH {PEOPLE} SELECT n_name, '[' || min(o_orderdate) || ', ' || max(o_orderdate) || '[' AS value FROM people GROUP BY n_name")
def agg_interval(spark, sf):
    return D.aggregate_values(people(spark, sf), ["n_name"], "o_orderdate", "interval")


# ------------------------------------------------------------------------ grids

SHOWN = SAMPLES + f", shown AS (SELECT * FROM samples WHERE NOT ({STAR_ROW})), tc AS (SELECT fold, k, b, price_bin, count(*) AS n FROM shown GROUP BY ALL), frame AS (SELECT DISTINCT k, b, CAST(f AS INTEGER) AS fold, price_bin FROM (SELECT DISTINCT k, b FROM samples), range(10) r(f), (SELECT DISTINCT price_bin FROM people))"
KB = ["k", "b"]


def grid_parts(spark, sf):
    """Counts ``(fold, k, b, qid, target, n)`` of the samples, and the frame of all cells x folds x target values."""
    grid = sample_grid(spark, sf)
    drawn = materialize(grid.counts(), "samples")
    return drawn, T.fold_grid(drawn, KB, grid.values, FOLDS)


@register("target_count_stats", f"""WITH {SHOWN} SELECT k, b, price_bin, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(coalesce(n, 0)) AS min, max(coalesce(n, 0)) AS max,
    '[' || min(coalesce(n, 0)) || ', ' || max(coalesce(n, 0)) || ']' AS range, CASE WHEN avg(n) IS NULL THEN 'nan' ELSE printf('%.1f', round_even(avg(n), 1)) END || ' ± ' || CASE WHEN stddev_samp(n) IS NULL THEN 'nan' ELSE printf('%.1f', round_even(stddev_samp(n), 1)) END AS text
  FROM frame LEFT JOIN tc USING (fold, k, b, price_bin) GROUP BY k, b, price_bin""")
def target_count_stats(spark, sf):
    drawn, frame = grid_parts(spark, sf)
    counts = C.class_sizes(C.drop_suppressed(drawn, QID), [*KB, "fold", TARGET], weight="n")
    return rounded(T.target_count_stats(counts, frame, KB, TARGET), ["mean", "std"])


@register("missing_targets", f"WITH {SHOWN} SELECT k, b, fold, price_bin FROM frame ANTI JOIN (SELECT * FROM tc WHERE n >= 60) USING (fold, k, b, price_bin)")
def missing_targets(spark, sf):
    """Target values with fewer than 60 rows count as missing here, so that some are."""
    drawn, frame = grid_parts(spark, sf)
    counts = C.class_sizes(C.drop_suppressed(drawn, QID), [*KB, "fold", TARGET], weight="n").filter("n >= 60")
    return T.missing_targets(counts, frame, KB, TARGET)


@register("eq_per_target", f"""WITH {SHOWN}, ec AS (SELECT fold, k, b, price_bin, count(*) AS n FROM (SELECT DISTINCT fold, k, b, price_bin, {QKEY} FROM shown) GROUP BY ALL)
  SELECT k, b, price_bin, round(avg(coalesce(n, 0)), 6) AS mean, round(stddev_samp(coalesce(n, 0)), 6) AS std, min(coalesce(n, 0)) AS min, max(coalesce(n, 0)) AS max FROM frame LEFT JOIN ec USING (fold, k, b, price_bin) GROUP BY k, b, price_bin""")
def eq_per_target(spark, sf):
    drawn, frame = grid_parts(spark, sf)
    out = T.classes_per_target(C.drop_suppressed(drawn, QID), frame, KB, QID, TARGET)
    return rounded(out, ["mean", "std"])


@register("eq_survivor_stats", f"""WITH {SAMPLES}, p AS (SELECT fold, k, {QKEY}, count(*) AS n FROM pops GROUP BY ALL), s AS (SELECT fold, k, b, {QKEY}, count(*) AS m FROM samples GROUP BY ALL),
  f AS (SELECT k, b, fold, avg(n) AS p, avg(m) AS s FROM p JOIN s USING (fold, k, {QKEY}) GROUP BY ALL)
  SELECT k, b, round(avg(p), 6) AS mean_population, round(stddev_pop(p), 6) AS std_population, round(avg(s), 6) AS mean_sample, round(stddev_pop(s), 6) AS std_sample FROM f GROUP BY k, b""")
def eq_survivor_stats(spark, sf):
    """On class sizes alone: which rows are drawn does not matter."""
    classes = materialize(run_counts(spark, sf).withColumnRenamed("cnt", "n"), "classes")
    common = materialize(sample_sizes(classes).filter("s > 0"), "common").withColumnsRenamed({"n": "n_population", "s": "n_sample"})
    out = T.survivor_stats(common, common.select(*KB, "fold"), KB)
    return rounded(out, [c for c in out.columns if c not in KB])


METRICS = SAMPLES + f""", bpairs AS (SELECT fold, k, price_bin, {QKEY}, count(*) AS n FROM pops GROUP BY ALL), p AS (SELECT fold, k, {QKEY}, count(*) AS n FROM pops GROUP BY ALL),
  bj AS (SELECT fold, k, price_bin, row_number() OVER (PARTITION BY fold, k, price_bin ORDER BY o_orderkey) AS j FROM pops),
  amount AS (SELECT fold, k, b, price_bin, count(*) AS amount FROM (SELECT fold, k, price_bin, b FROM bj JOIN cellsize USING (fold, k)
    QUALIFY row_number() OVER (PARTITION BY fold, k, b ORDER BY j, md5(concat_ws('|', '7', fold, k, CAST(b AS VARCHAR), price_bin)), price_bin) <= m) GROUP BY ALL),
  bs AS (SELECT fold, k, b, price_bin, {QKEY}, count(*) AS s FROM (SELECT fold, k, b, price_bin, {QKEY} FROM bpairs JOIN amount USING (fold, k, price_bin), (SELECT unnest(range(1, 1 + (SELECT max(n) FROM bpairs))) AS j) x WHERE j <= n
    QUALIFY row_number() OVER (PARTITION BY fold, k, b, price_bin ORDER BY CAST(j AS DOUBLE) / n, md5(concat_ws('|', '7', fold, k, CAST(b AS VARCHAR), price_bin, {QKEY})), {QKEY}) <= amount) GROUP BY ALL),
  both_ AS (SELECT 'SSAMPLE' AS strat, fold, k, b, {QKEY}, count(*) AS s FROM samples GROUP BY ALL UNION ALL SELECT 'BSAMPLE', fold, k, b, {QKEY}, CAST(sum(s) AS BIGINT) FROM bs GROUP BY ALL),
  metric AS (SELECT strat, fold, k, b, {QKEY}, s, CAST(s AS DOUBLE) / n AS certainty, CASE WHEN {STAR_ROW} THEN 0e0 ELSE 1e0 / n END AS journalist_risk FROM both_ JOIN p USING (fold, k, {QKEY}))"""


def metric_classes(spark, sf):
    """Certainty and risk per class for both strategies over all cells, on class tables only.

    Which rows are drawn does not matter to either figure, so no row is sampled.
    """
    pairs = materialize(run_counts(spark, sf, carry=[TARGET]).withColumnRenamed("cnt", "n"), "pairs")
    classes = pairs.groupBy(*CELL, *QID).agg(F.sum("n").alias("n"))
    rates = F.array(*[F.lit(b) for b in BS])
    totals = pairs.groupBy(*CELL).agg(F.sum("n").alias("_t")).withColumn("b", F.explode(rates))
    quotas = totals.select(*CELL, "b", S.sample_amount(F.col("_t"), F.col("b")).alias("quota"))
    cells = [*CELL, "b"]
    plain = S.stratified_sizes(classes.withColumn("b", F.explode(rates)), cells, QID, quotas, SEED)
    even = S.balanced_sizes(pairs.withColumn("b", F.explode(rates)), cells, QID, TARGET, quotas, SEED)
    drawn = plain.select(F.lit("SSAMPLE").alias("strat"), *cells, *QID, "s").unionByName(
        even.groupBy(*cells, *QID).agg(F.sum("s").alias("s")).select(F.lit("BSAMPLE").alias("strat"), *cells, *QID, "s"))
    return R.certainty_grid(drawn.filter("s > 0"), classes, ["strat", *cells], CELL, QID)


@register("privacy_metrics_grid", f"""WITH {METRICS} SELECT strat, fold, k, b, CAST(sum(s) AS BIGINT) AS n_rows, round(max(certainty), 9) AS max_certainty, round(sum(s * certainty) / sum(s), 9) AS mean_certainty,
  round(max(journalist_risk), 9) AS max_risk, round(sum(s * journalist_risk) / sum(s), 9) AS mean_risk FROM metric GROUP BY strat, fold, k, b""")
def privacy_metrics_grid(spark, sf):
    weighted = lambda c: F.round(F.sum(F.col("s") * F.col(c)) / F.sum("s"), 9)
    return metric_classes(spark, sf).groupBy("strat", "fold", "k", "b").agg(
        F.sum("s").alias("n_rows"), F.round(F.max("certainty"), 9).alias("max_certainty"), weighted("certainty").alias("mean_certainty"),
        F.round(F.max("journalist_risk"), 9).alias("max_risk"), weighted("journalist_risk").alias("mean_risk"))


@register("max_certainty", f"WITH {METRICS} SELECT round(certainty, 9) AS certainty, strat, k, b, fold FROM metric ORDER BY metric.certainty DESC, strat, k, b, fold LIMIT 1")
def max_certainty(spark, sf):
    return rounded(T.biggest(metric_classes(spark, sf), F.col("certainty"), ["strat", "k", "b", "fold"], "certainty"), ["certainty"], 9)


@register("max_certainty_excess", f"WITH {METRICS} SELECT round((certainty - b) / b, 9) AS excess, strat, k, b, fold FROM metric WHERE certainty > b ORDER BY (certainty - b) / b DESC, strat, k, b, fold LIMIT 1")
def max_certainty_excess(spark, sf):
    excess = (F.col("certainty") - F.col("b")) / F.col("b")
    return rounded(T.biggest(metric_classes(spark, sf), excess, ["strat", "k", "b", "fold"], "excess"), ["excess"], 9)


@register("metric_quantiles", f"""WITH {METRICS}, x AS (SELECT strat, b, certainty, unnest(range(s)) FROM metric)
  SELECT strat, b, unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS prob, round(unnest(quantile_cont(certainty, [0.0, 0.25, 0.5, 0.75, 1.0])), 9) AS value FROM x GROUP BY strat, b""")
def metric_quantiles(spark, sf):
    figures = materialize(metric_classes(spark, sf), "figures")
    out = A.group_quantiles(figures, ["strat", "b"], "certainty", [0.0, 0.25, 0.5, 0.75, 1.0], "s")
    return rounded(out, ["value"], 9)


# ---------------------------------------------------- reports of a class majority

RULE = GRID + f""", test AS (SELECT own AS fold, o_orderkey, {QKEY}, price_bin FROM gen JOIN folds USING (o_orderkey)),
  votes AS (SELECT fold, {QKEY}, price_bin, count(*) AS v FROM train GROUP BY ALL),
  big AS (SELECT fold, {QKEY}, price_bin AS said, CAST(sum(v) OVER (PARTITION BY fold, {QKEY}) AS BIGINT) AS n FROM votes QUALIFY row_number() OVER (PARTITION BY fold, {QKEY} ORDER BY v DESC, price_bin) = 1),
  top AS (SELECT fold, price_bin AS usual FROM (SELECT fold, price_bin, sum(v) AS v FROM votes GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY fold ORDER BY v DESC, price_bin) = 1),
  pred AS (SELECT fold, CAST(k AS INTEGER) AS k, price_bin AS label, CASE WHEN n >= k THEN said ELSE usual END AS prediction FROM test LEFT JOIN big USING (fold, {QKEY}) JOIN top USING (fold), (VALUES (5), (20)) v(k)),
  conf AS (SELECT fold, k, label, prediction, count(*) AS n FROM pred GROUP BY ALL),
  labs AS (SELECT DISTINCT fold, k, label FROM conf UNION SELECT DISTINCT fold, k, prediction FROM conf),
  per AS (SELECT fold, k, label, CAST(coalesce(hit, 0) AS DOUBLE) AS hit, coalesce(sup, 0) AS support, coalesce(said, 0) AS said FROM labs
    LEFT JOIN (SELECT fold, k, label, sum(n) AS sup, sum(n) FILTER (label = prediction) AS hit FROM conf GROUP BY ALL) USING (fold, k, label)
    LEFT JOIN (SELECT fold, k, prediction AS label, sum(n) AS said FROM conf GROUP BY ALL) USING (fold, k, label)),
  pr AS (SELECT *, CASE WHEN said = 0 THEN 0 ELSE hit / said END AS p, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS r FROM per),
  prf AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM pr),
  report AS (SELECT fold, k, label, p AS precision, r AS recall, f AS f1, CAST(support AS BIGINT) AS support FROM prf
    UNION ALL SELECT fold, k, 'macro avg', avg(p), avg(r), avg(f), CAST(sum(support) AS BIGINT) FROM prf GROUP BY fold, k
    UNION ALL SELECT fold, k, 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), CAST(sum(support) AS BIGINT) FROM prf GROUP BY fold, k
    UNION ALL SELECT fold, k, 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), CAST(sum(support) AS BIGINT) FROM prf GROUP BY fold, k)"""


def rule_report(spark, sf):
    """Report per (fold, k) of predicting each class's commonest target value.

    Training counts are whole-table counts less those of the test fold; classes below
    k are suppressed and fall back to the overall commonest value.
    """
    rows = S.k_fold(generalized(spark, sf).select("o_orderkey", *QID, TARGET), FOLDS, ID, SEED)
    counts = materialize(rows.groupBy(*QID, TARGET, "fold").agg(F.count("*").alias("cnt")), "votes")
    votes = A.train_counts(counts, [*QID, TARGET], FOLDS)
    first = lambda name: F.min_by(TARGET, F.struct(-F.col("cnt"), F.col(TARGET))).alias(name)
    said = votes.groupBy("fold", *QID).agg(first("said"), F.sum("cnt").alias("n"))
    usual = votes.groupBy("fold", TARGET).agg(F.sum("cnt").alias("cnt")).groupBy("fold").agg(first("usual"))
    joined = null_safe(null_safe(counts, said.select("fold", *QID, "said", "n"), ["fold", *QID], "left"), usual, ["fold"])
    known = joined.withColumn("k", F.explode(F.array(*[F.lit(k) for k in KS])))
    guess = F.when(F.col("n") >= F.col("k"), F.col("said")).otherwise(F.col("usual"))
    confusion = known.select("fold", "k", F.col(TARGET).alias("label"), guess.alias("prediction"), "cnt")
    return M.classification_report(confusion, ["fold", "k"], "label", "prediction", "cnt")


@register("classification_report", f"WITH {RULE} SELECT fold, k, label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM report")
def classification_report(spark, sf):
    return rounded(rule_report(spark, sf), ["precision", "recall", "f1"], 9)


FMS = ", ".join(f"round(avg({m}), 6) AS mean_{m}, round(stddev_samp({m}), 6) AS std_{m}, round(min({m}), 6) AS min_{m}, round(max({m}), 6) AS max_{m}" for m in T.MEASURES)


@register("fold_mean_std", f"""WITH {RULE}, good AS (SELECT * FROM report WHERE precision > 0.2), fr AS (SELECT DISTINCT k, label, CAST(f AS INTEGER) AS fold FROM good, range(10) r(f))
  SELECT k, label, {', '.join(f"round(avg(coalesce({m}, 0)), 6) AS mean_{m}, round(stddev_samp(coalesce({m}, 0)), 6) AS std_{m}, round(min(coalesce({m}, 0)), 6) AS min_{m}, round(max(coalesce({m}, 0)), 6) AS max_{m}" for m in T.MEASURES)}
  FROM fr LEFT JOIN good USING (k, label, fold) GROUP BY k, label""")
def fold_mean_std(spark, sf):
    """Folds in which a label reached no precision worth reporting count as 0."""
    report = materialize(rule_report(spark, sf), "report").filter("precision > 0.2")
    out = T.fold_mean_std(report, report, ["k"], FOLDS)
    return rounded(out, [c for c in out.columns if c not in ("k", "label")])


@register("report_flatten", f"""WITH {RULE} SELECT fold, k, label, m AS metric, round(v, 9) AS value FROM (
  SELECT fold, k, label, 'precision' AS m, precision AS v FROM report UNION ALL SELECT fold, k, label, 'recall', recall FROM report UNION ALL SELECT fold, k, label, 'f1', f1 FROM report)""")
def report_flatten(spark, sf):
    """Reports as nested JSON texts, one per cell, flattened again."""
    lines = rule_report(spark, sf).groupBy("fold", "k").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("label", F.create_map(
            F.lit("precision"), F.col("precision"), F.lit("recall"), F.col("recall"), F.lit("f1"), F.col("f1")))))).alias("json"))
    return rounded(T.flatten_report(lines, ["fold", "k"]), ["value"], 9)


@register("grid_diff", f"""WITH {RULE}, m AS (SELECT k, label, avg(f1) AS f FROM report GROUP BY ALL)
  SELECT a.label, round(a.f, 9) AS value_a, round(b.f, 9) AS value_b, round(a.f - b.f, 9) AS diff FROM (SELECT * FROM m WHERE k = 5) a JOIN (SELECT * FROM m WHERE k = 20) b ON a.label = b.label""")
def grid_diff(spark, sf):
    means = rule_report(spark, sf).groupBy("k", "label").agg(F.avg("f1").alias("value"))
    means = materialize(means, "means")
    out = T.grid_difference(means.filter("k = 5"), means.filter("k = 20"), ["label"])
    return rounded(out, ["value_a", "value_b", "diff"], 9)


@register("figure_series", f"""WITH {RULE}, m AS (SELECT k, label, avg(f1) AS mean, avg(f1) - min(f1) AS below, max(f1) - avg(f1) AS above FROM report GROUP BY k, label)
  SELECT m.k, CAST(CASE WHEN m.k = 5 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS b, m.label, round(mean, 6) AS mean, round(below, 6) AS below, round(above, 6) AS above, round(base, 6) AS baseline
  FROM m JOIN (SELECT label, avg(f1) AS base FROM report WHERE k = 5 GROUP BY label) z USING (label)""")
def figure_series(spark, sf):
    """Bars of a sampled grid (here k=20 as b=1/2), the un-sampled one and a baseline."""
    report = materialize(rule_report(spark, sf), "report")
    table_ = materialize(T.fold_mean_std(report, report, ["k"], FOLDS, ["f1"]), "bars")
    plain = table_.filter("k = 5")
    out = T.figure_series(table_.filter("k = 20").withColumn("b", F.lit(0.5)), plain, plain, ["k", "b", "label"], "f1")
    return rounded(out, ["mean", "below", "above", "baseline"])


