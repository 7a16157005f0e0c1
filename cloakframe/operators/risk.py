"""Re-identification risk of tables and samples."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.definition import STAR
from cloakframe.operators.classes import class_ratio, class_sizes, is_suppressed, size_histogram
from cloakframe.operators.ranking import null_safe


def certainty(sample: DataFrame, population: DataFrame, qid: Sequence[str]) -> DataFrame:
    """Per sample row: share of its population class that was sampled."""
    ratio = class_ratio(sample, population, qid).select(*qid, F.col("ratio").alias("certainty"))
    return null_safe(sample, ratio, qid, "left")


def journalist_risk(sample: DataFrame, population: DataFrame, qid: Sequence[str]) -> DataFrame:
    """Per sample row: one over its population class; 0 if suppressed or unmatched."""
    sizes = class_sizes(population, qid, "_n")
    joined = null_safe(sample, sizes, qid, "left")
    risk = F.when(is_suppressed(qid), F.lit(0.0)).otherwise(F.coalesce(1.0 / F.col("_n"), F.lit(0.0)))
    return joined.withColumn("journalist_risk", risk).drop("_n")


def certainty_grid(sample_classes: DataFrame, population_classes: DataFrame, cells: Sequence[str], shared: Sequence[str], qid: Sequence[str]) -> DataFrame:
    """Certainty and journalist risk of every class of every experiment cell.

    ``sample_classes``: cells, qid, ``s``; ``population_classes``: shared cells, qid,
    ``n``. All rows of a class share both figures, so ``s`` is their weight.
    """
    joined = null_safe(sample_classes, population_classes, [*shared, *qid], "left")
    return joined.select(
        *cells, *qid, "s",
        F.coalesce(F.col("s") / F.col("n"), F.lit(0.0)).alias("certainty"),
        F.when(is_suppressed(qid), F.lit(0.0)).otherwise(F.coalesce(1.0 / F.col("n"), F.lit(0.0))).alias("journalist_risk"),
    )


def _threshold_summary(sizes: DataFrame, threshold: float) -> DataFrame:
    """From ``rows`` per class and the ``n`` the attacker sees."""
    rows, n = F.col("rows"), F.col("n")
    return sizes.agg(
        (F.coalesce(F.sum(F.when(1.0 / n > threshold, rows)), F.lit(0)) / F.sum(rows)).alias("records_at_risk"),
        F.max(1.0 / n).alias("highest_risk"),
        (F.sum(rows / n) / F.sum(rows)).alias("success_rate"),
    )


def prosecutor_risk(df: DataFrame, qid: Sequence[str], threshold: float) -> DataFrame:
    """The attacker knows the target is in the table."""
    return _threshold_summary(class_sizes(df, qid).withColumn("rows", F.col("n")), threshold)


def journalist_summary(sample: DataFrame, population: DataFrame, qid: Sequence[str], threshold: float) -> DataFrame:
    """The attacker only knows the population the table was drawn from."""
    sizes = null_safe(class_sizes(sample, qid, "rows"), class_sizes(population, qid), qid)
    return _threshold_summary(sizes, threshold)


def marketer_risk(sample: DataFrame, population: DataFrame, qid: Sequence[str]) -> DataFrame:
    sizes = null_safe(class_sizes(sample, qid, "rows"), class_sizes(population, qid), qid)
    return sizes.agg((F.sum(F.col("rows") / F.col("n")) / F.sum("rows")).alias("success_rate"))


def estimated_risk(df: DataFrame, qid: Sequence[str], threshold: float, fraction: float) -> DataFrame:
    """All three attackers with population classes estimated as size / fraction."""
    sizes = class_sizes(df, qid).withColumn("rows", F.col("n"))
    label = lambda d, a: d.select(F.lit(a).alias("attacker"), *[F.col(c) for c in d.columns])
    known = _threshold_summary(sizes, threshold)
    guessed = _threshold_summary(sizes.withColumn("n", F.col("n") / F.lit(fraction)), threshold)
    marketer = guessed.select(
        F.lit(None).cast("double").alias("records_at_risk"), F.lit(None).cast("double").alias("highest_risk"), "success_rate")
    return label(known, "prosecutor").unionByName(label(guessed, "journalist")).unionByName(label(marketer, "marketer"))


def sample_risk(df: DataFrame, qid: Sequence[str]) -> DataFrame:
    """Average, lowest and highest risk with the share of rows that bear them."""
    h = size_histogram(df, qid).select("n", "classes", (F.col("n") * F.col("classes")).alias("rows"))
    ends = h.agg(F.struct(F.min("n").alias("lo"), F.max("n").alias("hi")).alias("e")).scalar()
    total = F.sum("rows")
    at = lambda size: F.sum(F.when(F.col("n") == size, F.col("rows")).otherwise(0)) / total
    h = h.withColumn("_e", ends)
    return h.agg(
        (F.sum("classes") / total).alias("average_risk"),
        (1.0 / F.max("n")).alias("lowest_risk"),
        (1.0 / F.min("n")).alias("highest_risk"),
        at(F.col("_e.hi")).alias("rows_at_lowest"),
        at(F.col("_e.lo")).alias("rows_at_highest"),
        at(F.lit(1)).alias("sample_uniqueness"),
    )


def risk_distribution(df: DataFrame, qid: Sequence[str]) -> DataFrame:
    """Share of rows with exactly and with at most each risk.

    The window runs over distinct class sizes: never more than sqrt(2N) lines.
    """
    h = size_histogram(df, qid).select((1.0 / F.col("n")).alias("risk"), "n", (F.col("n") * F.col("classes")).alias("rows"))
    all_rows = F.sum("rows").over(Window.partitionBy(F.lit(0)))
    upto = F.sum("rows").over(Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return h.select("n", "risk", (F.col("rows") / all_rows).alias("fraction"), (upto / all_rows).alias("cumulative"))


def attribute_risk(df: DataFrame, qid: Sequence[str]) -> DataFrame:
    """Distinction and separation of every subset of the quasi-identifiers.

    The cube is taken over distinct tuples with counts, not over rows, and also
    gives the number and average size of classes of each subset.
    """
    base = df.groupBy(*qid).agg(F.count("*").alias("cnt"))
    cubed = base.cube(*qid).agg(F.sum("cnt").alias("n"), F.grouping_id().alias("gid"))
    sums = cubed.filter(F.col("gid") < 2 ** len(qid) - 1).groupBy("gid").agg(
        F.count("*").alias("classes"), F.sum("n").alias("rows"),
        F.sum(F.col("n").cast("double") * (F.col("n") - 1)).alias("same"),
    )
    names = F.concat_ws("+", *[
        F.when(F.col("gid").bitwiseAND(2 ** (len(qid) - 1 - i)) == 0, F.lit(q)) for i, q in enumerate(qid)
    ])
    rows = F.col("rows").cast("double")
    return sums.select(
        names.alias("attributes"), "classes",
        (F.col("classes") / rows).alias("distinction"),
        F.when(rows > 1, 1.0 - F.col("same") / (rows * (rows - 1))).otherwise(F.lit(0.0)).alias("separation"),
        (rows / F.col("classes")).alias("avg_size"),
    )


def population_uniqueness(df: DataFrame, qid: Sequence[str], fraction: float) -> DataFrame:
    """Share of rows expected to be unique in the population (Zayatz, binomial form)."""
    pi = float(fraction)
    h = size_histogram(df, qid)
    j = F.col("n").cast("double")
    unseen = F.sum(F.col("classes") * j * pi * F.pow(F.lit(1.0 - pi), j - 1))
    singles = F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("classes"))), F.lit(0))
    return h.agg(singles.alias("_f"), unseen.alias("_u"), F.sum(F.col("n") * F.col("classes")).alias("_n")).select(
        (F.col("_f") / F.col("_n")).alias("sample_uniqueness"),
        F.when(F.col("_f") > 0, F.col("_f") * pi / F.col("_u")).otherwise(F.lit(0.0)).alias("p_unique"),
        F.when(F.col("_f") > 0, F.col("_f") / F.col("_n") * (F.col("_f") * pi / F.col("_u"))).otherwise(F.lit(0.0)).alias("population_uniqueness"),
    )


def wildcard_sizes(df: DataFrame, qid: Sequence[str]) -> DataFrame:
    """Rows each distinct tuple matches if ``*`` matches anything.

    Two tuples match iff they agree where neither has a star. For every pair of star
    patterns both sides are reduced to the columns visible in both, counted there and
    joined on equality: one hit per tuple and pattern, no comparison of pairs.
    """
    base = df.groupBy(*qid).agg(F.count("*").alias("cnt"))
    m = len(qid)
    mask = F.lit(0)
    for i, q in enumerate(qid):
        mask = mask + F.when(F.col(q).eqNullSafe(F.lit(STAR)), 2**i).otherwise(0)
    masked = base.withColumn("_m", mask)
    # At most 2^m patterns; only those that occur are paired.
    present = masked.agg(F.collect_set("_m").alias("p")).scalar()
    paired = masked.withColumn("_o", F.explode(present))

    def reduced(d: DataFrame, mine: str, other: str) -> DataFrame:
        both = F.col("_m").bitwiseOR(F.col("_o"))
        keys = [
            F.when(both.bitwiseAND(2**i) == 0, F.col(q)).alias(f"_k{i}") for i, q in enumerate(qid)
        ]
        return d.select(F.col("_m").alias(mine), F.col("_o").alias(other), *keys, *([*qid] if mine == "_a" else []), "cnt")

    keys = ["_a", "_b", *[f"_k{i}" for i in range(m)]]
    counted = reduced(paired, "_b", "_a").groupBy(*keys).agg(F.sum("cnt").alias("hits"))
    joined = null_safe(reduced(paired, "_a", "_b"), counted, keys)
    return joined.groupBy(*qid).agg(F.max("cnt").alias("cnt"), F.sum("hits").alias("matches"))


def wildcard_risk(df: DataFrame, qid: Sequence[str], threshold: float) -> DataFrame:
    """Rows at risk, highest and average risk with and without star matching."""
    sizes = wildcard_sizes(df, qid)

    def summary(n: Column, label: str) -> DataFrame:
        risk = 1.0 / n
        return sizes.agg(
            F.lit(label).alias("matching"),
            (F.coalesce(F.sum(F.when(risk > threshold, F.col("cnt"))), F.lit(0)) / F.sum("cnt")).alias("records_at_risk"),
            F.max(risk).alias("highest_risk"),
            (F.sum(F.col("cnt") * risk) / F.sum("cnt")).alias("average_risk"),
        )

    return summary(F.col("matches"), "wildcard").unionByName(summary(F.col("cnt"), "exact"))


# Patterns of identifiers in text and in column names (own choice).
VALUE_PATTERNS = {
    "age_over_89": r"^(9[0-9]|1[0-4][0-9])$",
    "date": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}( ?[0-9A-Z]{4}){3,7}( ?[0-9A-Z]{1,3})?\b",
    "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "phone": r"\+[0-9]{1,3}[ -][0-9]{3,}",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "url": r"https?://[A-Za-z0-9.-]+",
    "vin": r"\b[A-HJ-NPR-Z]{3}[ -]?[0-9]{3} ?[0-9]{3}-?[0-9A-Z]-?[0-9]{6}\b",
    "zip": r"^[0-9]{5}$",
}
NEEDED_TEXT = {"date": "-", "email": "@", "phone": "+", "ssn": "-", "url": "http"}
NAME_PATTERNS = {
    "age_over_89": r"(?i)\bage\b",
    "date": r"(?i)(date|birth)",
    "email": r"(?i)e-?mail",
    "iban": r"(?i)(iban|bank|account)",
    "ip": r"(?i)(^|_)ip($|_)",
    "name": r"(?i)(^|[ _])name$",
    "phone": r"(?i)(phone|fax|mobile)",
    "ssn": r"(?i)(ssn|social)",
    "url": r"(?i)(^|_)ur[li]($|_)",
    "vin": r"(?i)(vin|vehicle)",
    "zip": r"(?i)(zip|post(al)?_?code)",
}


def hipaa_scan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many values of each column look like each identifier; whole values, one pass."""
    import re

    names = sorted({*VALUE_PATTERNS, *NAME_PATTERNS})
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    sums = [F.count(c).alias(f"{c}|n") for c in columns]
    for c, kind in itertools.product(columns, VALUE_PATTERNS):
        hit = F.rlike(F.col(c), F.lit(VALUE_PATTERNS[kind]))
        if kind in NEEDED_TEXT:  # a plain search first: cheaper than the pattern
            hit = F.contains(F.col(c), F.lit(NEEDED_TEXT[kind])) & hit
        sums.append(F.count_if(hit).alias(f"{c}|{kind}"))
    totals = text.agg(*sums)
    lines = []
    for c, kind in itertools.product(columns, names):
        hits = F.col(f"`{c}|{kind}`") if kind in VALUE_PATTERNS else F.lit(0).cast("bigint")
        by_name = bool(re.search(NAME_PATTERNS[kind], c))
        lines.append(F.struct(
            F.lit(c).alias("column"), F.lit(kind).alias("identifier"), F.col(f"`{c}|n`").alias("n"),
            hits.alias("matches"), F.lit(by_name).alias("by_name")))
    return totals.select(F.explode(F.array(*lines)).alias("r")).select("r.*").filter("matches > 0 or by_name")
