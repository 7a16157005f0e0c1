"""Risk and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe.operators import hierarchies as H
from cloakframe.operators import quality as Q
from cloakframe.operators import risk as R
from cloakframe.operators import sampling as S
from cloakframe.operators.privacy import KAnonymity
from cloakframe.plans.privacy import LATTICE, PRICE, _span
from cloakframe.plans.registry import register
from cloakframe.plans.tables import (
    GEN, ID, NODE, PEOPLE, QID, QKEY, SAMPLE, SEED,
    definition, generalized, people, published, table,
)


def rounded(df, columns=None, digits=6):
    kinds = dict(df.dtypes)
    columns = [c for c in df.columns if kinds[c] == "double"] if columns is None else columns
    return df.withColumns({c: F.round(c, digits) for c in columns})


SIZES = f"{GEN}, c AS (SELECT {QKEY}, count(*) AS n FROM gen GROUP BY ALL)"
PAIR = f"{SAMPLE}, p AS (SELECT {QKEY}, count(*) AS n FROM pub GROUP BY ALL), s AS (SELECT {QKEY}, count(*) AS m FROM samp GROUP BY ALL), c AS (SELECT m AS rows, n FROM s JOIN p USING ({QKEY}))"
THREE = "round(CAST(coalesce(sum(rows) FILTER (1e0 / n > 0.08), 0) / sum(rows) AS DOUBLE), 6) AS records_at_risk, round(max(1e0 / n), 6) AS highest_risk, round(sum(CAST(rows AS DOUBLE) / n) / sum(rows), 6) AS success_rate"


def pair(spark, sf):
    output = published(spark, sf)
    return S.stratified_sample(output, QID, 0.2, ID, SEED), output


@register("risk_prosecutor", f"WITH {SIZES} SELECT {THREE} FROM (SELECT n, n AS rows FROM c)")
def risk_prosecutor(spark, sf):
    return rounded(R.prosecutor_risk(generalized(spark, sf), QID, 0.08))


@register("risk_journalist", f"WITH {PAIR} SELECT {THREE} FROM c")
def risk_journalist(spark, sf):
    drawn, output = pair(spark, sf)
    return rounded(R.journalist_summary(drawn, output, QID, 0.08))


@register("risk_marketer", f"WITH {PAIR} SELECT round(sum(CAST(rows AS DOUBLE) / n) / sum(rows), 6) AS success_rate FROM c")
def risk_marketer(spark, sf):
    drawn, output = pair(spark, sf)
    return rounded(R.marketer_risk(drawn, output, QID))


@register("risk_sample", f"""WITH {SIZES} SELECT round(CAST(count(*) AS DOUBLE) / sum(n), 6) AS average_risk, round(1e0 / max(n), 6) AS lowest_risk, round(1e0 / min(n), 6) AS highest_risk,
  round(CAST(sum(n) FILTER (n = (SELECT max(n) FROM c)) AS DOUBLE) / sum(n), 6) AS rows_at_lowest, round(CAST(sum(n) FILTER (n = (SELECT min(n) FROM c)) AS DOUBLE) / sum(n), 6) AS rows_at_highest,
  round(CAST(coalesce(sum(n) FILTER (n = 1), 0) AS DOUBLE) / sum(n), 6) AS sample_uniqueness FROM c""")
def risk_sample(spark, sf):
    return rounded(R.sample_risk(generalized(spark, sf), QID))


@register("risk_distribution", f"""WITH {SIZES}, h AS (SELECT n, sum(n) AS r FROM c GROUP BY n)
  SELECT n, round(1e0 / n, 6) AS risk, round(CAST(r AS DOUBLE) / sum(r) OVER (), 6) AS fraction, round(CAST(sum(r) OVER (ORDER BY n DESC) AS DOUBLE) / sum(r) OVER (), 6) AS cumulative FROM h""")
def risk_distribution(spark, sf):
    return rounded(R.risk_distribution(generalized(spark, sf), QID))


EST = THREE.replace("1e0 / n", "1e0 / n / 4 ").replace("CAST(rows AS DOUBLE) / n", "CAST(rows AS DOUBLE) / n / 4")


@register("risk_estimated", f"""WITH {SIZES}, r AS (SELECT n, n AS rows FROM c)
  SELECT 'prosecutor' AS attacker, {THREE} FROM r UNION ALL SELECT 'journalist', {EST} FROM r UNION ALL SELECT 'marketer', NULL, NULL, round(sum(CAST(rows AS DOUBLE) / n / 4) / sum(rows), 6) FROM r""")
def risk_estimated(spark, sf):
    return rounded(R.estimated_risk(generalized(spark, sf), QID, 0.08, 0.25))


def _subsets_sql(select: str) -> str:
    parts = []
    for picked in range(1, 8):
        names = [q for i, q in enumerate(QID) if picked & (1 << i)]
        parts.append(f"SELECT '{'+'.join(names)}' AS attributes, {select} FROM (SELECT count(*) AS n FROM gen GROUP BY {', '.join(names)})")
    return f"WITH {GEN} " + " UNION ALL ".join(parts)


@register("attribute_risk", _subsets_sql("round(CAST(count(*) AS DOUBLE) / sum(n), 6) AS distinction, round(1 - sum(CAST(n AS DOUBLE) * (n - 1)) / (CAST(sum(n) AS DOUBLE) * (sum(n) - 1)), 6) AS separation"))
def attribute_risk(spark, sf):
    return rounded(R.attribute_risk(generalized(spark, sf), QID).select("attributes", "distinction", "separation"))


@register("subset_eq_stats", _subsets_sql("count(*) AS classes, round(avg(n), 6) AS avg_size"))
def subset_eq_stats(spark, sf):
    return rounded(R.attribute_risk(generalized(spark, sf), QID).select("attributes", "classes", "avg_size"))


MONTH = {"n_name": 0, "c_mktsegment": 0, "o_orderdate": 1}


@register("pop_uniqueness", f"""WITH {PEOPLE}, c AS (SELECT count(*) AS n FROM people GROUP BY n_name, c_mktsegment, strftime(o_orderdate, '%Y-%m')), h AS (SELECT n, count(*) AS k FROM c GROUP BY n),
  u AS (SELECT coalesce(sum(k) FILTER (n = 1), 0) AS f, sum(k * n * 0.1e0 * pow(0.9e0, n - 1)) AS u, sum(n * k) AS t FROM h)
  SELECT round(CAST(f AS DOUBLE) / t, 6) AS sample_uniqueness, round(CASE WHEN f > 0 THEN f * 0.1e0 / u ELSE 0 END, 6) AS p_unique, round(CASE WHEN f > 0 THEN CAST(f AS DOUBLE) / t * (f * 0.1e0 / u) ELSE 0 END, 6) AS population_uniqueness FROM u""")
def pop_uniqueness(spark, sf):
    """At months instead of years, so that some classes hold a single row."""
    rows = H.generalize(people(spark, sf), definition(spark, sf), MONTH)
    return rounded(R.population_uniqueness(rows, QID, 0.1))


CELLS = f"""{PEOPLE}, w AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN '*' ELSE n_name END AS n_name, CASE WHEN o_orderstatus = 'F' THEN '*' ELSE c_mktsegment END AS c_mktsegment,
    CASE WHEN o_totalprice > 300000 THEN '*' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS o_orderdate FROM people), t AS (SELECT {QKEY}, count(*) AS n FROM w GROUP BY ALL),
  x AS (SELECT a.n_name, a.c_mktsegment, a.o_orderdate, a.n, sum(b.n) AS m FROM t a JOIN t b ON (a.n_name = b.n_name OR a.n_name = '*' OR b.n_name = '*') AND (a.c_mktsegment = b.c_mktsegment OR a.c_mktsegment = '*' OR b.c_mktsegment = '*')
    AND (a.o_orderdate = b.o_orderdate OR a.o_orderdate = '*' OR b.o_orderdate = '*') GROUP BY ALL)"""


def cell_suppressed(spark, sf):
    """Single cells starred, so that rows match each other in many ways."""
    star = lambda test, c: F.when(test, F.lit("*")).otherwise(F.col(c)).alias(c)
    return generalized(spark, sf).select(
        star(F.col("o_orderpriority") == "5-LOW", "n_name"), star(F.col("o_orderstatus") == "F", "c_mktsegment"),
        star(F.col("o_totalprice") > 300000, "o_orderdate"))


@register("risk_wildcard", f"""WITH {CELLS} SELECT 'wildcard' AS matching, round(CAST(coalesce(sum(n) FILTER (1e0 / m > 0.003), 0) AS DOUBLE) / sum(n), 6) AS records_at_risk, round(max(1e0 / m), 6) AS highest_risk, round(sum(n * (1e0 / m)) / sum(n), 6) AS average_risk FROM x
  UNION ALL SELECT 'exact', round(CAST(coalesce(sum(n) FILTER (1e0 / n > 0.003), 0) AS DOUBLE) / sum(n), 6), round(max(1e0 / n), 6), round(sum(n * (1e0 / n)) / sum(n), 6) FROM x""")
def risk_wildcard(spark, sf):
    return rounded(R.wildcard_risk(cell_suppressed(spark, sf), QID, 0.003))


def _hipaa_sql() -> str:
    import re

    columns = ("text", "source", "lang")
    parts = []
    for c in columns:
        for kind in sorted({*R.VALUE_PATTERNS, *R.NAME_PATTERNS}):
            hits = f"count(*) FILTER (regexp_matches({c}, '{R.VALUE_PATTERNS[kind]}'))" if kind in R.VALUE_PATTERNS else "0"
            named = str(bool(re.search(R.NAME_PATTERNS[kind], c))).lower()
            parts.append(f"SELECT '{c}' AS \"column\", '{kind}' AS identifier, count({c}) AS n, CAST({hits} AS BIGINT) AS matches, {named} AS by_name FROM documents")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE matches > 0 OR by_name"


@register("hipaa_scan", _hipaa_sql())
def hipaa_scan(spark, sf):
    return R.hipaa_scan(table(spark, sf, "documents"), ["text", "source", "lang"])


# ---------------------------------------------------------------------- quality

CODED = LATTICE + """, r0 AS (SELECT p.*, CAST(year(o_orderdate) AS VARCHAR) AS y, CAST(nlf[1] AS DOUBLE) AS f1, CAST(slf[1] AS DOUBLE) AS f2, CAST(dlf[4] AS DOUBLE) AS f3, nd, sd, dd FROM people p
    JOIN nl ON nl.n_name = p.n_name JOIN sl ON sl.c_mktsegment = p.c_mktsegment JOIN dl ON d = o_orderdate),
  r1 AS (SELECT *, count(*) OVER (PARTITION BY n_name, c_mktsegment, y) AS cn, count(*) OVER () AS t FROM r0), r2 AS (SELECT *, cn >= 10 AS ok FROM r1),
  coded AS (SELECT o_orderkey, n_name, c_mktsegment, o_orderdate, ok, cn, t, CASE WHEN ok THEN n_name ELSE '*' END AS g1, CASE WHEN ok THEN c_mktsegment ELSE '*' END AS g2, CASE WHEN ok THEN y ELSE '*' END AS g3,
    CASE WHEN ok THEN f1 ELSE nd END AS f1, CASE WHEN ok THEN f2 ELSE sd END AS f2, CASE WHEN ok THEN f3 ELSE dd END AS f3, nd, sd, dd FROM r2)"""


def code(spark, sf):
    return Q.coded(people(spark, sf), definition(spark, sf), NODE, [KAnonymity(10)])


@register("q_ambiguity", f"WITH {CODED} SELECT round(avg(f1 * f2 * f3), 6) AS ambiguity FROM coded")
def q_ambiguity(spark, sf):
    return rounded(Q.ambiguity(code(spark, sf), QID))


@register("q_aecs", f"WITH {CODED} SELECT round(avg(n), 6) AS aecs FROM (SELECT count(*) AS n FROM coded GROUP BY g1, g2, g3)")
def q_aecs(spark, sf):
    return rounded(Q.aecs(code(spark, sf), QID))


@register("q_discernibility", f"WITH {CODED} SELECT CAST(sum(CASE WHEN ok THEN cn ELSE t END) AS DOUBLE) AS discernibility FROM coded")
def q_discernibility(spark, sf):
    return rounded(Q.discernibility(code(spark, sf), QID))


@register("q_granularity", f"WITH {CODED} SELECT round(1 - avg(((f1 - 1) / (nd - 1) + (f2 - 1) / (sd - 1) + (f3 - 1) / (dd - 1)) / 3), 6) AS granularity FROM coded")
def q_granularity(spark, sf):
    return rounded(Q.granularity(code(spark, sf), QID))


@register("q_precision", f"WITH {CODED} SELECT round(1 - avg(CASE WHEN ok THEN (3e0 / 4) / 3 ELSE 1 END), 6) AS precision FROM coded")
def q_precision(spark, sf):
    return rounded(Q.precision(code(spark, sf), definition(spark, sf)))


def _bits(q: str, g: str) -> str:
    return f"SELECT '{q}' AS attribute, round(sum(-log2(least(1e0, CAST(fr AS DOUBLE) / fg))), 3) AS bits FROM (SELECT count(*) OVER (PARTITION BY {q}) AS fr, count(*) OVER (PARTITION BY {g}) AS fg FROM coded)"


@register("q_entropy", f"WITH {CODED} " + " UNION ALL ".join(_bits(q, g) for q, g in zip(QID, ("g1", "g2", "g3"))))
def q_entropy(spark, sf):
    return rounded(Q.entropy(code(spark, sf), QID), digits=3)


NUMERIC = ("n_name", "o_totalprice", "o_orderdate")
NUM_NODE = {"n_name": 1, "o_totalprice": 2, "o_orderdate": 3}
CODED_NUM = f"""{PEOPLE}, b AS (SELECT r_name AS b1, {_span(50000)} AS b2, CAST(year(o_orderdate) AS VARCHAR) AS b3, o_totalprice AS x1, CAST(o_orderdate - DATE '1970-01-01' AS DOUBLE) AS x2 FROM people),
  n AS (SELECT *, count(*) OVER (PARTITION BY b1, b2, b3) >= 30 AS ok FROM b),
  coded AS (SELECT x1, x2, CASE WHEN ok THEN b1 ELSE '*' END AS g1, CASE WHEN ok THEN b2 ELSE '*' END AS g2, CASE WHEN ok THEN b3 ELSE '*' END AS g3 FROM n)"""


def numeric_code(spark, sf):
    d = definition(spark, sf)
    d = definition(spark, sf, qid=NUMERIC, hierarchies={**d.hierarchies, "o_totalprice": PRICE})
    days = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date"))
    return Q.coded(people(spark, sf), d, NUM_NODE, [KAnonymity(30)]), {"o_totalprice": F.col("o_totalprice"), "o_orderdate": days}


@register("q_attr_se", f"""WITH {CODED_NUM} SELECT 'o_totalprice' AS attribute, round(1 - sum(pow(x1 - m, 2)) / sum(pow(x1 - t, 2)), 6) AS quality FROM (SELECT x1, avg(x1) OVER (PARTITION BY g2) AS m, avg(x1) OVER () AS t FROM coded)
  UNION ALL SELECT 'o_orderdate', round(1 - sum(pow(x2 - m, 2)) / sum(pow(x2 - t, 2)), 6) FROM (SELECT x2, avg(x2) OVER (PARTITION BY g3) AS m, avg(x2) OVER () AS t FROM coded)""")
def q_attr_se(spark, sf):
    coded, numbers = numeric_code(spark, sf)
    return rounded(Q.attribute_squared_error(coded, numbers))


@register("q_record_se", f"""WITH {CODED_NUM}, z AS (SELECT g1, g2, g3, (x1 - min(x1) OVER ()) / (max(x1) OVER () - min(x1) OVER ()) AS x1, (x2 - min(x2) OVER ()) / (max(x2) OVER () - min(x2) OVER ()) AS x2 FROM coded),
  w AS (SELECT x1, x2, avg(x1) OVER (PARTITION BY g1, g2, g3) AS m1, avg(x2) OVER (PARTITION BY g1, g2, g3) AS m2, avg(x1) OVER () AS t1, avg(x2) OVER () AS t2 FROM z)
  SELECT round(1 - sum(pow(x1 - m1, 2) + pow(x2 - m2, 2)) / sum(pow(x1 - t1, 2) + pow(x2 - t2, 2)), 6) AS quality FROM w""")
def q_record_se(spark, sf):
    coded, numbers = numeric_code(spark, sf)
    return rounded(Q.record_squared_error(coded, NUMERIC, numbers))
