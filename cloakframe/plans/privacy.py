"""Hierarchies, lattice search, privacy models and anonymized outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe.definition import Hierarchy
from cloakframe.operators import anonymize as A
from cloakframe.operators import dp as DP
from cloakframe.operators import hierarchies as H
from cloakframe.operators import lattice as L
from cloakframe.operators import ml as M
from cloakframe.operators import privacy as P
from cloakframe.operators import sampling as S
from cloakframe.operators import select as X
from cloakframe.operators import stats as T
from cloakframe.operators.ranking import null_safe

from cloakframe.plans.registry import register
from cloakframe.plans.tables import (
    FOLDS, GEN, ID, NODE, PEOPLE, PUB, QID, QKEY, RETURNED, SEED, TARGET,
    definition, generalized, people, published, returned, strat_cte, table,
)
from cloakframe.session import materialize, scratch_path
from cloakframe.sources import files as IO


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def shown(t):
    return t.select("value", F.array_join("levels", " > ").alias("levels"))


# ------------------------------------------------------------------ hierarchies


@register("hier_redaction", """WITH v AS (SELECT DISTINCT c_name FROM customer)
  SELECT c_name AS value, c_name || ' > ' || (SELECT string_agg(substr(rpad(c_name, 18, ' '), 1, 18 - i) || repeat('*', i), ' > ' ORDER BY i) FROM (SELECT CAST(unnest(range(1, 19)) AS INTEGER) AS i)) AS levels FROM v""")
def hier_redaction(spark, sf):
    return shown(H.redaction(18).materialize(table(spark, sf, "customer"), "c_name"))


PRICE = H.intervals([20000, 30000], 0, 0, 400000, [[2], [2]])


def _span(width: int, first: int | None = None) -> str:
    v = "o_totalprice"
    if first is None:
        base = f"(CAST(floor({v} / {width}) AS BIGINT) * {width})"
        text = f"'[' || {base} || ', ' || ({base} + {width}) || '['"
    else:
        base = f"(CAST(floor({v} / {width}) AS BIGINT) * {width})"
        text = f"CASE WHEN {v} - {base} < {first} THEN '[' || {base} || ', ' || ({base} + {first}) || '[' ELSE '[' || ({base} + {first}) || ', ' || ({base} + {width}) || '[' END"
    return f"CASE WHEN {v} < 0 THEN '<0' WHEN {v} >= 400000 THEN '>=400000' ELSE {text} END"


@register("hier_interval", f"SELECT DISTINCT CAST(o_totalprice AS VARCHAR) AS value, o_totalprice || ' > ' || {_span(50000, 20000)} || ' > ' || {_span(50000)} || ' > ' || {_span(100000)} || ' > *' AS levels FROM orders")
def hier_interval(spark, sf):
    return shown(PRICE.materialize(table(spark, sf, "orders"), "o_totalprice"))


SNAPPED = H.intervals([20000, 30000], 0, H.Bound(20000, 10000, 2000), H.Bound(300000, 350000, 420000), [[2], [2]])


def _snapped(width: int, first: int | None = None) -> str:
    x = "least(greatest(o_totalprice, 20000), 299999.999)"
    base = f"CAST(floor({x} / {width}) AS BIGINT) * {width}"
    low, high = (base, f"{base} + {width}") if first is None else (
        f"{base} + CASE WHEN {x} - {base} < {first} THEN 0 ELSE {first} END", f"{base} + CASE WHEN {x} - {base} < {first} THEN {first} ELSE {width} END")
    text = f"'[' || CASE WHEN {low} <= 20000 THEN 10000 ELSE {low} END || ', ' || CASE WHEN {high} >= 300000 THEN 350000 ELSE {high} END || '['"
    return f"CASE WHEN o_totalprice < 2000 OR o_totalprice >= 420000 THEN '?' WHEN o_totalprice < 10000 THEN '<10000' WHEN o_totalprice >= 350000 THEN '>=350000' ELSE {text} END"


@register("hier_interval_bounds", f"SELECT DISTINCT CAST(o_totalprice AS VARCHAR) AS value, o_totalprice || ' > ' || {_snapped(50000, 20000)} || ' > ' || {_snapped(50000)} || ' > ' || {_snapped(100000)} || ' > *' AS levels FROM orders")
def hier_interval_bounds(spark, sf):
    """Separate bounds for snapping, bound labels and the range, on both sides."""
    listed = SNAPPED.materialize(table(spark, sf, "orders"), "o_totalprice")
    return listed.select("value", F.array_join("levels", " > ", "?").alias("levels"))


@register("hier_order", """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS v FROM orders), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r FROM d),
  a AS (SELECT v, min(v) OVER (PARTITION BY r // 10) AS lo1, max(v) OVER (PARTITION BY r // 10) AS hi1, min(v) OVER (PARTITION BY r // 20) AS lo2, max(v) OVER (PARTITION BY r // 20) AS hi2 FROM r)
  SELECT CAST(v AS VARCHAR) AS value, v || ' > [' || lo1 || ', ' || hi1 || '] > [' || lo2 || ', ' || hi2 || '] > *' AS levels FROM a""")
def hier_order(spark, sf):
    dates = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    return shown(H.order_table(dates, "d", [10, 2]))


@register("hier_priority", f"""WITH {PEOPLE}, p AS (SELECT n_name AS v, count(*) AS p FROM people GROUP BY n_name), r AS (SELECT v, row_number() OVER (ORDER BY p, v) AS r, count(*) OVER () AS c FROM p)
  SELECT v AS value, v || ' > ' || CASE WHEN r <= ceil(c / 2) THEN '*' ELSE v END || ' > *' AS levels FROM r""")
def hier_priority(spark, sf):
    """Nations with few orders are hidden first."""
    counts = people(spark, sf).groupBy("n_name").agg(F.count("*").alias("p"))
    return shown(H.priority_table(counts, "n_name", "p", 3))


@register("hier_date", """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS v FROM orders)
  SELECT CAST(v AS VARCHAR) AS value, v || ' > ' || strftime(v, '%V') || '/' || strftime(v, '%G') || ' > ' || quarter(v) || '/' || year(v) || ' > ' || year(v) || ' > *' AS levels FROM d""")
def hier_date(spark, sf):
    dates = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    return shown(H.dates(["week_year", "quarter_year", "year"]).materialize(dates, "d"))


@register("hier_edges", "SELECT CAST(0 AS INTEGER) AS level, n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT 1, r_name, '*' FROM nation JOIN region ON n_regionkey = r_regionkey")
def hier_edges(spark, sf):
    return H.edges(definition(spark, sf).hierarchy("n_name").table)


@register("hier_level_sizes", """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS v FROM orders)
  SELECT CAST(0 AS INTEGER) AS level, count(*) AS "values" FROM d UNION ALL SELECT 1, count(DISTINCT strftime(v, '%Y-%m')) FROM d UNION ALL SELECT 2, count(DISTINCT quarter(v) || '/' || year(v)) FROM d
  UNION ALL SELECT 3, count(DISTINCT year(v)) FROM d UNION ALL SELECT 4, 1""")
def hier_level_sizes(spark, sf):
    dates = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    return H.level_sizes(H.dates(["month", "quarter_year", "year"]).materialize(dates, "d"))


@register("range_midpoint", f"SELECT o_orderkey, CASE WHEN o_totalprice >= 400000 THEN NULL ELSE floor(o_totalprice / 50000) * 50000 + 25000 END::DOUBLE AS o_totalprice, CAST(0 AS DOUBLE) AS o_orderstatus FROM orders")
def range_midpoint(spark, sf):
    """Prices as ranges of 50000 turned into midpoints; a fully starred column into 0."""
    d = definition(spark, sf, qid=("o_totalprice", "o_orderstatus"), hierarchies={"o_totalprice": PRICE})
    rows = H.generalize(table(spark, sf, "orders"), d, {"o_totalprice": 2, "o_orderstatus": 1})
    return M.ranges_to_midpoints(rows, ["o_totalprice", "o_orderstatus"]).select("o_orderkey", "o_totalprice", "o_orderstatus")


@register("starred_col", "SELECT o_orderkey, '-1' AS o_orderstatus, o_orderpriority FROM orders")
def starred_col(spark, sf):
    d = definition(spark, sf, qid=("o_orderstatus",), hierarchies={})
    rows = H.generalize(table(spark, sf, "orders"), d, {"o_orderstatus": 1})
    return M.starred_to_number(rows, ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "o_orderstatus", "o_orderpriority")


# ---------------------------------------------------------------------- lattice

LATTICE = PEOPLE + """, rows_ AS (SELECT n_name, r_name, c_mktsegment, o_orderdate, price_bin, o_orderpriority, o_orderkey FROM people),
  dl AS (SELECT d, [CAST(d AS VARCHAR), m, q, y, '*'] AS dlv, [1, count(*) OVER (PARTITION BY m), count(*) OVER (PARTITION BY q), count(*) OVER (PARTITION BY y), count(*) OVER ()] AS dlf, count(*) OVER () AS dd FROM (
    SELECT d, strftime(d, '%Y-%m') AS m, quarter(d) || '/' || year(d) AS q, CAST(year(d) AS VARCHAR) AS y FROM (SELECT DISTINCT o_orderdate AS d FROM rows_))),
  nl AS (SELECT n_name, [n_name, r_name, '*'] AS nlv, [1, count(*) OVER (PARTITION BY r_name), count(*) OVER ()] AS nlf, count(*) OVER () AS nd FROM nation JOIN region ON n_regionkey = r_regionkey),
  sl AS (SELECT c_mktsegment, [c_mktsegment, '*'] AS slv, [1, count(*) OVER ()] AS slf, count(*) OVER () AS sd FROM (SELECT DISTINCT c_mktsegment FROM rows_)),
  nodes AS (SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(c AS INTEGER) AS c FROM range(3) t(a), range(2) u(b), range(5) v(c))"""


def lattice_sql(model: str = "n >= 10", having: str = "", extra: str = "", nodes: str = "true", loss: str | None = None, select: str = "", source: str = "rows_") -> str:
    """Scores of all nodes: ``model`` judges a class from its aggregates."""
    loss = loss or "sum(n * CASE WHEN ok THEN cell ELSE 1e0 END) / sum(n)"
    return LATTICE + f""", base AS (SELECT n_name, c_mktsegment, o_orderdate, {extra} count(*) AS cnt FROM {source} GROUP BY ALL),
  wide AS (SELECT a, b, c, nlv[a + 1] AS g1, slv[b + 1] AS g2, dlv[c + 1] AS g3, {extra} cnt, n_name, c_mktsegment, o_orderdate,
    ((CAST(nlf[a + 1] AS DOUBLE) - 1) / (nd - 1) + (CAST(slf[b + 1] AS DOUBLE) - 1) / (sd - 1) + (CAST(dlf[c + 1] AS DOUBLE) - 1) / (dd - 1)) / 3 AS cell,
    (ln(CAST(nlf[a + 1] AS DOUBLE)) + ln(CAST(slf[b + 1] AS DOUBLE)) + ln(CAST(dlf[c + 1] AS DOUBLE))) / (ln(CAST(nd AS DOUBLE)) + ln(CAST(sd AS DOUBLE)) + ln(CAST(dd AS DOUBLE))) AS info
    FROM base JOIN nl USING (n_name) JOIN sl USING (c_mktsegment) JOIN dl ON d = o_orderdate, nodes WHERE {nodes}),
  cls AS (SELECT a, b, c, g1, g2, g3, sum(cnt) AS n, max(cell) AS cell, max(info) AS info {select} FROM wide GROUP BY a, b, c, g1, g2, g3),
  judged AS (SELECT *, {model} AS ok FROM cls),
  scored AS (SELECT a || ',' || b || ',' || c AS node, a + b + c AS level, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (NOT ok), 0) AS BIGINT) AS suppressed, count(*) FILTER (ok) AS classes, {loss} AS loss FROM judged GROUP BY a, b, c)"""


SCORE = "node, CAST(level AS INTEGER) AS level, rows, suppressed, classes, round(loss, 6) AS loss"
BEST = "ORDER BY round(scored.loss, 9), level, node LIMIT 1"


@register("lattice_scores", f"WITH {lattice_sql()} SELECT {SCORE}, suppressed <= 0.05 * rows AS valid FROM scored")
def lattice_scores(spark, sf):
    scored = L.scores(people(spark, sf), definition(spark, sf), [P.KAnonymity(10)], suppression=0.05)
    return rounded(scored, ["loss"])


@register("lattice_bounded", f"WITH {lattice_sql(nodes='a >= 1 AND c BETWEEN 2 AND 3')} SELECT {SCORE}, suppressed <= 0.05 * rows AS valid FROM scored")
def lattice_bounded(spark, sf):
    d = definition(spark, sf)
    chosen = L.nodes(d, {"n_name": 1, "o_orderdate": 2}, {"o_orderdate": 3})
    return rounded(L.scores(people(spark, sf), d, [P.KAnonymity(10)], suppression=0.05, chosen=chosen), ["loss"])


@register("anonymize_optimum", f"WITH {lattice_sql()}, best AS (SELECT * FROM scored WHERE suppressed <= 0.05 * rows {BEST}) SELECT {SCORE}, true AS valid FROM best")
def anonymize_optimum(spark, sf):
    scored = L.scores(people(spark, sf), definition(spark, sf), [P.KAnonymity(10)], suppression=0.05)
    return rounded(L.optimum(scored), ["loss"])


WIDE = {
    "n_name": "[n_name, (SELECT any_value(r_name) FROM region WHERE r_regionkey = n_regionkey), '*']",
    "c_mktsegment": "[c_mktsegment, '*']",
    "o_orderdate": "[CAST(o_orderdate AS VARCHAR), quarter(o_orderdate) || '/' || year(o_orderdate), CAST(year(o_orderdate) AS VARCHAR), '*']",
    "o_orderpriority": "[o_orderpriority, '*']",
    "o_orderstatus": "[o_orderstatus, '*']",
    "price": "[CAST(price AS VARCHAR), CAST(CAST(floor(price / 10) AS BIGINT) * 10 AS VARCHAR), '*']",
    "balance": "[CAST(balance AS VARCHAR), CAST(CAST(floor(balance / 5) AS BIGINT) * 5 AS VARCHAR), '*']",
    "digit": "[CAST(digit AS VARCHAR), '*']",
}


def wide_sql(k: int, suppression: float) -> str:
    """All nodes over eight attributes, generalized one attribute after the other."""
    names, parts = list(WIDE), []
    parts.append("""rows_ AS (SELECT n_name, c_mktsegment, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority, o_orderstatus,
    CAST(floor(o_totalprice / 10000) AS BIGINT) AS price, CAST(floor(c_acctbal / 1000) AS BIGINT) AS balance, c_custkey % 10 AS digit
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""")
    parts.append(f"w0 AS (SELECT {', '.join(names)}, count(*) AS cnt, 0e0 AS cell FROM rows_ GROUP BY ALL)")
    for i, (q, levels) in enumerate(WIDE.items()):
        source = "SELECT * FROM nation" if q == "n_name" else f"SELECT DISTINCT {q} FROM rows_"
        parts.append(f"""v{i} AS (SELECT {q} AS raw, {levels} AS lv FROM ({source})),
  t{i} AS (SELECT raw, level, lv[level + 1] AS label, count(*) OVER (PARTITION BY level, lv[level + 1]) AS leaves, count(*) OVER (PARTITION BY level) AS domain
    FROM v{i}, (SELECT CAST(unnest(range((SELECT max(len(lv)) FROM v{i}))) AS INTEGER) AS level))""")
        done = "".join(f"l{j}, g{j}, " for j in range(i))
        rest = "".join(f"{x}, " for x in names[i + 1:])
        parts.append(f"""w{i + 1} AS (SELECT {done}{rest}level AS l{i}, label AS g{i}, CAST(sum(cnt) AS BIGINT) AS cnt,
    max(cell + CASE WHEN domain > 1 THEN (leaves - 1e0) / (domain - 1) ELSE 0 END / {len(names)}) AS cell
    FROM w{i} JOIN t{i} ON {q} = raw GROUP BY {done}{rest}level, label)""")
    node = " || ',' || ".join(f"l{i}" for i in range(len(names)))
    parts.append(f"""scored AS (SELECT {node} AS node, {' + '.join(f'l{i}' for i in range(len(names)))} AS level, CAST(sum(cnt) AS BIGINT) AS rows,
    CAST(coalesce(sum(cnt) FILTER (cnt < {k}), 0) AS BIGINT) AS suppressed, count(*) FILTER (cnt >= {k}) AS classes,
    sum(cnt * CASE WHEN cnt >= {k} THEN cell ELSE 1e0 END) / sum(cnt) AS loss FROM w{len(names)} GROUP BY {', '.join(f'l{i}' for i in range(len(names)))})""")
    return f"WITH {', '.join(parts)} SELECT {SCORE}, true AS valid FROM scored WHERE suppressed <= {suppression} * rows {BEST}"


def wide(spark, sf):
    """Eight attributes of each order, and their hierarchies."""
    tenth, fifth = (lambda c: F.floor(c / 10) * 10), (lambda c: F.floor(c / 5) * 5)
    top = lambda c: F.lit("*")
    rows = (
        table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "n_name", "c_mktsegment", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority", "o_orderstatus",
            F.floor(F.col("o_totalprice") / 10000).alias("price"), F.floor(F.col("c_acctbal") / 1000).alias("balance"),
            (F.col("c_custkey") % 10).alias("digit")))
    d = definition(spark, sf, qid=tuple(WIDE), hierarchies={
        "n_name": definition(spark, sf).hierarchy("n_name"), "o_orderdate": H.dates(["quarter_year", "year"]),
        "price": Hierarchy.functional(tenth, top), "balance": Hierarchy.functional(fifth, top)})
    return rows, d


@register("anonymize_wide", wide_sql(10, 0.05))
def anonymize_wide(spark, sf):
    """The best of 1,728 nodes over eight attributes, without scoring most of them."""
    rows, d = wide(spark, sf)
    best = L.search(rows, d, [P.KAnonymity(10)], suppression=0.05)
    schema = "node string, level int, rows bigint, suppressed bigint, classes bigint, loss double, valid boolean"
    return rounded(spark.createDataFrame([best] if best else [], schema), ["loss"])


HEIGHT = lattice_sql(loss="CAST(a + b + c AS DOUBLE)")


@register("optimum_height", f"WITH {HEIGHT} SELECT {SCORE}, true AS valid FROM scored WHERE suppressed <= 0.05 * rows {BEST}")
def optimum_height(spark, sf):
    scored = L.scores(people(spark, sf), definition(spark, sf), [P.KAnonymity(10)], L.Quality("height"), 0.05)
    return rounded(L.optimum(scored), ["loss"])


CLASSIFY = lattice_sql(extra="price_bin,", loss="CAST(sum(CASE WHEN ok THEN n - major ELSE n END) AS DOUBLE) / sum(n)").replace(
    "judged AS (SELECT *,", "maj AS (SELECT a, b, c, g1, g2, g3, max(t) AS major FROM (SELECT a, b, c, g1, g2, g3, price_bin, sum(cnt) AS t FROM wide GROUP BY ALL) GROUP BY a, b, c, g1, g2, g3),\n judged AS (SELECT * ,").replace(
    "AS ok FROM cls)", "AS ok FROM cls JOIN maj USING (a, b, c, g1, g2, g3))")


@register("scores_classification", f"WITH {CLASSIFY} SELECT {SCORE}, suppressed <= 1.0 * rows AS valid FROM scored")
def scores_classification(spark, sf):
    scored = L.scores(people(spark, sf), definition(spark, sf), [P.KAnonymity(10)], L.Quality("classification"), 1.0)
    return rounded(scored, ["loss"])


ENTROPY = LATTICE + """, base AS (SELECT n_name, c_mktsegment, o_orderdate, count(*) AS cnt FROM rows_ GROUP BY ALL),
  w0 AS (SELECT a, b, c, nlv[a + 1] AS g1, slv[b + 1] AS g2, dlv[c + 1] AS g3, cnt, n_name, c_mktsegment, o_orderdate FROM base JOIN nl USING (n_name) JOIN sl USING (c_mktsegment) JOIN dl ON d = o_orderdate, nodes),
  w1 AS (SELECT *, sum(cnt) OVER (PARTITION BY a, b, c) AS t, sum(cnt) OVER (PARTITION BY a, b, c, n_name) AS f1, sum(cnt) OVER (PARTITION BY a, b, c, g1) AS h1, sum(cnt) OVER (PARTITION BY a, b, c, c_mktsegment) AS f2, sum(cnt) OVER (PARTITION BY a, b, c, g2) AS h2,
    sum(cnt) OVER (PARTITION BY a, b, c, o_orderdate) AS f3, sum(cnt) OVER (PARTITION BY a, b, c, g3) AS h3 FROM w0),
  cls AS (SELECT a, b, c, g1, g2, g3, sum(cnt) AS n, -sum(cnt * (log2(f1 / h1) + log2(f2 / h2) + log2(f3 / h3))) AS bits, -sum(cnt * (log2(f1 / t) + log2(f2 / t) + log2(f3 / t))) AS most FROM w1 GROUP BY a, b, c, g1, g2, g3),
  judged AS (SELECT *, n >= 10 AS ok FROM cls),
  scored AS (SELECT a || ',' || b || ',' || c AS node, a + b + c AS level, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (NOT ok), 0) AS BIGINT) AS suppressed, count(*) FILTER (ok) AS classes, sum(CASE WHEN ok THEN bits ELSE most END) AS loss FROM judged GROUP BY a, b, c)"""


@register("scores_entropy", f"WITH {ENTROPY} SELECT node, CAST(level AS INTEGER) AS level, rows, suppressed, classes, round(loss, 3) AS loss, suppressed <= 1.0 * rows AS valid FROM scored")
def scores_entropy(spark, sf):
    scored = L.scores(people(spark, sf), definition(spark, sf), [P.KAnonymity(10)], L.Quality("entropy"), 1.0)
    return rounded(scored, ["loss"], 3)


COSTS = {"adversary_cost": 4.0, "adversary_gain": 300.0, "publisher_loss": 300.0, "publisher_benefit": 1200.0}
EARNED = "CASE WHEN 300e0 / n > 4e0 THEN 1200e0 * (1 - info) - 300e0 / n ELSE 1200e0 * (1 - info) END"
PAYOUT = lattice_sql(model=f"{EARNED} > 0", loss=f"-sum(CASE WHEN ok THEN n * greatest({EARNED}, 0e0) ELSE 0e0 END)")


@register("scores_payout", f"WITH {PAYOUT} SELECT node, CAST(level AS INTEGER) AS level, rows, suppressed, classes, round(loss, 3) AS loss, suppressed <= 1.0 * rows AS valid FROM scored")
def scores_payout(spark, sf):
    model = P.Profitability(tuple(COSTS.items()))
    scored = L.scores(people(spark, sf), definition(spark, sf), [model], L.Quality("payout", costs=COSTS), 1.0)
    return rounded(scored, ["loss"], 3)


WEIGHTED = lattice_sql().replace("/ (nd - 1) +", "/ (nd - 1) * 2 +").replace("/ (dd - 1)) / 3 AS cell", "/ (dd - 1) * 3) / 6 AS cell")


@register("lattice_weighted", f"WITH {WEIGHTED} SELECT {SCORE}, suppressed <= 0.05 * rows AS valid FROM scored")
def lattice_weighted(spark, sf):
    d = definition(spark, sf, weights={"n_name": 2.0, "o_orderdate": 3.0})
    return rounded(L.scores(people(spark, sf), d, [P.KAnonymity(10)], suppression=0.05), ["loss"])


@register("lattice_alphabet", """WITH c AS (SELECT c_mktsegment, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code FROM customer),
  cls AS (SELECT a, b, CASE WHEN a = 1 THEN '*' ELSE c_mktsegment END AS g1, substr(code, 1, 6 - CAST(b AS INTEGER)) AS g2, count(*) AS n FROM c, range(2) t(a), range(7) u(b) GROUP BY ALL),
  sc AS (SELECT a, b, sum(n) AS rows, coalesce(sum(n) FILTER (n < 3), 0) AS suppressed, count(*) FILTER (n >= 3) AS classes, sum(n * CASE WHEN n >= 3 THEN (a + (pow(10e0, b) - 1) / 999999) / 2 ELSE 1 END) / sum(n) AS loss FROM cls GROUP BY a, b)
  SELECT a || ',' || b AS node, CAST(a + b AS INTEGER) AS level, CAST(rows AS BIGINT) AS rows, CAST(suppressed AS BIGINT) AS suppressed, classes, round(loss, 6) AS loss, suppressed <= 0.5 * rows AS valid FROM sc""")
def lattice_alphabet(spark, sf):
    """Customer codes masked digit by digit, where each digit stands for ten."""
    d = definition(spark, sf, qid=("c_mktsegment", "code"), hierarchies={"code": H.redaction(6, alphabet=10)})
    rows = table(spark, sf, "customer").withColumn("code", F.lpad(F.col("c_custkey").cast("string"), 6, "0"))
    return rounded(L.scores(rows, d, [P.KAnonymity(3)], suppression=0.5), ["loss"])


@register("node_output", f"WITH {PEOPLE} SELECT 'bottom' AS node, o_orderkey, n_name, c_mktsegment, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM people UNION ALL SELECT 'chosen', o_orderkey, r_name, c_mktsegment, strftime(o_orderdate, '%Y-%m') FROM people UNION ALL SELECT 'top', o_orderkey, '*', '*', '*' FROM people")
def node_output(spark, sf):
    """The table at the bottom, the top and one chosen node of the lattice."""
    d, rows = definition(spark, sf), people(spark, sf)
    picks = {"bottom": (0, 0, 0), "chosen": (1, 0, 1), "top": d.heights}
    parts = [
        H.generalize(rows, d, dict(zip(QID, at))).select(F.lit(name).alias("node"), "o_orderkey", *QID) for name, at in picks.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("suppress_classes", f"WITH {PUB} SELECT o_orderkey, {QKEY} FROM pub")
def suppress_classes(spark, sf):
    return A.suppress(generalized(spark, sf), QID, [P.KAnonymity(10)]).select("o_orderkey", *QID)


@register("post_sample", f"WITH {GEN}, low AS (SELECT * REPLACE (r_name AS n_name) FROM gen), pub AS (SELECT * EXCLUDE (cn) REPLACE (CASE WHEN cn < 10 THEN '*' ELSE n_name END AS n_name, CASE WHEN cn < 10 THEN '*' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN cn < 10 THEN '*' ELSE o_orderdate END AS o_orderdate) FROM (SELECT *, count(*) OVER (PARTITION BY {QKEY}) AS cn FROM low)){strat_cte(0.1)} SELECT o_orderkey, {QKEY} FROM samp")
def post_sample(spark, sf):
    """A node read from the statistics of a run, applied again, then sampled."""
    d = definition(spark, sf)
    low, path = {**NODE, "n_name": 1}, scratch_path(spark, "run-stats")
    first = A.publish(people(spark, sf), d, low, [P.KAnonymity(10)])
    IO.write_stats(A.run_stats(first, d, low), path)
    run = IO.read_stats(spark, path).select("QID", "node").first()
    output = materialize(A.publish(people(spark, sf), d, dict(zip(run["QID"], run["node"], strict=True)), [P.KAnonymity(10)]), "published")
    return S.stratified_sample(output, QID, 0.1, ID, SEED).select("o_orderkey", *QID)


FOLD_ROWS = LATTICE + f""", fo AS (SELECT o_orderkey, ntile(10) OVER (ORDER BY md5('7|' || o_orderkey)) - 1 AS own FROM people),
  base AS (SELECT n_name, c_mktsegment, o_orderdate, o_orderpriority AS v, CAST(fold AS INTEGER) AS fold, count(*) AS cnt FROM rows_ JOIN fo USING (o_orderkey), range(10) f(fold) WHERE fold <> own GROUP BY ALL),
  wide AS (SELECT fold, a, b, c, nlv[a + 1] AS g1, slv[b + 1] AS g2, dlv[c + 1] AS g3, v, cnt,
    ((CAST(nlf[a + 1] AS DOUBLE) - 1) / (nd - 1) + (CAST(slf[b + 1] AS DOUBLE) - 1) / (sd - 1) + (CAST(dlf[c + 1] AS DOUBLE) - 1) / (dd - 1)) / 3 AS cell
    FROM base JOIN nl USING (n_name) JOIN sl USING (c_mktsegment) JOIN dl ON d = o_orderdate, nodes),
  pv AS (SELECT fold, a, b, c, g1, g2, g3, v, sum(cnt) AS m, max(cell) AS cell FROM wide GROUP BY ALL),
  cls AS (SELECT fold, a, b, c, g1, g2, g3, sum(m) AS n, max(cell) AS cell, ln(sum(m)) - sum(m * ln(m)) / sum(m) AS entropy FROM pv GROUP BY fold, a, b, c, g1, g2, g3)"""


def _grid_best(params: str, names: str, ok: str) -> str:
    return FOLD_ROWS + f""", sc AS (SELECT fold, {names}, a || ',' || b || ',' || c AS node, a + b + c AS level, CAST(sum(n) AS BIGINT) AS input_size, CAST(coalesce(sum(n) FILTER (NOT ({ok})), 0) AS BIGINT) AS suppressed,
      count(*) FILTER ({ok}) AS classes, sum(n * CASE WHEN {ok} THEN cell ELSE 1e0 END) / sum(n) AS loss FROM cls, {params} GROUP BY fold, {names}, a, b, c),
    best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY fold, {names} ORDER BY round(loss, 9), level, node) = 1)"""


KGRID = _grid_best("(SELECT CAST(k AS INTEGER) AS k FROM (VALUES (5), (20), (100)) v(k))", "k", "n >= k")
KLGRID = _grid_best("(SELECT CAST(k AS INTEGER) AS k, CAST(l AS DOUBLE) AS l FROM (VALUES (5), (100)) v(k), (VALUES (2.0), (4.5), (6.0)) w(l))", "k, l", "n >= k AND entropy >= ln(l) - 1e-9")
BESTCOLS = "node, input_size, suppressed, classes, round(loss, 6) AS loss, input_size - suppressed AS sample_size, round(CASE WHEN classes > 0 THEN CAST(input_size - suppressed AS DOUBLE) / classes END, 6) AS avg_size"


def folded(spark, sf):
    return S.k_fold(people(spark, sf).select("o_orderkey", *QID, TARGET, "o_orderpriority"), FOLDS, ID, SEED)


def kanon(spark, sf):
    return A.grid_search(folded(spark, sf), definition(spark, sf), FOLDS, [5, 20, 100])


def kl(spark, sf):
    return A.grid_search(folded(spark, sf), definition(spark, sf), FOLDS, [5, 100], [2.0, 4.5, 6.0], "o_orderpriority")


@register("kanon_grid", f"WITH {KGRID} SELECT fold, k, {BESTCOLS} FROM best")
def kanon_grid(spark, sf):
    return rounded(kanon(spark, sf), ["loss", "avg_size"])


@register("kl_grid", f"WITH {KLGRID} SELECT fold, k, l, {BESTCOLS} FROM best")
def kl_grid(spark, sf):
    return rounded(kl(spark, sf), ["loss", "avg_size"])


def _fmt(c: str) -> str:
    one = lambda x: f"CASE WHEN {x} IS NULL THEN 'nan' ELSE printf('%.1f', round_even({x}, 1)) END"
    return one(f"avg({c})") + " || ' ± ' || " + one(f"stddev_samp({c})")


@register("generalization_stats", f"""WITH {KGRID}, r AS (SELECT *, input_size - suppressed AS sample_size, CAST(input_size - suppressed AS DOUBLE) / classes AS avg_size FROM best)
  SELECT k, node, count(*) AS n_runs, {_fmt('suppressed')} AS suppressed_cnt, {_fmt('sample_size')} AS sample_size, {_fmt('classes')} AS eq_cnt, {_fmt('avg_size')} AS avg_eq_size FROM r GROUP BY k, node""")
def generalization_stats(spark, sf):
    return T.generalization_stats(kanon(spark, sf))


@register("empty_sample_matrix", f"WITH {KLGRID} SELECT k, count(*) FILTER (l = 2.0 AND input_size = suppressed) AS l_2_0, count(*) FILTER (l = 4.5 AND input_size = suppressed) AS l_4_5, count(*) FILTER (l = 6.0 AND input_size = suppressed) AS l_6_0 FROM best GROUP BY k")
def empty_sample_matrix(spark, sf):
    """Per (k, l): how many folds were suppressed altogether."""
    return T.matrix(kl(spark, sf), "k", "l", [2.0, 4.5, 6.0], F.count_if(F.col("sample_size") == 0))


@register("suppressed_matrix", f"WITH {KLGRID} SELECT k, round(avg(suppressed) FILTER (l = 2.0), 6) AS l_2_0, round(avg(suppressed) FILTER (l = 4.5), 6) AS l_4_5, round(avg(suppressed) FILTER (l = 6.0), 6) AS l_6_0 FROM best GROUP BY k")
def suppressed_matrix(spark, sf):
    out = T.matrix(kl(spark, sf), "k", "l", [2.0, 4.5, 6.0], F.avg("suppressed"))
    return rounded(out, ["l_2_0", "l_4_5", "l_6_0"])


# --------------------------------------------------------------- privacy models

PRIO = GEN + f", pv AS (SELECT {QKEY}, o_orderpriority AS v, count(*) AS c FROM gen GROUP BY ALL), tot AS (SELECT v, sum(c) AS q, sum(sum(c)) OVER () AS t FROM pv GROUP BY v)"


def judged(spark, sf, models, rows=None):
    out = P.check(generalized(spark, sf) if rows is None else rows, QID, models)
    values = [c for c in out.columns if c.startswith("value_")]
    return rounded(out.select(*QID, "n", *values, "ok"), values)


@register("check_kanon", f"WITH {GEN} SELECT {QKEY}, count(*) AS n, count(*) >= 10 AS ok FROM gen GROUP BY {QKEY}")
def check_kanon(spark, sf):
    return judged(spark, sf, [P.KAnonymity(10)])


@register("check_ldiv_distinct", f"WITH {GEN} SELECT {QKEY}, count(*) AS n, count(DISTINCT o_orderpriority) AS value_0, count(DISTINCT o_orderpriority) >= 5 AS ok FROM gen GROUP BY {QKEY}")
def check_ldiv_distinct(spark, sf):
    return judged(spark, sf, [P.DistinctLDiversity("o_orderpriority", 5)])


@register("check_ldiv_entropy", f"WITH {PRIO} SELECT {QKEY}, CAST(sum(c) AS BIGINT) AS n, round(ln(sum(c)) - sum(c * ln(c)) / sum(c), 6) AS value_0, ln(sum(c)) - sum(c * ln(c)) / sum(c) >= ln(4.0) - 1e-9 AS ok FROM pv GROUP BY {QKEY}")
def check_ldiv_entropy(spark, sf):
    return judged(spark, sf, [P.EntropyLDiversity("o_orderpriority", 4.0)])


@register("check_ldiv_recursive", f"""WITH {PRIO}, r AS (SELECT *, row_number() OVER (PARTITION BY {QKEY} ORDER BY c DESC, v) AS r FROM pv)
  SELECT {QKEY}, CAST(sum(c) AS BIGINT) AS n, round(3e0 * coalesce(sum(c) FILTER (r >= 4), 0) - max(c), 6) AS value_0, 3e0 * coalesce(sum(c) FILTER (r >= 4), 0) - max(c) > 1e-9 AS ok FROM r GROUP BY {QKEY}""")
def check_ldiv_recursive(spark, sf):
    return judged(spark, sf, [P.RecursiveCLDiversity("o_orderpriority", 3.0, 4)])


URGENCY = {"1-URGENT": "soon", "2-HIGH": "soon", "3-MEDIUM": "later", "4-NOT SPECIFIED": "later", "5-LOW": "later"}


def urgency() -> Hierarchy:
    pairs = F.create_map(*[F.lit(x) for kv in URGENCY.items() for x in kv])
    return Hierarchy.functional(lambda c: pairs[c], lambda c: F.lit("*"))


@register("check_tclose_ordered", f"""WITH {PRIO}, grid AS (SELECT {QKEY}, v, q / t AS q FROM (SELECT DISTINCT {QKEY} FROM pv), tot),
  d AS (SELECT {QKEY}, v, coalesce(c, 0) / sum(coalesce(c, 0)) OVER (PARTITION BY {QKEY}) - q AS x, coalesce(c, 0) AS c FROM grid LEFT JOIN pv USING ({QKEY}, v)),
  s AS (SELECT *, sum(x) OVER (PARTITION BY {QKEY} ORDER BY v) AS run FROM d)
  SELECT {QKEY}, CAST(sum(c) AS BIGINT) AS n, round(sum(abs(run)) / (count(*) - 1), 6) AS value_0, sum(abs(run)) / (count(*) - 1) <= 0.1 + 1e-9 AS ok FROM s GROUP BY {QKEY}""")
def check_tclose_ordered(spark, sf):
    return judged(spark, sf, [P.OrderedTCloseness("o_orderpriority", 0.1)])


@register("check_tclose_hier", f"""WITH {PRIO}, grid AS (SELECT {QKEY}, v, CASE WHEN v < '3' THEN 'soon' ELSE 'later' END AS u, q / t AS q FROM (SELECT DISTINCT {QKEY} FROM pv), tot),
  d AS (SELECT {QKEY}, u, coalesce(c, 0) / sum(coalesce(c, 0)) OVER (PARTITION BY {QKEY}) - q AS x, coalesce(c, 0) AS c FROM grid LEFT JOIN pv USING ({QKEY}, v)),
  u AS (SELECT {QKEY}, u, sum(c) AS c, least(sum(greatest(x, 0)), sum(greatest(-x, 0))) / 2 AS cost, sum(x) AS x FROM d GROUP BY {QKEY}, u),
  e AS (SELECT {QKEY}, CAST(sum(c) AS BIGINT) AS n, sum(cost) + least(sum(greatest(x, 0)), sum(greatest(-x, 0))) AS e FROM u GROUP BY {QKEY})
  SELECT {QKEY}, n, round(e, 6) AS value_0, e <= 0.2 + 1e-9 AS ok FROM e""")
def check_tclose_hier(spark, sf):
    return judged(spark, sf, [P.HierarchicalTCloseness("o_orderpriority", 0.2, urgency())])


PRICED = GEN + f""", val AS (SELECT {QKEY}, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS v FROM gen),
  pv AS (SELECT {QKEY}, v, count(*) AS c FROM val GROUP BY ALL),
  tv AS (SELECT v, row_number() OVER (ORDER BY v NULLS FIRST) AS i, sum(c) OVER (ORDER BY v NULLS FIRST ROWS UNBOUNDED PRECEDING) AS cum, sum(c) OVER () AS t, count(*) OVER () AS m FROM (SELECT v, count(*) AS c FROM val GROUP BY v)),
  cls AS (SELECT {QKEY}, sum(c) AS n FROM pv GROUP BY ALL),
  own AS (SELECT {QKEY}, tv.i, sum(c) OVER (PARTITION BY {QKEY} ORDER BY tv.i ROWS UNBOUNDED PRECEDING) AS run FROM pv JOIN tv ON pv.v IS NOT DISTINCT FROM tv.v),
  grid AS (SELECT {QKEY}, n, i, cum / t AS q, m FROM cls, tv),
  walk AS (SELECT g.*, coalesce(o.run, 0) / n AS p FROM grid g ASOF LEFT JOIN own o ON g.n_name = o.n_name AND g.c_mktsegment = o.c_mktsegment AND g.o_orderdate = o.o_orderdate AND g.i >= o.i)"""


def many_valued(spark, sf):
    """Prices as sensitive values: nearly as many as rows, some of them missing."""
    price = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice"))
    return generalized(spark, sf).withColumn("price", price)


@register("check_tclose_price", f"""WITH {PRICED} SELECT {QKEY}, CAST(max(n) AS BIGINT) AS n, round(sum(abs(p - q)) / (max(m) - 1), 6) AS value_0, sum(abs(p - q)) / (max(m) - 1) <= 0.1 + 1e-9 AS ok FROM walk GROUP BY {QKEY}""")
def check_tclose_price(spark, sf):
    return judged(spark, sf, [P.OrderedTCloseness("price", 0.1)], many_valued(spark, sf))


NULLED = GEN + f""", val AS (SELECT {QKEY}, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS v FROM gen),
  pv AS (SELECT {QKEY}, v, count(*) AS c FROM val GROUP BY ALL), tot AS (SELECT v, count(*) AS q, (SELECT count(*) FROM val) AS t FROM val GROUP BY v)"""


@register("check_tclose_null", f"""WITH {NULLED}, grid AS (SELECT {QKEY}, v, CASE WHEN v IS NULL THEN '?' WHEN v < '3' THEN 'soon' ELSE 'later' END AS u, q / t AS q FROM (SELECT DISTINCT {QKEY} FROM pv), tot),
  d AS (SELECT g.{QKEY.replace(', ', ', g.')}, u, coalesce(c, 0) / sum(coalesce(c, 0)) OVER (PARTITION BY g.{QKEY.replace(', ', ', g.')}) - q AS x, coalesce(c, 0) AS c FROM grid g LEFT JOIN pv ON pv.n_name = g.n_name AND pv.c_mktsegment = g.c_mktsegment AND pv.o_orderdate = g.o_orderdate AND pv.v IS NOT DISTINCT FROM g.v),
  u AS (SELECT {QKEY}, u, sum(c) AS c, least(sum(greatest(x, 0)), sum(greatest(-x, 0))) / 2 AS cost, sum(x) AS x FROM d GROUP BY {QKEY}, u),
  e AS (SELECT {QKEY}, CAST(sum(c) AS BIGINT) AS n, sum(cost) + least(sum(greatest(x, 0)), sum(greatest(-x, 0))) AS e FROM u GROUP BY {QKEY})
  SELECT {QKEY}, n, round(e, 6) AS value_0, e <= 0.2 + 1e-9 AS ok FROM e""")
def check_tclose_null(spark, sf):
    """A missing priority is a leaf of its own."""
    rows = generalized(spark, sf).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")))
    return judged(spark, sf, [P.HierarchicalTCloseness("o_orderpriority", 0.2, urgency())], rows)


SUB = f"{GEN}, {RETURNED}, m AS (SELECT gen.*, r.o_orderkey IS NOT NULL AS inside FROM gen LEFT JOIN returned r ON r.o_orderkey = gen.o_orderkey)"


def marked(spark, sf):
    return X.mark_subset(generalized(spark, sf), returned(spark, sf), "o_orderkey")


@register("check_dpresence", f"WITH {SUB} SELECT {QKEY}, count(*) AS n, round(avg(inside::INTEGER), 6) AS value_0, avg(inside::INTEGER) BETWEEN 0.5 - 1e-9 AND 0.8 + 1e-9 AS ok FROM m GROUP BY {QKEY}")
def check_dpresence(spark, sf):
    return judged(spark, sf, [P.DPresence(0.5, 0.8)], marked(spark, sf))


@register("check_kmap", f"WITH {SUB} SELECT {QKEY}, count(*) AS n, count(*) FILTER (inside) AS value_0, count(*) FILTER (inside) = 0 OR count(*) >= 10 AS ok FROM m GROUP BY {QKEY}")
def check_kmap(spark, sf):
    return judged(spark, sf, [P.KMap(10)], marked(spark, sf))


@register("check_inclusion", f"WITH {SUB} SELECT {QKEY}, count(*) AS n, count(*) FILTER (inside) AS value_0, count(*) FILTER (inside) > 0 AS ok FROM m GROUP BY {QKEY}")
def check_inclusion(spark, sf):
    return judged(spark, sf, [P.Inclusion()], marked(spark, sf))


# P(N < 50) for a Poisson variable N of rate n / 0.5 falls to 0.1 or less from n = 30 on.
@register("check_kmap_est", f"WITH {GEN} SELECT {QKEY}, count(*) AS n, count(*) >= 30 AS ok FROM gen GROUP BY {QKEY}")
def check_kmap_est(spark, sf):
    return judged(spark, sf, [P.KMapEstimated(50, 0.1, 0.5)])


@register("check_avg_risk", f"WITH {PUB}, c AS (SELECT {QKEY}, count(*) AS n FROM pub WHERE NOT (n_name = '*' AND c_mktsegment = '*' AND o_orderdate = '*') GROUP BY ALL) SELECT count(*) AS classes, CAST(sum(n) AS BIGINT) AS records, round(count(*) / sum(n), 6) AS risk, count(*) / sum(n) <= 0.06 + 1e-9 AS ok FROM c")
def check_avg_risk(spark, sf):
    from cloakframe.operators.classes import class_summary

    s = class_summary(published(spark, sf), QID)
    model = P.AverageReidentificationRisk(0.06)
    return s.select(
        "classes", F.col("sample_size").alias("records"), F.round(F.col("classes") / F.col("sample_size"), 6).alias("risk"),
        P.table_predicate([model], F.col("classes"), F.col("sample_size")).alias("ok"))


@register("check_combined", f"""WITH {SUB}, pv AS (SELECT {QKEY}, o_orderpriority AS v, count(*) AS c FROM m GROUP BY ALL), e AS (SELECT {QKEY}, CAST(sum(c) AS BIGINT) AS n, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM pv GROUP BY {QKEY}),
  s AS (SELECT {QKEY}, count(DISTINCT o_orderstatus) AS d, count(*) FILTER (inside) AS i FROM m GROUP BY {QKEY})
  SELECT {QKEY}, n, round(h, 6) AS value_1, d AS value_2, i AS value_3, n >= 10 AND h >= ln(4.0) - 1e-9 AND d >= 3 AND (i = 0 OR n >= 12) AS ok FROM e JOIN s USING ({QKEY})""")
def check_combined(spark, sf):
    """Several models and two sensitive attributes at once."""
    models = [P.KAnonymity(10), P.EntropyLDiversity("o_orderpriority", 4.0), P.DistinctLDiversity("o_orderstatus", 3), P.KMap(12)]
    return judged(spark, sf, models, marked(spark, sf))


INFO = f"""{LATTICE}, s AS (SELECT (ln(CAST(dlf[4] AS DOUBLE))) / (ln(CAST(nd AS DOUBLE)) + ln(CAST(sd AS DOUBLE)) + ln(CAST(dd AS DOUBLE))) AS info, n_name, c_mktsegment, CAST(year(o_orderdate) AS VARCHAR) AS o_orderdate, o_orderkey
  FROM rows_ JOIN nl USING (n_name) JOIN sl USING (c_mktsegment) JOIN dl ON d = o_orderdate)"""
COST_ITEMS = (("adversary_cost", 20.0), ("adversary_gain", 300.0), ("publisher_loss", 12000.0), ("publisher_benefit", 1200.0))
ATTACK = "300e0 / n > 20e0"
GAIN = f"CASE WHEN {ATTACK} THEN 1200e0 * (1 - info) - 12000e0 / n ELSE 1200e0 * (1 - info) END"


def priced(spark, sf, subset=False):
    """Generalized rows with the information their class has lost at this node."""
    d = definition(spark, sf)
    rows = people(spark, sf)
    wide = L.expanded(L.prepare(rows, d), d, [tuple(NODE.values())])
    loss = wide.groupBy(*[F.col(f"g_{q}").alias(q) for q in QID]).agg(F.max("info_loss").alias("info_loss"))
    out = null_safe(marked(spark, sf) if subset else generalized(spark, sf), loss, QID)
    return out


def profit(spark, sf, no_attack, subset):
    model = P.Profitability(COST_ITEMS, no_attack, "in_subset" if subset else None)
    return P.check(priced(spark, sf, subset), QID, [model]).select(*QID, "n", "ok")


@register("profit_prosecutor", f"WITH {INFO}, c AS (SELECT {QKEY}, count(*) AS n, max(info) AS info FROM s GROUP BY {QKEY}) SELECT {QKEY}, n, {GAIN} > 0 AS ok FROM c")
def profit_prosecutor(spark, sf):
    return profit(spark, sf, False, False)


@register("profit_prosecutor_noattack", f"WITH {INFO}, c AS (SELECT {QKEY}, count(*) AS n FROM s GROUP BY {QKEY}) SELECT {QKEY}, n, NOT ({ATTACK}) AS ok FROM c")
def profit_prosecutor_noattack(spark, sf):
    return profit(spark, sf, True, False)


@register("profit_journalist", f"WITH {INFO}, {RETURNED}, c AS (SELECT {QKEY}, count(*) AS n, max(info) AS info, count(r.o_orderkey) AS i FROM s LEFT JOIN returned r ON r.o_orderkey = s.o_orderkey GROUP BY {QKEY}) SELECT {QKEY}, n, {GAIN.replace('info', 'CASE WHEN i > 0 THEN info ELSE 0 END')} > 0 AS ok FROM c")
def profit_journalist(spark, sf):
    return profit(spark, sf, False, True)


@register("profit_journalist_noattack", f"WITH {INFO}, c AS (SELECT {QKEY}, count(*) AS n FROM s GROUP BY {QKEY}) SELECT {QKEY}, n, NOT ({ATTACK}) AS ok FROM c")
def profit_journalist_noattack(spark, sf):
    return profit(spark, sf, True, True)


# Fixed values for epsilon 1 and delta 1e-4: rate 1 - 1/e, least class size 47.
@register("dp_independent", f"""WITH {PEOPLE}, g AS (SELECT o_orderkey, r_name AS n_name, '*' AS c_mktsegment, quarter(o_orderdate) || '/' || year(o_orderdate) AS o_orderdate FROM people
    WHERE CAST('0x' || substr(md5('7|' || o_orderkey), 1, 8) AS BIGINT) / 4294967296e0 < 1 - exp(-1e0))
  SELECT o_orderkey, CASE WHEN n < 47 THEN '*' ELSE n_name END AS n_name, CASE WHEN n < 47 THEN '*' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN n < 47 THEN '*' ELSE o_orderdate END AS o_orderdate
  FROM (SELECT *, count(*) OVER (PARTITION BY {QKEY}) AS n FROM g)""")
def dp_independent(spark, sf):
    d = definition(spark, sf)
    return DP.publish_dp(people(spark, sf), d, DP.medium_node(d), 1.0, 1e-4, ID, SEED).select("o_orderkey", *QID)


DP_SQL = lattice_sql(model="n >= 47").replace("FROM people),\n  dl AS", "FROM people WHERE CAST('0x' || substr(md5('7|' || o_orderkey), 1, 8) AS BIGINT) / 4294967296e0 < 1 - exp(-1e0)),\n  dl AS")


@register("dp_dependent", f"""WITH {DP_SQL}, u AS (SELECT *, greatest(CAST('0x' || substr(md5('7|node|' || node), 1, 8) AS BIGINT) / 4294967296e0, 1e-12) AS u FROM scored)
  SELECT node, CAST(level AS INTEGER) AS level, rows, suppressed, classes, round(loss, 6) AS loss FROM u ORDER BY 0.1e0 / 94 * (1 - u.loss) * rows - ln(-ln(u)) DESC, node DESC LIMIT 1""")
def dp_dependent(spark, sf):
    """The node is drawn by the exponential mechanism."""
    chosen = DP.choose_node(people(spark, sf), definition(spark, sf), 1.1, 1e-4, 0.1, ID, SEED)
    return rounded(chosen.select("node", "level", "rows", "suppressed", "classes", "loss"), ["loss"])


# ------------------------------------------------------------- microaggregation

MKEY = "n_name, c_mktsegment, o_orderdate"


def cents(rows):
    """Whole cents, whose sums are exact in any order."""
    return rows.withColumn("cents", F.round(F.col("o_totalprice") * 100))


def micro(spark, sf, how, column="o_totalprice"):
    rows = cents(generalized(spark, sf))
    return A.microaggregate(rows, QID, column, how, "price").select("o_orderkey", F.round("price", 4).alias("price"))


@register("microagg_mean", f"WITH {GEN} SELECT o_orderkey, round(avg(round(o_totalprice * 100)) OVER (PARTITION BY {MKEY}), 4) AS price FROM gen")
def microagg_mean(spark, sf):
    return micro(spark, sf, "mean", "cents")


@register("microagg_geomean", f"WITH {GEN} SELECT o_orderkey, round(exp(avg(ln(o_totalprice)) OVER (PARTITION BY {MKEY})), 4) AS price FROM gen")
def microagg_geomean(spark, sf):
    return micro(spark, sf, "geomean")


@register("microagg_median", f"WITH {GEN} SELECT o_orderkey, round(quantile_cont(o_totalprice, 0.5) OVER (PARTITION BY {MKEY}), 4) AS price FROM gen")
def microagg_median(spark, sf):
    return micro(spark, sf, "median")


@register("microagg_mode", f"""WITH {GEN}, c AS (SELECT {MKEY}, floor(o_totalprice / 10000) AS p, count(*) AS k FROM gen GROUP BY ALL),
  m AS (SELECT {MKEY}, p FROM c QUALIFY row_number() OVER (PARTITION BY {MKEY} ORDER BY k DESC, p) = 1)
  SELECT o_orderkey, CAST(m.p AS BIGINT) AS price FROM gen JOIN m USING ({MKEY})""")
def microagg_mode(spark, sf):
    """Prices in units of 10000, so that values repeat."""
    rows = generalized(spark, sf).withColumn("p", F.floor(F.col("o_totalprice") / 10000))
    return A.microaggregate(rows, QID, "p", "mode", "price").select("o_orderkey", "price")


@register("microagg_generalized", f"WITH {PUB} SELECT o_orderkey, {QKEY}, round(avg(round(o_totalprice * 100)) OVER (PARTITION BY {MKEY}), 4) AS price FROM pub")
def microagg_generalized(spark, sf):
    out = A.microaggregate(cents(published(spark, sf)), QID, "cents", "mean", "price")
    return out.select("o_orderkey", *QID, F.round("price", 4).alias("price"))


# ------------------------------------------------------ recoding, greedy searches


@register("local_recoding")
def local_recoding(spark, sf):
    d = definition(spark, sf)
    return A.local_recoding(people(spark, sf), d, [P.KAnonymity(10)], 0.1).select("o_orderkey", *QID, "round")


@register("greedy_bottom_up")
def greedy_bottom_up(spark, sf):
    return A.greedy(people(spark, sf), definition(spark, sf), [P.KAnonymity(10)], suppression=0.05)


@register("greedy_top_down")
def greedy_top_down(spark, sf):
    return A.greedy(people(spark, sf), definition(spark, sf), [P.KAnonymity(10)], suppression=0.05, top_down=True)


