"""Samples, folds and balancing (§ sampling)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe.operators import classes as C
from cloakframe.operators import risk as R
from cloakframe.operators import sampling as S
from cloakframe.plans.registry import register
from cloakframe.plans.tables import (
    FOLDS, GEN, ID, PEOPLE, PUB, QID, QKEY, SAMPLE, SEED, TARGET,
    generalized, people, published, sample, strat_cte, table,
)

KEPT = "o_orderkey, n_name, c_mktsegment, o_orderdate, price_bin"
COLS = ["o_orderkey", "n_name", "c_mktsegment", "o_orderdate", "price_bin"]


@register("sample_random", f"""WITH {GEN} SELECT {KEPT} FROM gen
  QUALIFY row_number() OVER (ORDER BY md5('7|' || o_orderkey)) <= (SELECT floor(count(*) * CAST(0.1 AS DOUBLE)) FROM gen)""")
def sample_random(spark, sf):
    return S.random_sample(generalized(spark, sf), 0.1, ID, SEED).select(*COLS)


@register("sample_stratified", f"WITH {SAMPLE} SELECT {KEPT} FROM samp")
def sample_stratified(spark, sf):
    return sample(spark, sf).select(*COLS)


BALANCED = PUB + """, amounts AS (
  SELECT price_bin, count(*) AS amount FROM (
    SELECT price_bin FROM (SELECT price_bin, row_number() OVER (PARTITION BY price_bin ORDER BY o_orderkey) AS j FROM pub)
    QUALIFY row_number() OVER (ORDER BY j, md5('7|' || price_bin), price_bin) <= (SELECT floor(count(*) * CAST(0.5 AS DOUBLE)) FROM pub))
  GROUP BY price_bin), bal AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY price_bin, n_name, c_mktsegment, o_orderdate ORDER BY h, o_orderkey) AS j,
      count(*) OVER (PARTITION BY price_bin, n_name, c_mktsegment, o_orderdate) AS cn,
      md5(concat_ws('|', '7', price_bin, n_name, c_mktsegment, o_orderdate)) AS ch
    FROM (SELECT *, md5('7|' || o_orderkey) AS h FROM pub JOIN amounts USING (price_bin)))
  QUALIFY row_number() OVER (PARTITION BY price_bin ORDER BY CAST(j AS DOUBLE) / cn, ch, n_name, c_mktsegment, o_orderdate) <= amount)"""


@register("sample_balanced", f"WITH {BALANCED} SELECT {KEPT} FROM bal")
def sample_balanced(spark, sf):
    return S.balanced_sample(published(spark, sf), QID, TARGET, 0.5, ID, SEED).select(*COLS)


@register("sample_certainty_cap", f"""WITH {BALANCED}, live AS (SELECT * FROM bal WHERE NOT (n_name = '*' AND c_mktsegment = '*' AND o_orderdate = '*')),
  sn AS (SELECT {QKEY}, count(*) AS n FROM live GROUP BY ALL), pn AS (SELECT {QKEY}, count(*) AS np FROM pub GROUP BY ALL),
  quota AS (SELECT {QKEY}, CASE WHEN CAST(n AS DOUBLE) / np < CAST(0.5 AS DOUBLE) * CAST(1.1 AS DOUBLE) THEN n
    ELSE floor(n / (CAST(n AS DOUBLE) / np) * (CAST(0.5 AS DOUBLE) * CAST(1.1 AS DOUBLE))) END AS s FROM sn JOIN pn USING ({QKEY}))
  SELECT {KEPT} FROM (SELECT live.* EXCLUDE (j), row_number() OVER (PARTITION BY {QKEY} ORDER BY h, o_orderkey) AS j FROM live)
  JOIN quota USING ({QKEY}) WHERE j <= s""")
def sample_certainty_cap(spark, sf):
    population = published(spark, sf)
    drawn = S.balanced_sample(population, QID, TARGET, 0.5, ID, SEED)
    return S.certainty_cap(drawn, population, QID, 0.5, 0.1, ID, SEED).select(*COLS)


@register("kfold", f"""WITH {PEOPLE} SELECT o_orderkey, CAST(ntile(10) OVER (ORDER BY md5('7|' || o_orderkey)) - 1 AS INTEGER) AS fold FROM people""")
def kfold(spark, sf):
    return S.k_fold(people(spark, sf), FOLDS, ID, SEED).select("o_orderkey", "fold")


@register("train_test_split", f"""WITH {PEOPLE} SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('7|' || o_orderkey))
  <= (SELECT floor(count(*) * CAST(0.7 AS DOUBLE)) FROM people) THEN 'train' ELSE 'test' END AS split FROM people""")
def train_test_split(spark, sf):
    return S.train_test(people(spark, sf), 0.7, ID, SEED).select("o_orderkey", "split")


@register("undersample", f"""WITH {PEOPLE} SELECT o_orderkey, price_bin FROM people
  QUALIFY row_number() OVER (PARTITION BY price_bin ORDER BY md5('7|' || o_orderkey))
    <= (SELECT min(n) FROM (SELECT count(*) AS n FROM people GROUP BY price_bin))""")
def undersample(spark, sf):
    return S.undersample(people(spark, sf), TARGET, ID, SEED).select("o_orderkey", "price_bin")


@register("oversample", f"""WITH {PEOPLE}, r AS (SELECT o_orderkey, price_bin, row_number() OVER (PARTITION BY price_bin ORDER BY md5('7|' || o_orderkey)) AS rk FROM people),
  c AS (SELECT price_bin, count(*) AS n, max(count(*)) OVER () - count(*) AS deficit FROM people GROUP BY price_bin),
  d AS (SELECT price_bin, n, unnest(range(1, deficit + 1)) AS draw FROM c),
  p AS (SELECT price_bin, draw, CAST('0x' || substr(md5('7|' || price_bin || '|' || draw), 1, 15) AS BIGINT) % n + 1 AS rk FROM d)
  SELECT o_orderkey, price_bin, CAST(0 AS BIGINT) AS draw FROM people
  UNION ALL SELECT o_orderkey, price_bin, draw FROM p JOIN r USING (price_bin, rk)""")
def oversample(spark, sf):
    return S.oversample(people(spark, sf), TARGET, ID, SEED).select("o_orderkey", "price_bin", "draw")


@register("sample_pre_post", f"""WITH {GEN}{strat_cte(0.2, 'pre', 'gen')}, post_pub AS (
    SELECT * EXCLUDE (cn) REPLACE (CASE WHEN cn < 10 THEN '*' ELSE n_name END AS n_name, CASE WHEN cn < 10 THEN '*' ELSE c_mktsegment END AS c_mktsegment,
      CASE WHEN cn < 10 THEN '*' ELSE o_orderdate END AS o_orderdate)
    FROM (SELECT *, count(*) OVER (PARTITION BY {QKEY}) AS cn FROM gen)){strat_cte(0.2, 'post', 'post_pub')}
  SELECT CAST(coalesce(a.o_orderkey, b.o_orderkey) AS BIGINT) AS o_orderkey, a.o_orderkey IS NOT NULL AS in_pre, b.o_orderkey IS NOT NULL AS in_post
  FROM pre a FULL JOIN post b ON a.o_orderkey = b.o_orderkey""")
def sample_pre_post(spark, sf):
    """The same sampler on the input (pre) and on the published table (post)."""
    pre = S.stratified_sample(generalized(spark, sf), QID, 0.2, ID, SEED).select("o_orderkey", F.lit(True).alias("a"))
    post = sample(spark, sf).select("o_orderkey", F.lit(True).alias("b"))
    return pre.join(post, "o_orderkey", "full").select(
        "o_orderkey", F.coalesce("a", F.lit(False)).alias("in_pre"), F.coalesce("b", F.lit(False)).alias("in_post"))


@register("spread_equally", f"""WITH {GEN}, g AS (SELECT {QKEY}, concat_ws('/', {QKEY}) AS class FROM gen GROUP BY ALL), m AS (SELECT floor(count(*) * CAST(0.2 AS DOUBLE))::BIGINT AS m FROM gen)
  SELECT class, CAST(m // (SELECT count(*) FROM g) + CASE WHEN row_number() OVER (ORDER BY md5('7|' || class)) <= m % (SELECT count(*) FROM g) THEN 1 ELSE 0 END AS BIGINT) AS part FROM g, m""")
def spread_equally(spark, sf):
    rows = generalized(spark, sf)
    groups = rows.select(F.concat_ws("/", *QID).alias("class")).distinct()
    amount = rows.agg(S.sample_amount(F.count("*"), 0.2).alias("m")).scalar()
    return S.spread_equally(groups, "class", amount, SEED)


def published_and_drawn(spark, sf):
    """The published table, made once, and a sample of it."""
    output = published(spark, sf)
    return output, S.stratified_sample(output, QID, 0.2, ID, SEED)


@register("eq_before_after", f"""WITH {SAMPLE}, a AS (SELECT {QKEY}, count(*) AS n_before FROM pub GROUP BY ALL), b AS (SELECT {QKEY}, count(*) AS n_after FROM samp GROUP BY ALL)
  SELECT a.*, coalesce(n_after, 0) AS n_after FROM a LEFT JOIN b USING ({QKEY})""")
def eq_before_after(spark, sf):
    output, drawn = published_and_drawn(spark, sf)
    return C.before_after(output, drawn, QID)


@register("certainty", f"""WITH {SAMPLE}, a AS (SELECT {QKEY}, count(*) AS n FROM pub GROUP BY ALL), b AS (SELECT {QKEY}, count(*) AS m FROM samp GROUP BY ALL)
  SELECT o_orderkey, round(CAST(m AS DOUBLE) / n, 9) AS certainty FROM samp JOIN a USING ({QKEY}) JOIN b USING ({QKEY})""")
def certainty(spark, sf):
    output, drawn = published_and_drawn(spark, sf)
    out = R.certainty(drawn, output, QID)
    return out.select("o_orderkey", F.round("certainty", 9).alias("certainty"))


@register("journalist_risk", f"""WITH {SAMPLE}, a AS (SELECT {QKEY}, count(*) AS n FROM pub GROUP BY ALL)
  SELECT o_orderkey, CASE WHEN n_name = '*' AND c_mktsegment = '*' AND o_orderdate = '*' THEN 0.0 ELSE round(1e0 / n, 9) END::DOUBLE AS journalist_risk FROM samp JOIN a USING ({QKEY})""")
def journalist_risk(spark, sf):
    output, drawn = published_and_drawn(spark, sf)
    out = R.journalist_risk(drawn, output, QID)
    return out.select("o_orderkey", F.round("journalist_risk", 9).alias("journalist_risk"))


@register("sample_repeated_ids", """WITH s AS (SELECT l_orderkey FROM lineitem QUALIFY row_number() OVER (ORDER BY md5('7|' || l_orderkey)) <= (SELECT floor(count(*) * CAST(0.3 AS DOUBLE)) FROM lineitem))
  SELECT l_orderkey, count(*) AS n FROM s GROUP BY l_orderkey""")
def sample_repeated_ids(spark, sf):
    """Lines drawn per order where the id, the order, is not unique: the size is exact all the same."""
    drawn = S.random_sample(table(spark, sf, "lineitem"), 0.3, ["l_orderkey"], SEED)
    return drawn.groupBy("l_orderkey").agg(F.count("*").alias("n"))
