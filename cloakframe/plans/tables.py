"""The tables all registered queries start from, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.definition import Definition, Hierarchy
from cloakframe.operators import anonymize as A
from cloakframe.operators import hierarchies as H
from cloakframe.operators import sampling as S
from cloakframe.operators.privacy import KAnonymity
from cloakframe.session import materialize

SEED = 7
ID = ["o_orderkey"]
QID = ("n_name", "c_mktsegment", "o_orderdate")
TARGET = "price_bin"
NODE = {"n_name": 0, "c_mktsegment": 0, "o_orderdate": 3}
K = 10
FOLDS = 10


# Stated so that reading a table needs no job to infer its schema.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def people(spark: SparkSession, sf: str) -> DataFrame:
    """One line per order with who ordered where."""
    price = F.col("o_totalprice")
    bins = (
        F.when(price < 50000, "[0-50000[").when(price < 200000, "[50000-200000[").otherwise("[200000-inf[")
    )
    return (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "o_orderkey", "c_name", "n_name", "r_name", "c_mktsegment",
            F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_totalprice",
            bins.alias("price_bin"), "o_orderpriority", "o_orderstatus",
        )
    )


def nations(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_name", "r_name", F.lit("*").alias("top"))


def definition(spark: SparkSession, sf: str, **changes) -> Definition:
    roles = {
        "qid": QID,
        "hierarchies": {
            "n_name": Hierarchy.from_columns(nations(spark, sf), ["n_name", "r_name", "top"]),
            "c_mktsegment": Hierarchy.trivial(),
            "o_orderdate": H.dates(["month", "quarter_year", "year"]),
        },
        "identifying": ("c_name",),
        "sensitive": ("o_orderpriority",),
        "target": TARGET,
    }
    return Definition(**{**roles, **changes})


def generalized(spark: SparkSession, sf: str) -> DataFrame:
    """``people`` at nation, segment and year."""
    return H.generalize(people(spark, sf), definition(spark, sf), NODE)


def published(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    """The k-anonymous table as a written output, which samples and reports then read."""
    return materialize(A.suppress(generalized(spark, sf), QID, [KAnonymity(k)]), "published")


def sample(spark: SparkSession, sf: str, b: float = 0.2) -> DataFrame:
    return S.stratified_sample(published(spark, sf), QID, b, ID, SEED)


def returned(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a returned item: the research subset."""
    lines = table(spark, sf, "lineitem").filter("l_returnflag = 'R'")
    return lines.select(F.col("l_orderkey").alias("o_orderkey")).distinct()


# ------------------------------------------------------------------------- SQL

PEOPLE = """people AS (
  SELECT o_orderkey, c_name, n_name, r_name, c_mktsegment, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice,
    CASE WHEN o_totalprice < 50000 THEN '[0-50000[' WHEN o_totalprice < 200000 THEN '[50000-200000[' ELSE '[200000-inf[' END AS price_bin,
    o_orderpriority, o_orderstatus
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey)"""

GEN = PEOPLE + """, gen AS (
  SELECT * REPLACE (CAST(year(o_orderdate) AS VARCHAR) AS o_orderdate) FROM people)"""


def pub_cte(k: int = K, name: str = "pub", source: str = "gen") -> str:
    return f""", {name} AS (
  SELECT * EXCLUDE (cn) REPLACE (CASE WHEN cn < {k} THEN '*' ELSE n_name END AS n_name,
    CASE WHEN cn < {k} THEN '*' ELSE c_mktsegment END AS c_mktsegment,
    CASE WHEN cn < {k} THEN '*' ELSE o_orderdate END AS o_orderdate)
  FROM (SELECT *, count(*) OVER (PARTITION BY n_name, c_mktsegment, o_orderdate) AS cn FROM {source}))"""


PUB = GEN + pub_cte()


def strat_cte(b: float, name: str = "samp", source: str = "pub") -> str:
    return f""", {name} AS (
  SELECT * EXCLUDE (h, j, cn, ch) FROM (
    SELECT *, row_number() OVER (PARTITION BY n_name, c_mktsegment, o_orderdate ORDER BY h, o_orderkey) AS j,
      count(*) OVER (PARTITION BY n_name, c_mktsegment, o_orderdate) AS cn,
      md5(concat_ws('|', '7', n_name, c_mktsegment, o_orderdate)) AS ch
    FROM (SELECT *, md5('7|' || o_orderkey) AS h FROM {source}))
  QUALIFY row_number() OVER (ORDER BY CAST(j AS DOUBLE) / cn, ch, n_name, c_mktsegment, o_orderdate)
    <= (SELECT floor(count(*) * CAST({b} AS DOUBLE)) FROM {source}))"""


SAMPLE = PUB + strat_cte(0.2)
QKEY = "n_name, c_mktsegment, o_orderdate"
RETURNED = "returned AS (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_returnflag = 'R')"
