"""Sources, sinks, selection and cleansing."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe.operators import anonymize as A
from cloakframe.operators import classes as C
from cloakframe.operators import sampling as S
from cloakframe.operators import select as X
from cloakframe.plans.grids import SAMPLES, STATS, run_counts, samples
from cloakframe.plans.registry import register
from cloakframe.plans.tables import (
    FOLDS, GEN, ID, NODE, PEOPLE, PUB, QID, QKEY, RETURNED, SAMPLE, SEED, TARGET,
    definition, generalized, people, published, returned, table,
)
from cloakframe.session import scratch_path
from cloakframe.sources import files as IO

TEXT_COLS = ["o_orderkey", "n_name", "c_mktsegment", "o_orderdate", "o_totalprice", "price_bin"]
AS_TEXT = "CAST(o_orderkey AS VARCHAR) AS o_orderkey, n_name, c_mktsegment, CAST(o_orderdate AS VARCHAR) AS o_orderdate, CAST(o_totalprice AS VARCHAR) AS o_totalprice, price_bin"
STAR_ROW = "n_name = '*' AND c_mktsegment = '*' AND o_orderdate = '*'"


@register("scan_csv", f"WITH {PEOPLE} SELECT {AS_TEXT} FROM people")
def scan_csv(spark, sf):
    path = scratch_path(spark, "people-csv")
    IO.write_csv(people(spark, sf).select(TEXT_COLS), path)
    return IO.read_csv(spark, path, TEXT_COLS)


@register("scan_headerless", f"WITH {PEOPLE} SELECT {AS_TEXT} FROM people")
def scan_headerless(spark, sf):
    path = scratch_path(spark, "people-bare")
    IO.write_csv(people(spark, sf).select(TEXT_COLS), path, header=False)
    return IO.read_csv(spark, path, TEXT_COLS, header=False)


@register("scan_decimal_comma", f"WITH {PEOPLE} SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, replace(CAST(o_totalprice AS VARCHAR), '.', ',') AS price_text, o_totalprice FROM people")
def scan_decimal_comma(spark, sf):
    path = scratch_path(spark, "comma")
    IO.write_csv(IO.with_decimal_comma(people(spark, sf).select("o_orderkey", "o_totalprice"), ["o_totalprice"]), path)
    back = IO.read_csv(spark, path, ["o_orderkey", "o_totalprice"]).withColumn("price_text", F.col("o_totalprice"))
    return IO.from_decimal_comma(back, ["o_totalprice"])


@register("select_by_index_name_alias", "SELECT o_orderkey, o_orderpriority, CAST(o_totalprice AS VARCHAR) AS price, CAST(o_orderdate AS DATE) AS placed FROM orders")
def select_by_index_name_alias(spark, sf):
    picks = [(0,), ("o_orderpriority",), ("o_totalprice", "price", "string"), (4, "placed", "date")]
    return IO.pick_columns(table(spark, sf, "orders"), picks)


@register("stats_json_scan", f"""WITH {STATS} SELECT fold, k, '0,0,3' AS node, 'n_name,c_mktsegment,o_orderdate' AS qid,
  suppressed, sample_size, input_size, classes, round(avg_size, 6) AS avg_size FROM stats""")
def stats_json_scan(spark, sf):
    """Statistics of all (fold, k) runs, written as JSON and read back in one scan."""
    path = scratch_path(spark, "stats")
    IO.write_stats(A.run_stats(run_counts(spark, sf), definition(spark, sf), NODE, ["fold", "k"], "cnt"), path, ["fold", "k"])
    s = IO.read_stats(spark, path, f"{IO.STATS_SCHEMA}, fold int, k int")
    return s.select(
        "fold", "k", F.array_join(F.transform("node", lambda x: x.cast("string")), ",").alias("node"),
        F.array_join("QID", ",").alias("qid"), F.col("suppressed in sample").alias("suppressed"),
        F.col("sample size").alias("sample_size"), F.col("input size").alias("input_size"),
        F.col("equivalence classes").alias("classes"), F.round("average EQ size", 6).alias("avg_size"))


@register("hierarchy_dir_scan", """SELECT 'n_name' AS attribute, n_name AS value, n_name || ' > ' || r_name || ' > *' AS levels FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT DISTINCT 'c_mktsegment', c_mktsegment, c_mktsegment || ' > *' FROM customer""")
def hierarchy_dir_scan(spark, sf):
    folder = scratch_path(spark, "hierarchies")
    d = definition(spark, sf)
    customers = table(spark, sf, "customer")
    IO.write_hierarchy(d.hierarchy("n_name").table, f"{folder}/people_hierarchy_n_name.csv", 3)
    IO.write_hierarchy(d.hierarchy("c_mktsegment").materialize(customers, "c_mktsegment"), f"{folder}/people_hierarchy_c_mktsegment.csv", 2)
    return IO.read_hierarchy_dir(spark, folder, "people").withColumn("levels", F.array_join("levels", " > "))


@register("sample_roundtrip", f"WITH {SAMPLE} SELECT o_orderkey, {QKEY}, price_bin FROM samp")
def sample_roundtrip(spark, sf):
    """The row numbers of a sample, saved as text, pick the same rows again."""
    path = scratch_path(spark, "rows")
    output = published(spark, sf)
    IO.write_row_ids(S.stratified_sample(output, QID, 0.2, ID, SEED), "o_orderkey", path)
    return IO.view(output, IO.read_row_ids(spark, path, "o_orderkey"), "o_orderkey").select("o_orderkey", *QID, TARGET)


@register("anon_run_stats", f"""WITH {PUB}, c AS (SELECT {QKEY}, count(*) AS n FROM pub GROUP BY ALL)
  SELECT '0,0,3' AS node, CAST(coalesce(sum(n) FILTER ({STAR_ROW}), 0) AS BIGINT) AS suppressed, CAST(sum(n) FILTER (NOT ({STAR_ROW})) AS BIGINT) AS sample_size,
    CAST(sum(n) AS BIGINT) AS input_size, count(*) FILTER (NOT ({STAR_ROW})) AS classes, round(avg(n) FILTER (NOT ({STAR_ROW})), 6) AS avg_size FROM c""")
def anon_run_stats(spark, sf):
    s = A.run_stats(published(spark, sf), definition(spark, sf), NODE)
    return s.select(
        F.array_join(F.transform("node", lambda x: x.cast("string")), ",").alias("node"), F.col("suppressed in sample").alias("suppressed"),
        F.col("sample size").alias("sample_size"), F.col("input size").alias("input_size"),
        F.col("equivalence classes").alias("classes"), F.round("average EQ size", 6).alias("avg_size"))


@register("stats_csv_to_json", f"""WITH {STATS} SELECT fold, k, '{{"node":[0,0,3],"QID":["n_name","c_mktsegment","o_orderdate"],"suppressed in sample":' || suppressed
  || ',"sample size":' || sample_size || ',"input size":' || input_size || ',"equivalence classes":' || classes || ',"average EQ size":' || coalesce(CAST(round(avg_size, 3) AS VARCHAR), 'null') || '}}' AS json FROM stats""")
def stats_csv_to_json(spark, sf):
    s = A.run_stats(run_counts(spark, sf), definition(spark, sf), NODE, ["fold", "k"], "cnt")
    s = s.withColumn("average EQ size", F.round("average EQ size", 3))
    text = s.select(
        *[F.col(c).cast("string").alias(c) for c in s.columns if c not in ("node", "QID")],
        F.concat(F.lit("["), F.array_join(F.transform("node", lambda x: x.cast("string")), ", "), F.lit("]")).alias("node"),
        F.concat(F.lit("["), F.array_join("QID", ", "), F.lit("]")).alias("QID"))
    path = scratch_path(spark, "stats-csv")
    IO.write_csv(text, path)
    return IO.stats_text_to_json(IO.read_csv(spark, path, text.columns)).select(F.col("fold").cast("int"), F.col("k").cast("int"), "json")


@register("grid_gather", f"WITH {SAMPLES} SELECT fold, k, b, price_bin, count(*) AS n FROM samples GROUP BY ALL")
def grid_gather(spark, sf):
    """Samples of all cells, written one folder per cell and read as one table."""
    path = scratch_path(spark, "cells")
    IO.write_csv(samples(spark, sf), path, partition_by=["fold", "k", "b"])
    rows = IO.read_grid(spark, path, "o_orderkey bigint, n_name string, c_mktsegment string, o_orderdate string, price_bin string, fold int, k int, b double")
    return rows.groupBy("fold", "k", "b", "price_bin").agg(F.count("*").alias("n"))


@register("union_cells", f"WITH {SAMPLES} SELECT k, b, count(*) AS n, count(DISTINCT o_orderkey) AS ids FROM samples GROUP BY ALL")
def union_cells(spark, sf):
    """The cells of single k, put together again."""
    rows = samples(spark, sf)
    both = rows.filter("k = 5").unionByName(rows.filter("k = 20"))
    return both.groupBy("k", "b").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("ids"))


# ------------------------------------------------------------------- selection

PCOLS = ["o_orderkey", "n_name", "c_mktsegment", "o_orderpriority"]
PSEL = ", ".join(PCOLS)


@register("select_eq", f"WITH {PEOPLE} SELECT {PSEL} FROM people WHERE c_mktsegment = 'BUILDING'")
def select_eq(spark, sf):
    return X.where(people(spark, sf), X.Selector.field("c_mktsegment").equals("BUILDING")).select(PCOLS)


@register("select_complex", f"WITH {PEOPLE} SELECT {PSEL} FROM people WHERE (c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY') AND o_orderpriority = '1-URGENT' OR o_orderstatus = 'F' AND n_name = 'NATION_3'")
def select_complex(spark, sf):
    s = X.Selector.field("c_mktsegment")
    segments = s.equals("BUILDING").or_().equals("MACHINERY")
    chosen = (
        X.Selector().group(segments).and_().on("o_orderpriority").equals("1-URGENT")
        .or_().on("o_orderstatus").equals("F").and_().on("n_name").equals("NATION_3")
    )
    return X.where(people(spark, sf), chosen).select(PCOLS)


@register("subset_rows", f"WITH {PEOPLE}, {RETURNED} SELECT {PSEL} FROM people WHERE o_orderkey IN (SELECT o_orderkey FROM returned)")
def subset_rows(spark, sf):
    return X.subset_rows(people(spark, sf), returned(spark, sf), "o_orderkey").select(PCOLS)


@register("subset_match", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority, o_orderdate ORDER BY md5('0|' || o_orderkey)) AS copy FROM orders),
  b AS (SELECT o_orderstatus, o_orderpriority, o_orderdate, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority, o_orderdate ORDER BY o_orderkey) AS copy
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')
  SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderdate FROM o SEMI JOIN b USING (o_orderstatus, o_orderpriority, o_orderdate, copy)""")
def subset_match(spark, sf):
    """Orders whose (status, priority, date) occur in the research table, as often as there."""
    orders = table(spark, sf, "orders")
    building = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    research = orders.join(building, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    columns = ["o_orderstatus", "o_orderpriority", "o_orderdate"]
    return X.subset_match(orders, research, columns, ID, ID).select("o_orderkey", *columns)


@register("subset_view", f"WITH {PUB}, {RETURNED} SELECT o_orderkey, {QKEY} FROM pub WHERE o_orderkey IN (SELECT o_orderkey FROM returned)")
def subset_view(spark, sf):
    return X.subset_rows(published(spark, sf), returned(spark, sf), "o_orderkey").select("o_orderkey", *QID)


@register("drop_suppressed", f"WITH {PUB} SELECT o_orderkey, {QKEY} FROM pub WHERE NOT ({STAR_ROW})")
def drop_suppressed(spark, sf):
    return C.drop_suppressed(published(spark, sf), QID).select("o_orderkey", *QID)


@register("fully_suppressed_cells", f"""WITH {GEN}, t AS (SELECT fold, {QKEY}, count(*) AS n FROM gen JOIN (SELECT o_orderkey AS k2, ntile(10) OVER (ORDER BY md5('7|' || o_orderkey)) - 1 AS tf FROM people) ON o_orderkey = k2, range(10) f(fold) WHERE fold <> tf GROUP BY ALL)
  SELECT CAST(fold AS INTEGER) AS fold, CAST(k AS INTEGER) AS k, CAST(sum(n) AS BIGINT) AS n_rows, bool_and(n < k) AS fully_suppressed FROM t, (VALUES (10), (30), (60)) v(k) GROUP BY ALL""")
def fully_suppressed_cells(spark, sf):
    return C.fully_suppressed(run_counts(spark, sf, [10, 30, 60]), ["fold", "k"], QID, "cnt")


@register("sample_unusable", f"""WITH {PEOPLE}, s AS (SELECT * FROM people QUALIFY row_number() OVER (ORDER BY md5('7|' || o_orderkey)) <= (SELECT floor(count(*) * CAST(0.1 AS DOUBLE)) FROM people))
  SELECT c.c_name, count(o_orderkey) AS n_rows, count(DISTINCT price_bin) AS n_targets, count(o_orderkey) = 0 OR count(DISTINCT price_bin) < 2 AS unusable
  FROM customer c LEFT JOIN s ON s.c_name = c.c_name GROUP BY c.c_name""")
def sample_unusable(spark, sf):
    drawn = S.random_sample(people(spark, sf), 0.1, ID, SEED)
    return C.unusable_samples(drawn, table(spark, sf, "customer"), ["c_name"], TARGET)


@register("mask_identifiers", f"WITH {PEOPLE} SELECT o_orderkey, '*' AS c_name, n_name FROM people")
def mask_identifiers(spark, sf):
    return X.mask(people(spark, sf), definition(spark, sf).identifying).select("o_orderkey", "c_name", "n_name")


@register("replace_value", f"WITH {PEOPLE} SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN '2-HIGH' ELSE o_orderpriority END AS o_orderpriority FROM people")
def replace_value(spark, sf):
    return X.replace_value(people(spark, sf), "o_orderpriority", "1-URGENT", "2-HIGH").select("o_orderkey", "o_orderpriority")


EVENT_TEXT = """SELECT event_id, split_part(CAST(value AS VARCHAR), '.', 2) AS cents, CASE WHEN event_type = 'click' THEN CAST(value AS VARCHAR) ELSE event_type END AS mixed,
  CASE WHEN event_type = 'error' THEN 'never' ELSE substr(CAST(ts AS VARCHAR), 1, 10) END AS day FROM events"""


def event_text(spark, sf):
    """A dirty text table: numbers, words and dates mixed in one column."""
    value, kind = F.col("value").cast("string"), F.col("event_type")
    return table(spark, sf, "events").select(
        "event_id", F.split_part(value, F.lit("."), F.lit(2)).alias("cents"),
        F.when(kind == "click", value).otherwise(kind).alias("mixed"),
        F.when(kind == "error", "never").otherwise(F.substring(F.col("ts").cast("string"), 1, 10)).alias("day"))


INT_RE, DEC_RE = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
IS_DATE = "try_strptime({c}, '%Y-%m-%d') IS NOT NULL AND regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')"


@register("cleanse_typed", f"""WITH e AS ({EVENT_TEXT}) SELECT event_id, CASE WHEN regexp_matches(cents, '{INT_RE}') THEN cents END AS cents,
  CASE WHEN regexp_matches(mixed, '{DEC_RE}') THEN mixed END AS mixed, CASE WHEN {IS_DATE.format(c='day')} THEN day END AS day FROM e""")
def cleanse_typed(spark, sf):
    return X.cleanse(event_text(spark, sf), {"cents": "integer", "mixed": "decimal", "day": "date"})


def _detect_sql() -> str:
    parts = []
    for c in ("cents", "mixed", "day"):
        tests = {"string": "true", "integer": f"regexp_matches({c}, '{INT_RE}')", "decimal": f"regexp_matches({c}, '{DEC_RE}')", "date": IS_DATE.format(c=c)}
        for kind, test in tests.items():
            parts.append(f"SELECT '{c}' AS \"column\", '{kind}' AS type, count(*) FILTER ({c} IS NOT NULL AND {test}) AS matches, round(CAST(count(*) FILTER ({c} IS NOT NULL AND {test}) AS DOUBLE) / count({c}), 9) AS fraction FROM e")
    return f"WITH e AS ({EVENT_TEXT}) " + " UNION ALL ".join(parts)


@register("detect_types", _detect_sql())
def detect_types(spark, sf):
    return X.detect_types(event_text(spark, sf), ["cents", "mixed", "day"]).withColumn("fraction", F.round("fraction", 9))


@register("distinct_values", "SELECT DISTINCT c_mktsegment FROM customer")
def distinct_values(spark, sf):
    return table(spark, sf, "customer").select("c_mktsegment").distinct()


@register("null_counts", """WITH x AS (SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
  SELECT 'doc_id' AS "column", count(*) FILTER (doc_id IS NULL) AS nulls, count(*) AS n_rows FROM x UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL), count(*) FROM x
  UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL), count(*) FROM x""")
def null_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return X.null_counts(docs, ["doc_id", "quality", "toxic"])


@register("peek", f"WITH {PEOPLE} SELECT {PSEL} FROM people ORDER BY md5('7|' || o_orderkey) LIMIT 20")
def peek(spark, sf):
    return X.peek(people(spark, sf), 20, ID, SEED).select(PCOLS)


@register("sort_output", f"WITH {PUB} SELECT o_orderkey, {QKEY} FROM pub ORDER BY n_name DESC, o_orderdate, o_orderkey")
def sort_output(spark, sf):
    return published(spark, sf).select("o_orderkey", *QID).orderBy(F.desc("n_name"), "o_orderdate", "o_orderkey")


@register("target_difference", f"WITH {SAMPLE} SELECT {QKEY} FROM pub WHERE true EXCEPT SELECT {QKEY} FROM samp WHERE price_bin = '[0-50000['")
def target_difference(spark, sf):
    """Classes whose sample has no row of the lowest price bin."""
    output = published(spark, sf)
    drawn = S.stratified_sample(output, QID, 0.2, ID, SEED).filter(F.col(TARGET) == "[0-50000[")
    return output.select(*QID).subtract(drawn.select(*QID))


@register("mean_spread_fmt", f"""WITH {PEOPLE} SELECT n_name, CASE WHEN c = 1 THEN printf('%.1f', round_even(m, 1)) || ' ± nan' ELSE printf('%.1f', round_even(m, 1)) || ' ± ' || printf('%.1f', round_even(s, 1)) END AS text
  FROM (SELECT n_name, count(*) AS c, avg(o_totalprice / 1000) AS m, stddev_samp(o_totalprice / 1000) AS s FROM people GROUP BY n_name)""")
def mean_spread_fmt(spark, sf):
    from cloakframe.functions.text import mean_spread

    price = F.col("o_totalprice") / 1000
    return people(spark, sf).groupBy("n_name").agg(mean_spread(F.avg(price), F.stddev_samp(price)).alias("text"))
