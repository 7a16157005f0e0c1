"""Readers and writers for the file formats of anonymization experiments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.functions.text import decimal_comma, parse_decimal_comma
from cloakframe.operators.ranking import null_safe

NULL_TEXT = "NULL"


def _strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], header: bool = True, sep: str = ";") -> DataFrame:
    """All cells as strings; the literal ``NULL`` is a missing value."""
    return (
        spark.read.schema(_strings(columns))
        .option("sep", sep)
        .option("header", header)
        .option("encoding", "UTF-8")
        .option("nullValue", NULL_TEXT)
        .csv(path)
    )


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ";", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.option("sep", sep).option("header", header).option("nullValue", NULL_TEXT)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def with_decimal_comma(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: decimal_comma(F.col(c)) for c in columns})


def from_decimal_comma(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: parse_decimal_comma(F.col(c)) for c in columns})


def pick_columns(df: DataFrame, picks: Sequence[tuple]) -> DataFrame:
    """Column picks ``(index or name[, alias[, type]])`` of a source.

    Text that does not parse as the asked type becomes NULL.
    """
    chosen: list[Column] = []
    for pick in picks:
        ref, alias, kind = (*pick, None, None)[:3]
        name = df.columns[ref] if isinstance(ref, int) else ref
        column = F.col(name).try_cast(kind) if kind else F.col(name)
        chosen.append(column.alias(alias or name))
    return df.select(*chosen)


def read_jdbc(spark: SparkSession, url: str, table: str, picks: Sequence[tuple] | None = None, **options: str) -> DataFrame:
    """A database table; give ``partitionColumn``/bounds options to read it in parallel."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return pick_columns(df, picks) if picks else df


# ------------------------------------------------------------------ hierarchies


def read_hierarchy(spark: SparkSession, path: str, levels: int) -> DataFrame:
    """``value; level 1; ...; top`` without header as ``(value, levels)``."""
    names = [f"l{i}" for i in range(levels)]
    df = read_csv(spark, path, names, header=False)
    return df.select(F.col("l0").alias("value"), F.array(*names).alias("levels"))


def write_hierarchy(table: DataFrame, path: str, levels: int) -> None:
    write_csv(table.select(*[F.col("levels")[i].alias(f"l{i}") for i in range(levels)]), path, header=False)


def read_hierarchy_dir(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    """All ``<dataset>_hierarchy_<attribute>.csv`` below a folder in one scan."""
    lines = spark.read.text(f"{folder}/{dataset}_hierarchy_*.csv")
    name = F.regexp_extract(F.input_file_name(), f"{dataset}_hierarchy_(.+?)\\.csv", 1)
    levels = F.split("value", ";")
    return lines.select(name.alias("attribute"), levels[0].alias("value"), levels.alias("levels"))


# ----------------------------------------------------------------- row numbers


def write_row_ids(df: DataFrame, id_col: str, path: str) -> None:
    """The row numbers of a sample, one per line, in ascending order."""
    df.select(F.col(id_col).cast("bigint")).sort(id_col).select(F.col(id_col).cast("string")).write.text(path)


def read_row_ids(spark: SparkSession, path: str, id_col: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").cast("bigint").alias(id_col))


def view(df: DataFrame, subset: DataFrame, id_col: str) -> DataFrame:
    return null_safe(df, subset.select(id_col), [id_col], "left_semi")


# ------------------------------------------------------- statistics and reports

# The field names of statistics files.
STATS_SCHEMA = (
    "node array<int>, QID array<string>, `suppressed in sample` bigint, `sample size` bigint, "
    "`input size` bigint, `equivalence classes` bigint, `average EQ size` double"
)


def write_stats(stats: DataFrame, path: str, cells: Sequence[str] = ()) -> None:
    """Statistics of runs as JSON, one folder per experiment cell."""
    writer = stats.write
    (writer.partitionBy(*cells) if cells else writer).json(path)


def read_stats(spark: SparkSession, path: str, schema: str = STATS_SCHEMA) -> DataFrame:
    """Statistics of all cells in one scan; the cell comes from the folder names."""
    return spark.read.schema(schema).option("multiLine", False).json(path)


def read_stats_tree(spark: SparkSession, path: str, schema: str = STATS_SCHEMA, levels: Sequence[str] = ("fold", "k")) -> DataFrame:
    """Pretty-printed ``stats.json`` below ``fold_i/k<k>/...`` folders."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
    df = df.option("pathGlobFilter", "stats.json").json(path).withColumn("_path", F.input_file_name())
    patterns = {"fold": r"/fold_(\d+)/", "k": r"/k(\d+)/", "b": r"/B\(([0-9.]+)\)/", "l": r"/l([0-9.]+)/"}
    types = {"fold": "int", "k": "int", "b": "double", "l": "double"}
    found = {n: F.regexp_extract("_path", patterns[n], 1).try_cast(types[n]) for n in levels}
    return df.withColumns(found).drop("_path")


def stats_text_to_json(df: DataFrame) -> DataFrame:
    """Statistics kept as CSV text (``[1, 2]`` lists) as one JSON line per run."""
    items = lambda c: F.split(F.regexp_replace(c, r"^\[|\]$", ""), ", ")
    fields = F.struct(
        F.transform(items(F.col("node")), lambda x: x.cast("int")).alias("node"),
        items(F.col("QID")).alias("QID"),
        F.col("suppressed in sample").cast("bigint").alias("suppressed in sample"),
        F.col("sample size").cast("bigint").alias("sample size"),
        F.col("input size").cast("bigint").alias("input size"),
        F.col("equivalence classes").cast("bigint").alias("equivalence classes"),
        F.col("average EQ size").cast("double").alias("average EQ size"),
    )
    return df.withColumn("json", F.to_json(fields, {"ignoreNullFields": "false"}))


def read_grid(spark: SparkSession, path: str, schema: str, sep: str = ";") -> DataFrame:
    """Per-cell CSV files under ``fold=/k=/b=`` folders as one table with cell columns."""
    return spark.read.schema(schema).option("sep", sep).option("header", True).csv(path)
