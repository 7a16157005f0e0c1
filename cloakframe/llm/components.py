"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.session import discard, materialize


def _toward_minimum(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One star operation over edges ``(a, b)``, each kept once with ``a < b``."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger_only else edges.select(
        F.col("b").alias("a"), F.col("a").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    moved = joined.where("b > a").select(F.col("m").alias("a"), "b") if larger_only else (
        joined.select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b"))))
    return moved.where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; the component is its smallest node.

    Every round is written to the shared folder, so that a lost executor costs one round at most. The minimum of a
    node's neighbours is a partial aggregate and goes back by a join that adaptive execution may split, so a node with
    very many neighbours needs no task of its own. Rounds end when a round changes nothing (logarithmically many).
    Edges of a node with itself, with NULL, and repeated edges are ignored; no edges give no rows.
    """
    now = materialize(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
        before, now = now, materialize(_toward_minimum(_toward_minimum(now, True), False), "edges")
        discard(before)
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
