"""Grid samples from marks on rows, and ranks in ranges of bounded size."""

import collections
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from cloakframe.functions.hashing import order_hash
from cloakframe.operators import sampling as S
from cloakframe.operators.ranking import ranked
from cloakframe.plans import grids

NAMES = ["o_orderkey", "n_name", "c_mktsegment", "o_orderdate", "price_bin"]
md5 = lambda *x: hashlib.md5("|".join(str(v) for v in x if v is not None).encode()).hexdigest()


def people(spark, seed, n):
    """Classes of one row to a third of all, some with NULL, some in one fold only."""
    rng = random.Random(seed)
    rows = [(i, rng.choice(["A"] * 6 + ["B", "B", "C", None]), rng.choice(["x"] * 5 + ["y", None]), rng.choice(["1995"] * 4 + [str(1996 + i % 9)]), rng.choice("pqr")) for i in range(n)]
    return rows, spark.createDataFrame(rows, "o_orderkey bigint, n_name string, c_mktsegment string, o_orderdate string, price_bin string")


def brute(rows):
    order = sorted(rows, key=lambda r: md5(7, r[0]))
    sizes = [len(rows) // 10 + (i < len(rows) % 10) for i in range(10)]
    own = [f for f, n in enumerate(sizes) for _ in range(n)]
    out = []
    for fold in range(10):
        train = [r for r, f in zip(order, own) if f != fold]
        counts = collections.Counter(r[1:4] for r in train)
        for k in grids.KS:
            classes = collections.defaultdict(list)
            for r in train:
                classes[r[1:4] if counts[r[1:4]] >= k else ("*",) * 3].append(r)
            for b in grids.BS:
                turns = sorted((j / len(c), md5(7, fold, k, b, *q), str(q), r, q) for q, c in classes.items() for j, r in enumerate(c, 1))
                out += [(fold, k, r[0], *q, r[4], b) for _, _, _, r, q in turns[:math.floor(len(train) * b)]]
    return collections.Counter(out)


@pytest.mark.parametrize("seed, n", [(1, 397), (2, 60), (3, 1)])
def test_samples_without_copies_of_rows(spark, seed, n):
    rows, df = people(spark, seed, n)
    grid = grids.Grid(S.k_fold(df, 10, ["o_orderkey"], 7))
    want = brute(rows)
    drawn = grid.samples()
    assert drawn.columns == ["fold", "k", *NAMES, "b"]
    got = collections.Counter(tuple(r) for r in drawn.collect())
    assert got == want
    assert grid.marked.count() <= n  # rows are kept once, not once for each training set
    counted = {tuple(r)[:-1]: r["n"] for r in grid.counts().collect()}
    per = collections.Counter()
    for (fold, k, _, a, c, o, t, b), m in want.items():
        per[fold, k, b, a, c, o, t] += m
    assert counted == dict(per)


def test_repeated_and_missing_ids(spark):
    rows, df = people(spark, 4, 200)
    df = df.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.floor(F.col("o_orderkey") / 3)))
    grid = grids.Grid(S.k_fold(df, 10, ["o_orderkey"], 7))
    cells = {(r["fold"], r["k"], r["b"]): r["n"] for r in grid.samples().groupBy("fold", "k", "b").agg(F.count("*").alias("n")).collect()}
    assert cells == {(f, k, b): math.floor(180 * b) for f in range(10) for k in grids.KS for b in grids.BS}
    total = grid.counts().groupBy("fold", "k", "b").agg(F.sum("n").alias("n")).collect()
    assert {(r["fold"], r["k"], r["b"]): r["n"] for r in total} == cells


def test_ranges_are_not_merged_into_few_tasks(spark):
    """Ranks in one group of 1,000 rows, 50 to a range: as many tasks as ranges."""
    df = spark.range(1000).select(F.col("id"), F.lit("a").alias("g"))
    out = ranked(df, ["g"], ["id"], order_hash(7, ["id"]), rows_per_task=50)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan  # an exchange that adaptive execution leaves as it is
    assert {r["id"]: r["rank"] for r in out.collect()} == {i: k for k, i in enumerate(sorted(range(1000), key=lambda i: md5(7, i)), 1)}
