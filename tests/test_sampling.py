import heapq
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakframe.functions.hashing import order_hash
from cloakframe.operators import sampling as S
from cloakframe.operators.ranking import ordered_positions, ranked


def population(spark, n=400, seed=1):
    rng = random.Random(seed)
    # a third of all rows in one class, the rest spread, some with NULL
    rows = []
    for i in range(n):
        hot = rng.random() < 0.34
        a = "hot" if hot else rng.choice(["a", "b", "c", None])
        rows.append((i, a, "x" if hot else str(rng.randint(0, 9)), rng.choices(["lo", "mid", "hi"], [1, 4, 15])[0]))
    return spark.createDataFrame(rows, "id bigint, p string, q string, t string")


def greedy(sizes, b, total):
    """The sizes one row at a time: always to the class with the smallest next share."""
    s = [int(n * b) for n in sizes]
    heap = [((s[i] + 1) / n, i) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    for _ in range(total - sum(s)):
        _, i = heapq.heappop(heap)
        s[i] += 1
        heapq.heappush(heap, ((s[i] + 1) / sizes[i], i))
    return s


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=40), st.floats(0.0, 1.0))
def test_settled_ratio_gives_the_greedy_sizes(sizes, b):
    total = int(sum(sizes) * b)
    hist = pd.Series(sizes).value_counts().rename_axis("n").reset_index(name="classes")
    hist["quota"], hist["cell"] = total, 0
    row = S._settle(hist, ["cell"]).iloc[0]
    n = np.array(sizes, float)
    full = S._le(n, row["ratio"])
    tied = (full > 0) & (full / n == row["ratio"])
    assert 0 <= row["ties"] <= tied.sum()
    assert (full - tied).sum() + row["ties"] == total
    shares = sorted(s / k for s, k in zip(greedy(sizes, b, total), sizes))
    free = list(full - tied)
    for i in list(np.flatnonzero(tied))[: int(row["ties"])]:
        free[i] += 1
    mine = [f / k for f, k in zip(free, sizes)]
    if total:  # the same multiset of sampled rows by their share j/n
        js = lambda s: sorted(j / k for x, k in zip(s, sizes) for j in range(1, int(x) + 1))
        assert js(free) == pytest.approx(js(greedy(sizes, b, total)))
        assert max(mine) <= row["ratio"] + 1e-12
    assert len(shares) == len(sizes)


@pytest.mark.parametrize("b", [0.0, 0.13, 0.5, 1.0])
def test_stratified_exact_size_and_lower_quota(spark, b):
    df = population(spark)
    out = S.stratified_sample(df, ["p", "q"], b, ["id"], 3)
    rows = out.collect()
    assert len(rows) == len({r["id"] for r in rows}) == int(400 * b)
    key = lambda r: (r["p"], r["q"])
    have = pd.Series([key(r) for r in rows]).value_counts() if rows else {}
    for k, n in pd.Series([key(r) for r in df.collect()]).value_counts().items():
        assert (have.get(k, 0) if rows else 0) >= int(n * b)


def test_split_of_hot_groups_changes_nothing(spark):
    df = population(spark)
    h = order_hash(3, ["id"])
    plain = ranked(df, ["p"], ["id"], h, size="size").collect()
    split = ranked(df, ["p"], ["id"], h, size="size", rows_per_task=20).collect()
    assert sorted(map(str, plain)) == sorted(map(str, split))
    whole = ranked(df, [], ["id"], h, rows_per_task=30).collect()
    assert sorted(r["rank"] for r in whole) == list(range(1, 401))
    for draw in (
        lambda **k: S.stratified_sample(df, ["p", "q"], 0.3, ["id"], 3, **k),
        lambda **k: S.balanced_sample(df, ["p", "q"], "t", 0.3, ["id"], 3, **k),
    ):
        a = sorted(r["id"] for r in draw().collect())
        b = sorted(r["id"] for r in draw(rows_per_task=15).collect())
        assert a == b and len(a) == 120
    one = sorted((r["id"], r["draw"]) for r in S.oversample(df, "t", ["id"], 3).collect())
    two = sorted((r["id"], r["draw"]) for r in S.oversample(df, "t", ["id"], 3, rows_per_task=15).collect())
    assert one == two


def test_ordered_positions_split(spark):
    df = population(spark).select(F.concat(F.lit("same-prefix-"), F.col("id").cast("string")).alias("v"))
    plain = ordered_positions(df, ["v"]).collect()
    split = ordered_positions(df, ["v"], rows_per_task=17).collect()
    assert sorted(map(str, plain)) == sorted(map(str, split))


def test_balanced_amounts(spark):
    df = population(spark)
    got = {r["t"]: r["count"] for r in S.balanced_sample(df, ["p", "q"], "t", 0.5, ["id"], 3).groupBy("t").count().collect()}
    counts = {r["t"]: r["count"] for r in df.groupBy("t").count().collect()}
    assert sum(got.values()) == 200
    level = 0
    while sum(min(n, level + 1) for n in counts.values()) <= 200:
        level += 1
    for t, n in counts.items():
        assert min(n, level) <= got[t] <= min(n, level + 1)


def test_random_split_and_folds(spark):
    df = population(spark)
    assert S.random_sample(df, 0.1, ["id"], 5).count() == 40
    assert S.random_sample(df, 0.0, ["id"], 5).count() == 0
    for share, n in ((0.0, 0), (0.37, 148), (1.0, 400)):
        assert S.train_test(df, share, ["id"], 5).filter("split = 'train'").count() == n
    folds = S.k_fold(df.filter("id < 397"), 10, ["id"], 5).groupBy("fold").count().collect()
    assert sorted((r["fold"], r["count"]) for r in folds) == [(i, 40 if i < 7 else 39) for i in range(10)]
    few = S.k_fold(df.filter("id < 4"), 10, ["id"], 5).collect()
    assert sorted(r["fold"] for r in few) == [0, 1, 2, 3]


def test_balancing(spark):
    df = population(spark)
    counts = {r["t"]: r["count"] for r in df.groupBy("t").count().collect()}
    under = {r["t"]: r["count"] for r in S.undersample(df, "t", ["id"], 5).groupBy("t").count().collect()}
    over = {r["t"]: r["count"] for r in S.oversample(df, "t", ["id"], 5).groupBy("t").count().collect()}
    assert set(under.values()) == {min(counts.values())}
    assert set(over.values()) == {max(counts.values())}


def test_certainty_cap(spark):
    df = population(spark)
    drawn = S.balanced_sample(df, ["p", "q"], "t", 0.5, ["id"], 3)
    out = S.certainty_cap(drawn, df, ["p", "q"], 0.5, 0.1, ["id"], 3)
    sizes = {(r["p"], r["q"]): r["count"] for r in df.groupBy("p", "q").count().collect()}
    for r in out.groupBy("p", "q").count().collect():
        assert r["count"] / sizes[(r["p"], r["q"])] <= 0.5 * 1.1 + 1e-9


def test_sample_size_out_of_range(spark):
    with pytest.raises(ValueError):
        S.random_sample(population(spark), 1.2, ["id"], 1)
    with pytest.raises(ValueError):
        S.balanced_sample(population(spark), ["p"], "missing", 0.5, ["id"], 1)


@pytest.mark.parametrize("rows", [[(1, "x", {"a": 1})] * 10, [(k % 3, "xyz"[k % 2], None) for k in range(11)], [(None, f"t{k}", None) for k in range(9)] + [(None, None, None)] * 4])
def test_exact_sizes_where_ids_repeat(spark, rows):
    """Sizes are exact, rows are taken from the table, and folds part it, also if ids or whole rows are equal."""
    from collections import Counter

    df = spark.createDataFrame(rows, "id int, t string, m map<string,int>").repartition(3)
    key = lambda r: (r["id"], r["t"])
    whole = Counter(map(key, df.collect()))
    for b in (0.0, 0.3, 0.5, 1.0):
        drawn = Counter(map(key, S.random_sample(df, b, ["id"], 7).collect()))
        assert drawn.total() == int(len(rows) * b) and drawn <= whole
        split = S.train_test(df, b, ["id"], 7).collect()
        assert Counter(map(key, split)) == whole and sum(r["split"] == "train" for r in split) == int(len(rows) * b)
    folds = S.k_fold(df, 4, ["id"], 7).collect()
    sizes = Counter(r["fold"] for r in folds)
    assert Counter(map(key, folds)) == whole and [sizes[k] for k in range(4)] == [len(rows) // 4 + (k < len(rows) % 4) for k in range(4)]
    even = Counter(r["t"] for r in S.undersample(df, "t", ["id"], 7).collect())
    assert set(even.values()) == {min(Counter(r["t"] for r in df.collect()).values())}
