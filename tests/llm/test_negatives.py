"""Hard negatives against brute force, with NULLs, ties, copies, lengths of several kinds and several dimensions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import negatives
from cloakframe.llm.negatives import HardNegatives, hard_negatives

SCHEMA = "vec_id bigint, label int, embedding array<float>"
LAST = 2**63 - 1


def plain(rows, p=HardNegatives()):
    """The definition, pair by pair."""
    part = []
    for vec_id, label, vector in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        part.append((LAST if vec_id is None else vec_id, label, [math.floor(p.scale * float(np.float32(x))) for x in vector]))
    out = []
    for k, (anchor, label, vector) in enumerate(part):
        if anchor % 50 or anchor == LAST:
            continue
        scores = sorted(
            (-sum(a * b for a, b in zip(vector, v)), i, other == label)
            for j, (i, other, v) in enumerate(part) if j != k and len(v) == len(vector))
        for score, positive, _ in [s for s in scores if s[2]][: p.positives]:
            fits = [(-s, i) for s, i, same in scores if not same and -p.low * score <= -100 * s <= -p.high * score]
            out += [(anchor, positive, r + 1, i, -score, s) for r, (s, i) in enumerate(fits[: p.negatives])]
    return sorted(tuple(None if v == LAST else v for v in r) for r in out) if all(LAST not in r for r in out) else sorted(
        (tuple(None if v == LAST else v for v in r) for r in out), key=str)


def found(df):
    rows = [tuple(r) for r in df.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    return sorted(rows, key=str) if any(None in r for r in rows) else sorted(rows)


def vectors(n, dim, seed, spread=0.0, labels=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) + rng.normal(size=(labels, dim))[rng.integers(labels, size=n)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= np.exp(spread * rng.normal(size=(n, 1)))
    return [(k, int(rng.integers(labels)), [float(v) for v in row]) for k, row in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_buckets_and_blocks_lose_nothing(spark, spread):
    rows = vectors(900, 6, 3, spread)
    p = HardNegatives(bucket_values=1400, block_rows=5)
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, p)
    assert found(got) == plain(rows)
    assert len(plain(rows)) > 200


def test_awkward_rows(spark):
    rows = vectors(300, 5, 9, 0.5)
    nan, inf = float("nan"), float("inf")
    rows += [
        (None, 1, [0.5, 0.5, 0.1, 0.0, 0.2]), (1000, None, [0.1] * 5), (1050, 1, None), (1100, 1, [0.1, None, 0.1, 0.1, 0.1]),
        (1150, 2, [nan, 0.1, 0.1, 0.1, 0.1]), (1200, 2, [0.1, -inf, 0.1, 0.1, 0.1]), (1250, 2, [0.0] * 5), (1251, 2, [0.0] * 5),
        (1300, 1, []), (1301, 1, []), (1302, 2, []), (1350, 3, [0.3, 0.4]), (1351, 3, [0.3, 0.5]), (1352, 1, [0.2, 0.4]),
        (1400, 9, [0.1, 0.2, 0.3, 0.4, 0.5]), (-50, 1, [0.2, 0.1, 0.0, 0.3, 0.4])]
    rows += [rows[50]] * 3 + [rows[7]] * 9  # repeated rows, one of them an anchor
    rows += [(2000 + k, k % 3, [0.25, 0.5, 0.25, 0.125, 0.0]) for k in range(200)]  # one common vector
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("id", "cls", "bucket", "dim", "anchor_id", "rank")})
    got = hard_negatives(df, F.col("vec_id") % 50 == 0, HardNegatives(bucket_values=900, block_rows=4))
    expected = plain(rows)
    assert sorted(found(got), key=str) == sorted(expected, key=str)
    assert {2000, 2050, 1250, 1350, -50} <= {r[0] for r in expected}


def test_large_numbers_stay_exact(spark):
    rng = random.Random(5)
    rows = [(k, k % 2, [float(np.float32(rng.uniform(-1, 1) * 4e5)) for _ in range(4)]) for k in range(60)]
    assert found(hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0)) == plain(rows)
    huge = [*rows, (100, 1, [3e38] * 4)]  # its scores have no place in 64 bits
    assert found(hard_negatives(spark.createDataFrame(huge, SCHEMA), F.col("vec_id") % 50 == 0)) == plain(rows)


def test_empty_table(spark):
    df = hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0)
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and not df.collect()


def test_ranges_hold_every_row_that_reaches_a_score():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 8))
    x = np.floor(300 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    lengths = np.sqrt((x * x).sum(axis=1))
    ids = np.column_stack([np.ones(500, dtype=np.int64), np.arange(500)])
    orders = np.ascontiguousarray(np.argsort(x / lengths[:, None], axis=0, kind="stable").astype("u4").T)
    bucket = negatives.Bucket({
        "dim": 8, "low": lengths.min(), "high": lengths.max(), "item": 8, "vectors": x.tobytes(),
        "labels": np.zeros(500, dtype=np.int64).tobytes(), "ids": ids.tobytes(), "orders": orders.tobytes()})
    sizes = []
    for k in range(0, 500, 10):
        scores = x @ x[k]
        for least in (1.0, float(np.sort(scores)[-50]), float(np.sort(scores)[-3])):
            rows = bucket.candidates(x[k], float(lengths[k]), least, 4)
            assert set(np.flatnonzero(scores >= least)) <= set(rows.tolist())
            sizes.append(len(rows))
    assert min(sizes) < 100  # ranges do leave rows out
