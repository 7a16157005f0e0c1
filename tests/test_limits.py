"""No hidden limits: rounds, steps, searches and draws go as far as the data asks; NULL is a value of its own."""

import pytest

from cloakframe import Definition, Hierarchy
from cloakframe.functions.hashing import hash_int, order_hash
from cloakframe.operators import anonymize as A
from cloakframe.operators import dp, hierarchies, ml
from cloakframe.operators import privacy as P
from pyspark.sql import functions as F


@pytest.mark.parametrize("epsilon", [1e-4, 1e-2, 0.5, 2.0])
def test_private_class_size(epsilon):
    """From the class size found on no tail is above delta; with one row less some tail is."""
    import math

    k, beta = dp.class_size_for(epsilon, 1e-6), dp.sampling_rate(epsilon)
    gamma = (math.exp(epsilon) - 1 + beta) / math.exp(epsilon)
    first, before = (max(1, math.ceil(x / gamma - 1)) for x in (k, k - 1))
    assert all(dp._tail(n, gamma, beta) <= 1e-6 for n in range(first, first + 2000))
    assert k == 1 or any(dp._tail(n, gamma, beta) > 1e-6 for n in range(before, first))


def test_tail_equals_the_plain_sum():
    import math
    for n, gamma, beta in ((10, 0.5, 0.2), (47, 0.6, 0.4), (200, 0.3, 0.1)):
        plain = sum(math.comb(n, j) * beta**j * (1 - beta) ** (n - j) for j in range(math.floor(gamma * n) + 1, n + 1))
        assert dp._tail(n, gamma, beta) == pytest.approx(plain, rel=1e-9)


def test_draws_use_sixty_bits(spark):
    top = spark.range(200).select(hash_int(order_hash(1, ["id"])).alias("h")).agg(F.max("h"), F.min("h")).first()
    assert 2**59 < top[0] < 2**60 and top[1] >= 0


def test_greedy_walks_as_far_as_needed(spark):
    rows = spark.createDataFrame([(str(k).ljust(60, "0"),) for k in range(6)], "code string")
    d = Definition(("code",), {"code": hierarchies.redaction(60)})
    assert A.greedy(rows, d, [P.KAnonymity(5)]).first() is not None
    cut = A.greedy(rows, d, [P.KAnonymity(5)], steps=1).first()
    assert cut is not None and cut["level"] == 60


def test_trees_take_many_categories(spark):
    rows = spark.createDataFrame([(f"c{k % 101}", "a" if k % 101 < 50 else "b") for k in range(303)], "cat string, target string")
    predicted, _ = ml.fit_predict(rows, rows, "target", ["cat"], kind=ml.FOREST, rounds=2)
    assert predicted.count() == 303


@pytest.mark.parametrize("model", ["hier", "ordered"])
def test_t_closeness_counts_missing_values(spark, model):
    """Class b holds x and y evenly; the table holds x twice, y once and one NULL."""
    rows = spark.createDataFrame([("a", "x"), ("a", None), ("b", "x"), ("b", "y")], "g string, s string")
    table = spark.createDataFrame([("x", ["x", "*"]), ("y", ["y", "*"])], "value string, levels array<string>")
    m = P.HierarchicalTCloseness("s", 0.1, Hierarchy.explicit(table, height=1)) if model == "hier" else P.OrderedTCloseness("s", 0.1)
    counted = rows.groupBy("g", "s").agg(F.count("*").alias("cnt"))
    got = {r["g"]: r["value"] for r in m.measure(counted, ["g"]).collect()}
    want = {"hier": {"a": 0.25, "b": 0.25}, "ordered": {"a": 0.25, "b": 0.125}}
    # Ordered, NULL first: cumulative table shares are 1/4, 3/4, 1; of class b 0, 1/2, 1.
    want["ordered"] = {"a": (0.25 + 0.25) / 2, "b": (0.25 + 0.25) / 2}
    assert got == pytest.approx(want[model])
