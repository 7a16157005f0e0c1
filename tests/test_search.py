"""Lattice search, ranges and classifiers from counts against plain versions."""

import bisect
import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from cloakframe import Definition, Hierarchy
from cloakframe.operators import lattice as L
from cloakframe.operators import ml as M
from cloakframe.operators import privacy as P
from cloakframe.operators.ranking import dealt_by_range, last_below, running_total


def people(spark, seed, rows=60):
    rng = random.Random(seed)
    data = [(rng.choice("abcd"), rng.randrange(8), rng.choice(["x", "y", None]), rng.choice("pq")) for _ in range(rows)]
    return spark.createDataFrame(data, "a string, b int, c string, s string")


def definition(b_steps=(2, 4)):
    up = lambda width: lambda c: F.floor(c / width) * width
    star = lambda c: F.lit("*")
    half = lambda c: F.when(c.isin("a", "b"), "ab").otherwise("cd")
    return Definition(qid=("a", "b", "c"), hierarchies={
        "a": Hierarchy.functional(half, star), "b": Hierarchy.functional(*[up(w) for w in b_steps], star)}, sensitive=("s",))


@pytest.mark.parametrize("seed, models, quality, suppression, steps", [
    (1, [P.KAnonymity(3)], L.Quality(), 0.1, (2, 4)),
    (2, [P.KAnonymity(5)], L.Quality(gs=0.2), 0.0, (2, 4)),
    (3, [P.KAnonymity(2), P.DistinctLDiversity("s", 2)], L.Quality(gs=0.9), 0.3, (2, 4)),
    (4, [P.KAnonymity(4)], L.Quality("height"), 0.05, (2, 4)),
    (5, [P.KAnonymity(2), P.EntropyLDiversity("s", 1.8)], L.Quality(), 0.5, (2, 4)),  # not monotone
    (6, [P.KAnonymity(4)], L.Quality(), 0.2, (2, 3)),  # classes of 2 and of 3 cross: not nested
    (7, [P.KAnonymity(61)], L.Quality(), 0.5, (2, 4)),  # no node holds
])
def test_search_finds_the_optimum_of_all_nodes(spark, seed, models, quality, suppression, steps):
    df, d = people(spark, seed), definition(steps)
    want = L.optimum(L.scores(df, d, models, quality, suppression)).first()
    got = L.search(df, d, models, quality, suppression, at_a_time=4)
    assert (got is None) == (want is None) == (seed == 7)
    if want is not None:
        assert (got["node"], got["suppressed"], got["classes"]) == (want["node"], want["suppressed"], want["classes"])
        assert got["loss"] == pytest.approx(want["loss"])


def test_search_within_bounds(spark):
    df, d = people(spark, 8), definition()
    low, high = {"a": 1, "b": 1}, {"b": 2}
    want = L.optimum(L.scores(df, d, [P.KAnonymity(4)], suppression=0.2, chosen=L.nodes(d, low, high))).first()
    assert L.search(df, d, [P.KAnonymity(4)], suppression=0.2, low=low, high=high)["node"] == want["node"]


def test_scores_in_small_batches(spark, monkeypatch):
    """Many varying attributes: nodes are expanded a few at a time, with the same figures."""
    df, d = people(spark, 11), definition()
    want = {r["node"]: r for r in L.scores(df, d, [P.KAnonymity(3)], suppression=0.2).collect()}
    monkeypatch.setattr(L, "MAX_VARYING", 1)
    monkeypatch.setattr(L, "NODES_TOGETHER", 5)
    got = {r["node"]: r for r in L.scores(df, d, [P.KAnonymity(3)], suppression=0.2).collect()}
    assert got.keys() == want.keys() and len(got) == 24
    for node, r in got.items():
        assert r["loss"] == pytest.approx(want[node]["loss"]) and r["suppressed"] == want[node]["suppressed"] and r["valid"] == want[node]["valid"]


def test_search_over_many_attributes_judges_few_nodes(spark, monkeypatch):
    """Seven attributes, each shown or hidden: the nodes that may still win are settled from the highest down."""
    rng, names = random.Random(5), "abcdefg"
    rows = spark.createDataFrame([tuple(rng.choice(["x", "y", None][:2 + k % 2]) for k in range(7)) for _ in range(400)], ", ".join(f"{q} string" for q in names))
    d = Definition(tuple(names), {}, weights={q: 1.0 + 0.1 * k for k, q in enumerate(names)})
    want = L.optimum(L.scores(rows, d, [P.KAnonymity(15)], suppression=0.02)).first()
    judged, plain = [], L._score_batch
    monkeypatch.setattr(L, "_score_batch", lambda *a: judged.extend(a[5]) or plain(*a))
    got = L.search(rows, d, [P.KAnonymity(15)], suppression=0.02, at_a_time=4)
    assert tuple(got)[:5] == tuple(want)[:5] and got["loss"] == pytest.approx(want["loss"])
    assert len(judged) <= 50


@pytest.mark.parametrize("models, quality", [
    ([P.KAnonymity(3)], L.Quality()), ([P.KAnonymity(2), P.DistinctLDiversity("s", 2)], L.Quality(gs=0.9)),
    ([P.KAnonymity(2)], L.Quality("payout", costs={"adversary_cost": 4.0, "adversary_gain": 300.0, "publisher_loss": 300.0, "publisher_benefit": 1200.0}))])
def test_coded_tuples_score_alike(spark, models, quality):
    """Also for NULL, values that a hierarchy does not list, and columns of models."""
    listed = spark.createDataFrame([("a", ["a", "ab", "*"]), ("b", ["b", "ab", "*"]), ("c", ["c", "cd", "*"])], "value string, levels array<string>")
    df = people(spark, 12)
    d = Definition(("a", "b", "c"), {**definition().hierarchies, "a": Hierarchy.explicit(listed, 2)}, sensitive=("s",))
    extra = L.search_columns(d, models, quality)
    prepared = L.prepare(df, d, extra)
    coded = L.replace(prepared, coded=L.coded_tuples(prepared, d, extra))
    one, two = ({r["node"]: r for r in L.scores(df, d, models, quality, 0.2, prepared=p).collect()} for p in (prepared, coded))
    assert one.keys() == two.keys() and len(one) == 24
    for node, r in one.items():
        assert tuple(two[node])[1:5] == tuple(r)[1:5] and two[node]["loss"] == pytest.approx(r["loss"]) and two[node]["valid"] == r["valid"]


def test_frontier_leaves_nothing_out():
    """Whatever fails, taking all cones reaches every minimal node that doesn't."""
    rng = random.Random(3)
    for _ in range(30):
        high = [rng.randint(1, 3) for _ in range(4)]
        roots = [tuple(rng.randint(0, h) for h in high) for _ in range(3)]
        holds = lambda n: any(all(a >= b for a, b in zip(n, r)) for r in roots)
        walk = L.Frontier([0] * 4, high, [[0.1 * k for k in range(h + 1)] for h in high], True)
        met = set()
        while taken := walk.take(3, math.inf):
            for node in taken:
                if holds(node):
                    met.add(node)
                else:
                    walk.fail(node)
                    walk.raise_from(node, node)
        minimal = {r for r in roots if not any(q != r and all(a >= b for a, b in zip(r, q)) for q in roots)}
        assert minimal <= met


def test_running_totals_and_lookups_over_ranges(spark):
    rng = random.Random(4)
    values = sorted(rng.sample(range(10_000), 300))
    rows = [(None, 5)] + [(v, rng.randrange(9)) for v in values]
    dealt = dealt_by_range(spark.createDataFrame(rows, "v int, n bigint"), ["v"], 7)
    got = {r["v"]: r["t"] for r in running_total(dealt, ["v"], F.col("n"), "t").collect()}
    total, want = 0, {}
    for v, n in rows:
        total += n
        want[v] = total
    assert got == want
    points = spark.createDataFrame([(float(v), v * 2) for v in values], "key double, w int")
    asked = [float(rng.randrange(-5, 10_010)) for _ in range(200)] + [float(v) for v in values[:20]]
    queries = spark.createDataFrame(list(enumerate(asked)), "q int, key double").repartition(3)
    found = {r["q"]: r["_point"] and r["_point"]["w"] for r in last_below(points, queries, "key", 5).collect()}
    plain = lambda x: (k := bisect.bisect_left(values, x)) and values[k - 1] * 2 or None
    assert found == {q: plain(x) for q, x in enumerate(asked)}


def plain_ordered(rows, values):
    total = collections.Counter(v for _, v in rows)
    out = {}
    for g in {g for g, _ in rows}:
        own = collections.Counter(v for h, v in rows if h == g)
        p = q = walk = 0
        for v in values:
            p += own[v] / sum(own.values())
            q += total[v] / len(rows)
            walk += abs(p - q)
        out[g] = walk / max(len(values) - 1, 1)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_ordered_t_closeness_of_many_values(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab" if seed else "a"), rng.choice([None, *range(rng.choice([1, 5, 400]))])) for _ in range(300)]
    values = sorted({v for _, v in rows}, key=lambda v: (v is not None, v or 0))
    counted = spark.createDataFrame(rows, "g string, s int").groupBy("g", "s").agg(F.count("*").alias("cnt"))
    got = {r["g"]: r["value"] for r in P.OrderedTCloseness("s", 0.1).measure(counted, ["g"]).collect()}
    assert got == pytest.approx(plain_ordered(rows, values))


def test_bayes_grid(spark):
    """All cells at once equal one classifier after the other, with values only met in testing, NULL and an empty cell."""
    rng = random.Random(6)
    draw = lambda: (rng.choice("uvw"), rng.choice(["m", "n", None]))
    train = [(c, *draw(), rng.choice("yz"), rng.randint(1, 4)) for c in (0, 1) for _ in range(40)]
    test = [(c, *draw(), rng.choice("yz"), 1) for c in (0, 1) for _ in range(30)] + [(0, "new", "m", "y", 2), (2, "u", "m", "y", 3)]
    schema = "cell int, a string, b string, t string, cnt bigint"
    got = M.bayes_grid(spark.createDataFrame(train, schema), spark.createDataFrame(test, schema), ["cell"], "t", ["a", "b"])
    want = collections.Counter()
    for c, a, b, t, n in test:
        mine = [r for r in train if r[0] == c]
        scores = []
        for y in sorted({r[3] for r in mine}):
            of = [r for r in mine if r[3] == y]
            m = sum(r[4] for r in of)
            score = math.log(m / sum(r[4] for r in mine))
            for k, v in ((1, a), (2, b)):
                score += math.log((sum(r[4] for r in of if r[k] == v) + 1) / (m + len({r[k] for r in mine})))
            scores.append((-round(score, 9), y))
        want[c, t, min(scores)[1] if scores else None] += n
    assert {(r["cell"], r["t"], r["predicted"]): r["cnt"] for r in got.collect()} == dict(want)
