import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.definition import Definition, Hierarchy
from cloakframe.functions import text
from cloakframe.operators import anonymize as A
from cloakframe.operators import classes as C
from cloakframe.operators import describe as D
from cloakframe.operators import dp as DP
from cloakframe.operators import hierarchies as H
from cloakframe.operators import lattice as L
from cloakframe.operators import ml as M
from cloakframe.operators import privacy as P
from cloakframe.operators import risk as R
from cloakframe.operators import select as X
from tests.fixtures import diseases, listed, patients


def noisy(spark, n=600):
    rng = random.Random(4)
    rows = [(i, f"a{rng.randint(0, 5)}", f"b{rng.randint(0, 3)}", f"c{rng.randint(0, 7)}", rng.choice("uvw"), rng.randint(0, 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, a string, b string, c string, s string, fold int")
    a = listed(spark, [(f"a{i}", f"A{i // 2}", "*") for i in range(6)])
    c = listed(spark, [(f"c{i}", f"C{i // 2}", f"D{i // 4}", "*") for i in range(8)])
    return df.withColumn("fold", (F.col("id") % 10).cast("int")), Definition(("a", "b", "c"), {"a": a, "c": c}, target="s")


def test_local_recoding_keeps_rows_and_k(spark):
    df, d = noisy(spark)
    out = A.local_recoding(df, d, [P.KAnonymity(12)], 0.2).cache()
    assert out.count() == 600 and out.select("id").distinct().count() == 600
    sizes = out.filter("round > 0").groupBy("round", "a", "b", "c").count().agg(F.min("count")).first()[0]
    assert sizes >= 12
    assert out.filter("round = 0").filter("a <> '*' or b <> '*' or c <> '*'").count() == 0


def test_greedy_against_all_nodes(spark):
    df, d = noisy(spark)
    every = {r["node"]: r for r in L.scores(df, d, [P.KAnonymity(12)], suppression=0.05).collect()}
    best = min((r["loss"] for r in every.values() if r["valid"]))
    for top_down in (False, True):
        found = A.greedy(df, d, [P.KAnonymity(12)], suppression=0.05, top_down=top_down).first()
        assert every[found["node"]]["valid"]
        assert found["loss"] == pytest.approx(every[found["node"]]["loss"])
        assert best <= found["loss"] + 1e-9


def test_greedy_on_many_columns(spark):
    df, d = patients(spark)
    names, hier, wide = [], {}, df
    for i in range(8):
        for q in d.qid:
            wide = wide.withColumn(f"{q}{i}", F.col(q))
            names.append(f"{q}{i}")
            hier[f"{q}{i}"] = d.hierarchies[q]
    found = A.greedy(wide, Definition(tuple(names), hier), [P.KAnonymity(2)], suppression=1.0, steps=2, top_down=True).first()
    assert found["rows"] == 7 and found["loss"] <= 1.0


def test_grid_equals_single_runs(spark):
    df, d = noisy(spark)
    grid = {(r["fold"], r["k"]): r for r in A.grid_search(df, d, 10, [5, 25]).collect()}
    assert len(grid) == 20
    for fold, k in ((0, 5), (7, 25)):
        one = L.optimum(L.scores(df.filter(F.col("fold") != fold), d, [P.KAnonymity(k)], suppression=1.0)).first()
        got = grid[(fold, k)]
        assert (got["node"], got["suppressed"], got["classes"]) == (one["node"], one["suppressed"], one["classes"])
        assert got["loss"] == pytest.approx(one["loss"])


def test_scores_of_bounded_nodes_match_full(spark):
    df, d = noisy(spark)
    full = {r["node"]: r for r in L.scores(df, d, [P.KAnonymity(9), P.DistinctLDiversity("s", 3)], suppression=0.3).collect()}
    some = [(0, 1, 2), (2, 0, 0), (1, 1, 3)]
    part = L.scores(df, d, [P.KAnonymity(9), P.DistinctLDiversity("s", 3)], suppression=0.3, chosen=some).collect()
    assert {r["node"] for r in part} == {"0,1,2", "2,0,0", "1,1,3"}
    for r in part:
        want = full[r["node"]]
        assert r["loss"] == pytest.approx(want["loss"])
        assert (r["rows"], r["suppressed"], r["classes"], r["valid"]) == (want["rows"], want["suppressed"], want["classes"], want["valid"])
    one = L.scores(df, d, [P.KAnonymity(9), P.DistinctLDiversity("s", 3)], suppression=0.3, chosen=[(0, 1, 2)]).first()
    assert one["loss"] == pytest.approx(full["0,1,2"]["loss"]) and one["suppressed"] == full["0,1,2"]["suppressed"]


def brute_tree_emd(p, q, paths):
    height, total = len(paths[next(iter(paths))]) - 1, 0.0
    for h in range(1, height + 1):
        for node in {path[h] for path in paths.values()}:
            extra = {}
            for v, path in paths.items():
                if path[h] == node:
                    extra[path[h - 1]] = extra.get(path[h - 1], 0.0) + p.get(v, 0) - q.get(v, 0)
            up = sum(x for x in extra.values() if x > 0)
            down = -sum(x for x in extra.values() if x < 0)
            total += h / height * min(up, down)
    return total


def test_tree_distance_against_definition(spark):
    df, d, tree = diseases(spark)
    got = P.check(df.withColumn("zipcode", F.substring("zipcode", 1, 4)), ["zipcode"], [P.HierarchicalTCloseness("disease", 0.6, tree)]).collect()
    rows = [(r["zipcode"][:4], r["disease"]) for r in df.collect()]
    paths = {r["value"]: r["levels"] for r in tree.table.collect()}
    share = lambda vs: {v: vs.count(v) / len(vs) for v in vs}
    q = share([v for _, v in rows])
    for r in got:
        p = share([v for z, v in rows if z == r["zipcode"]])
        assert r["value_0"] == pytest.approx(brute_tree_emd(p, q, paths))


def test_ordered_distance(spark):
    salaries = [3, 4, 5, 6, 11, 8, 7, 9, 10]
    classes = ["x", "x", "x", "y", "y", "y", "z", "z", "z"]
    df = spark.createDataFrame(list(zip(classes, salaries)), "c string, s int")
    got = {r["c"]: r["value_0"] for r in P.check(df, ["c"], [P.OrderedTCloseness("s", 0.2)]).collect()}
    assert got["x"] == pytest.approx(0.375)  # worked example of the paper
    assert got["y"] == pytest.approx(1 / 6, abs=1e-3)


def test_estimated_kmap_and_dp_size():
    assert P.poisson_below(3, 2.0) == pytest.approx(math.exp(-2) * (1 + 2 + 2))
    n = P.smallest_sample_class(50, 0.1, 0.5)
    assert P.poisson_below(50, n / 0.5) <= 0.1 < P.poisson_below(50, (n - 1) / 0.5)
    eps, delta = 1.0, 1e-4
    beta = 1 - math.exp(-eps)
    gamma = (math.exp(eps) - 1 + beta) / math.exp(eps)
    tail = lambda n: sum(math.comb(n, j) * beta**j * (1 - beta) ** (n - j) for j in range(math.floor(gamma * n) + 1, n + 1))
    worst = lambda k: max(tail(n) for n in range(max(1, math.ceil(k / gamma - 1)), 300))
    k = DP.class_size_for(eps, delta)
    assert worst(k) <= delta < worst(k - 1)


def test_wildcard_sizes_against_pairs(spark):
    rng = random.Random(2)
    rows = [tuple(rng.choice(["*", "a", "b"]) for _ in range(3)) for _ in range(80)]
    got = {(r["x"], r["y"], r["z"]): (r["cnt"], r["matches"]) for r in R.wildcard_sizes(spark.createDataFrame(rows, "x string, y string, z string"), ["x", "y", "z"]).collect()}
    fits = lambda a, b: all(p == q or "*" in (p, q) for p, q in zip(a, b))
    for t in set(rows):
        assert got[t] == (rows.count(t), sum(fits(t, u) for u in rows))


@pytest.mark.parametrize("parts", [1, 7])
def test_quantiles(spark, monkeypatch, parts):
    """Groups that share a range and groups over several; values that crowd around a wanted rank; weights."""
    deal = A.dealt_by_range
    monkeypatch.setattr(A, "dealt_by_range", lambda values, order: deal(values, order, parts))
    rng = random.Random(9)
    sizes = {"one": 1, "two": 2, "six": 6, "many": 30_000}
    rows = [(g, float(rng.randint(0, 5000))) for g, n in sizes.items() for _ in range(n)]
    crowd = [0.0] * 5_001 + [1.0 + k * 1e-9 for k in range(4_999)] + [1e9 * k for k in range(5_000)]
    rows += [("crowd", v) for v in crowd] + [(None, float(k)) for k in range(11)] + [("one", None), ("none", None)]
    probs = [0.0, 0.25, 0.5, 1 / 3, 0.9, 1.0]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["prob"]): r["value"] for r in A.group_quantiles(df, ["g"], "v", probs).collect()}
    groups = {*sizes, "crowd", None}
    assert {g for g, _ in got} == groups
    for g in groups:
        for p in probs:
            assert got[(g, p)] == pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None], p), rel=1e-12)
    merged = df.where("v IS NOT NULL").groupBy("g", "v").agg(F.count("*").alias("w"))
    weighed = {(r["g"], r["prob"]): r["value"] for r in A.group_quantiles(merged, ["g"], "v", probs, "w").collect()}
    assert weighed == got


def test_microaggregation_ignores_nulls(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", None), ("x", 4.0), ("y", None)], "g string, v double")
    for how, want in (("mean", 2.5), ("geomean", 2.0), ("median", 2.5), ("mode", 1.0)):
        got = A.microaggregate(df, ["g"], "v", how, "m").collect()
        assert [r["m"] for r in got if r["g"] == "x"] == pytest.approx([want] * 3)
        assert [r["m"] for r in got if r["g"] == "y"] == [None]


def test_selector(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "y")], "p string, q string")
    s = X.Selector.field("p").equals("a").or_().equals("b").and_().on("q").equals("x")
    assert sorted((r["p"], r["q"]) for r in X.where(df, s).collect()) == [("a", "x"), ("a", "y"), ("b", "x")]
    g = X.Selector().group(X.Selector.field("p").equals("a").or_().equals("b")).and_().on("q").equals("x")
    assert sorted(r["p"] for r in X.where(df, g).collect()) == ["a", "b"]


def test_subset_match_counts_copies(spark):
    left = spark.createDataFrame([(i, "v") for i in range(5)] + [(9, "w")], "id bigint, t string")
    right = spark.createDataFrame([(1, "v"), (2, "v"), (3, "z")], "id bigint, t string")
    assert X.subset_match(left, right, ["t"], ["id"], ["id"]).count() == 2


def test_interval_labels_and_bounds(spark):
    h = H.intervals([1.8, 0.8, 0.8, 0.7, 0.8, 5.1], 0, 0, 10, [[2, 2, 2], [2, 1]],
                    [["very low", "low", "normal", "borderline high", "high", "very high"], ["low", "normal", "high"], ["low-normal", "high"]])
    df = spark.createDataFrame([(1.0,), (2.0,), (4.5,), (-1.0,), (10.0,), (None,)], "v double")
    got = {r["v"]: r["l"] for r in df.select("v", h.levels(F.col("v")).alias("l")).collect()}
    assert got[1.0] == ["1.0", "very low", "low", "low-normal", "*"]
    assert got[2.0][1:] == ["low", "low", "low-normal", "*"]
    assert got[4.5][1:] == ["high", "high", "high", "*"]
    assert got[-1.0][1] == "<0" and got[10.0][1] == ">=10"
    assert got[None] == [None, None, None, None, "*"]


def test_interval_bounds(spark):
    """Snapping, bound labels and the range part on both sides; spans are found at every edge."""
    h = H.intervals([3, 1, 2], 0, H.Bound(7, 5, 2), H.Bound(20, 23, 30), [[1, 2]])
    df = spark.createDataFrame([(float(x) / 2,) for x in range(70)], "v double")
    got = {r["v"]: r["l"][1:3] for r in df.select("v", h.levels(F.col("v")).alias("l")).collect()}
    assert got[1.5] == [None, None] and got[30.0] == [None, None] and got[2.0] == ["<5", "<5"] and got[29.5] == [">=23", ">=23"]
    # 7 lies in [6, 9[, which is extended to 5; the interval below 20, [18, 21[, to 23.
    assert got[5.0] == got[6.5] == got[8.5] == ["[5, 9[", "[5, 9["]
    assert got[18.0] == got[20.0] == got[22.5] == ["[18, 23[", "[18, 23["]
    starts = [0, 3, 4, 6, 9, 10, 12, 15, 16, 18]
    for v in (9.0, 9.5, 10.0, 11.5, 12.0, 14.5, 15.0, 15.5, 16.0, 17.5):
        k = max(j for j, s in enumerate(starts) if s <= v)
        assert got[v][0] == f"[{starts[k]}, {starts[k + 1]}["
    assert got[9.5][1] == got[11.5][1] == "[9, 12["


def test_redaction_sides(spark):
    df = spark.createDataFrame([("12",)], "v string")
    right = H.redaction(3).levels(F.col("v"))
    left = H.redaction(3, right_to_left=False, align_left=False, pad="0").levels(F.col("v"))
    row = df.select(right.alias("r"), left.alias("l")).first()
    assert row["r"] == ["12", "12*", "1**", "***"]
    assert row["l"] == ["12", "*12", "**2", "***"]


def test_midpoints_and_stars(spark):
    df = spark.createDataFrame([("[20, 40[", "*", "*"), ("7", "*", "b")], "a string, b string, c string")
    got = M.ranges_to_midpoints(df, ["a", "b"]).collect()
    assert [(r["a"], r["b"]) for r in got] == [(30.0, 0.0), (7.0, 0.0)]
    assert [(r["b"], r["c"]) for r in M.starred_to_number(df, ["b", "c"]).collect()] == [("-1", "*"), ("-1", "b")]


def test_mean_spread_rounds_ties_to_even(spark):
    row = spark.range(1).select(text.mean_spread(F.lit(12.25), F.lit(None).cast("double")).alias("t")).first()
    assert row["t"] == "12.2 ± nan"


def test_common_prefix(spark):
    df = spark.createDataFrame([("g", "abcx"), ("g", "abd"), ("h", "q"), ("i", "x"), ("i", "y")], "g string, v string")
    got = {r["g"]: r["value"] for r in D.aggregate_values(df, ["g"], "v", "common_prefix_redacted").collect()}
    assert got == {"g": "ab**", "h": "q", "i": "*"}


def test_null_keys_form_a_class(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id bigint, q string")
    assert {(r["id"], r["class_size"]) for r in C.with_class_size(df, ["q"]).collect()} == {(1, 2), (2, 2), (3, 1)}
    out = A.suppress(df, ["q"], [P.KAnonymity(2)]).collect()
    assert {(r["id"], r["q"]) for r in out} == {(1, None), (2, None), (3, "*")}


def test_report_arithmetic(spark):
    df = spark.createDataFrame([("a", "a", 3), ("a", "b", 1), ("b", "b", 2), ("c", "a", 1)], "l string, p string, c bigint")
    got = {r["label"]: r for r in M.classification_report(df, [], "l", "p", "c").collect()}
    assert got["a"]["precision"] == pytest.approx(0.75) and got["a"]["recall"] == pytest.approx(0.75)
    assert got["c"]["precision"] == 0.0 and got["c"]["support"] == 1
    assert got["accuracy"]["f1"] == pytest.approx(5 / 7)
    assert got["macro avg"]["recall"] == pytest.approx((0.75 + 1 + 0) / 3)
    assert got["weighted avg"]["recall"] == pytest.approx(5 / 7)


def test_identifier_scan(spark):
    columns = ["first name", "age", "code", "birth", "email-address", "SSN", "Bank", "Vehicle", "URL", "IP", "phone"]
    rows = [
        ("Max", "34", "81667", "2008-09-02", "", "123-45-6789", "GR16 0110 1250 0000 0001 2300 695", "", "http://demodomain.com", "8.8.8.8", "+49 1234566"),
        ("Max", "90", "81675", "2008-09-02", "user@mail.org", "", "", "WDD 169 007-1J-236589", "", "", ""),
    ]
    found = {(r["column"], r["identifier"]) for r in R.hipaa_scan(spark.createDataFrame(rows, columns), columns).collect()}
    for pair in (("first name", "name"), ("age", "age_over_89"), ("code", "zip"), ("birth", "date"), ("email-address", "email"),
                 ("SSN", "ssn"), ("Bank", "iban"), ("Vehicle", "vin"), ("URL", "url"), ("IP", "ip"), ("phone", "phone")):
        assert pair in found


def test_trivial_hierarchy_is_the_default():
    assert Definition(("x",)).hierarchy("x").height == Hierarchy.trivial().height == 1
