"""Nodes, losses and risks worked out by hand from the definitions."""

import pytest
from pyspark.sql import functions as F

from cloakframe.definition import Definition
from cloakframe.operators import anonymize as A
from cloakframe.operators import lattice as L
from cloakframe.operators import privacy as P
from cloakframe.operators import risk as R
from tests.fixtures import citizens, diseases, patients, states


def scored(*args, **kwargs):
    return {r["node"]: r for r in L.scores(*args, **kwargs).collect()}


def test_patients_lattice(spark):
    df, d = patients(spark)
    assert d.heights == (2, 1, 5)
    rows = scored(df, d, [P.KAnonymity(3)])
    assert len(rows) == 36
    assert sum(r["valid"] for r in rows.values()) == 9
    assert rows["1,1,3"]["loss"] == pytest.approx(7 / 9)
    assert rows["2,0,3"]["loss"] == pytest.approx(2 / 3)
    assert L.optimum(L.scores(df, d, [P.KAnonymity(3)])).first()["node"] == "2,0,3"


def test_patients_published(spark):
    df, d = patients(spark)
    out, node = A.anonymize(df, d, [P.KAnonymity(3)])
    assert node == {"age": 2, "gender": 0, "zipcode": 3}
    sizes = sorted(r["count"] for r in out.groupBy("age", "gender", "zipcode").count().collect())
    assert sizes == [3, 4]


def test_zipcode_only(spark):
    df, d = patients(spark)
    d = Definition(("zipcode",), {"zipcode": d.hierarchies["zipcode"]})
    best = L.optimum(L.scores(df, d, [P.KAnonymity(2)])).first()
    assert (best["node"], best["classes"]) == ("2", 2)
    assert best["loss"] == pytest.approx(1 / 3)


def test_hierarchical_closeness(spark):
    df, d, tree = diseases(spark)
    rows = scored(df, d, [P.KAnonymity(3), P.HierarchicalTCloseness("disease", 0.6, tree)])
    assert len(rows) == 18
    assert sum(r["valid"] for r in rows.values()) == 10
    assert rows["1,1"]["valid"] and rows["1,1"]["classes"] == 3
    assert rows["1,1"]["loss"] == pytest.approx(0.375)


def test_presence(spark):
    df, d = citizens(spark)
    rows = scored(df, d, [P.DPresence(0.5, 2 / 3)])
    assert len(rows) == 96
    assert sum(r["valid"] for r in rows.values()) == 6
    assert rows["3,3,2"]["valid"]
    assert rows["3,3,2"]["loss"] == pytest.approx(0.629630, abs=1e-6)


def test_recursive_diversity(spark):
    df, d = patients(spark)
    d = Definition(("gender", "zipcode"), {k: d.hierarchies[k] for k in ("gender", "zipcode")})
    rows = scored(df, d, [P.KAnonymity(2), P.RecursiveCLDiversity("age", 3.0, 2)])
    assert sum(r["valid"] for r in rows.values()) == 7 and len(rows) == 12
    assert rows["0,3"]["valid"] and rows["0,3"]["loss"] == pytest.approx(0.5)
    assert rows["1,2"]["valid"] and rows["1,2"]["loss"] == pytest.approx(2 / 3)


def test_attribute_risk(spark):
    got = {r["attributes"]: (r["distinction"], r["separation"]) for r in R.attribute_risk(states(spark), ["age", "sex", "state"]).collect()}
    want = {
        "age": (0.6667, 0.9242), "sex": (0.1667, 0.5455), "state": (0.5, 0.7576), "age+sex": (0.8333, 0.9697),
        "age+state": (1.0, 1.0), "sex+state": (0.5833, 0.8939), "age+sex+state": (1.0, 1.0),
    }
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=5e-5)


def test_attribute_risk_counts_null_as_a_value(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", "x")], "p string, q string")
    got = {r["attributes"]: r["classes"] for r in R.attribute_risk(df, ["p", "q"]).collect()}
    assert got == {"p": 2, "q": 2, "p+q": 2}


def test_unlisted_value_is_kept(spark):
    df, d = patients(spark)
    more = df.unionByName(spark.createDataFrame([(7, "99", "male", "81931")], df.schema))
    rows = scored(more, d, [P.KAnonymity(1)])
    assert all(r["rows"] == 8 for r in rows.values())
    out = A.publish(more, d, {"age": 1, "gender": 0, "zipcode": 0}, [P.KAnonymity(1)])
    assert out.filter(F.col("age").isNull()).count() == 1
