import json

from pyspark.sql import functions as F

from cloakframe.operators import ml as M
from cloakframe.session import materialize, scratch_path, shared_dir
from cloakframe.sources import files as IO


def test_csv_keeps_null_and_text(spark):
    df = spark.createDataFrame([("1", None, "x;y"), ("2", "b", "ü")], "a string, b string, c string")
    path = scratch_path(spark, "t")
    IO.write_csv(df, path)
    assert sorted(IO.read_csv(spark, path, df.columns).collect()) == sorted(df.collect())


def test_decimal_comma(spark):
    df = spark.createDataFrame([(0.125,), (3.0,)], "v double")
    path = scratch_path(spark, "t")
    IO.write_csv(IO.with_decimal_comma(df, ["v"]), path)
    text = IO.read_csv(spark, path, ["v"])
    assert sorted(r["v"] for r in text.collect()) == ["0,125", "3,0"]
    assert sorted(r["v"] for r in IO.from_decimal_comma(text, ["v"]).collect()) == [0.125, 3.0]


def test_partitioned_layout(spark):
    df = spark.range(20).select("id", (F.col("id") % 2).cast("int").alias("fold"), (F.col("id") % 5).cast("int").alias("k"))
    path = scratch_path(spark, "t")
    IO.write_csv(df, path, partition_by=["fold", "k"])
    back = IO.read_grid(spark, path, "id bigint, fold int, k int")
    assert sorted(back.select(*df.columns).collect()) == sorted(df.collect())
    plan = back.filter("k = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(k" in plan


def test_stats_tree(spark, tmp_path):
    for fold, k in ((0, 5), (3, 20)):
        folder = tmp_path / f"fold_{fold}" / f"k{k}"
        folder.mkdir(parents=True)
        body = {"node": [1, 0], "QID": ["a", "b"], "suppressed in sample": k, "sample size": 9, "input size": 9 + k, "equivalence classes": 2, "average EQ size": 4.5}
        (folder / "stats.json").write_text(json.dumps(body, indent=2))
    got = {(r["fold"], r["k"], r["suppressed in sample"], tuple(r["node"])) for r in IO.read_stats_tree(spark, str(tmp_path)).collect()}
    assert got == {(0, 5, 5, (1, 0)), (3, 20, 20, (1, 0))}


def test_hierarchy_file(spark):
    table = spark.createDataFrame([("a", ["a", "x", "*"]), ("b", ["b", "x", "*"])], "value string, levels array<string>")
    path = scratch_path(spark, "t")
    IO.write_hierarchy(table, path, 3)
    assert sorted(IO.read_hierarchy(spark, path, 3).collect()) == sorted(table.collect())


def test_output_as_new_input_and_columns(spark):
    df = spark.createDataFrame([(1, "7", "x")], "a int, b string, c string")
    out = IO.pick_columns(df, [(0,), ("b", "n", "int"), ("c", "d", "int")])
    assert out.columns == ["a", "n", "d"] and tuple(out.first()) == (1, 7, None)
    assert IO.pick_columns(out, [(1,)]).first()["n"] == 7


def test_intermediate_tables_use_the_configured_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert materialize(spark.range(3).toDF("x"), "t").inputFiles()[0].find(shared_dir(spark).rstrip("/")) >= 0


def test_saved_model_predicts_alike(spark):
    rows = [("u" if i % 3 else "v", "p" if i % 3 else "q") for i in range(60)]
    df = spark.createDataFrame(rows, "t string, x string")
    predicted, model = M.fit_predict(df, df, "t", ["x"], kind=M.FOREST, rounds=3)
    assert predicted.filter("t <> predicted").count() == 0
    path = scratch_path(spark, "model")
    M.save_experiment(model, M.evaluate(df, df, "t", ["x"], kind=M.FOREST, rounds=3), path)
    loaded, report = M.load_experiment(path, "label string, precision double, recall double, f1 double, support bigint")
    assert loaded.transform(df).count() == 60 and report.count() == 5
