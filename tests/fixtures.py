"""Small tables with their hierarchies; expected values follow from the definitions."""

from cloakframe.definition import Definition, Hierarchy


def masks(spark, values, levels):
    rows = [[v, *[v[: len(v) - i] + "*" * i for i in range(1, levels + 1)]] for v in values]
    names = [f"l{i}" for i in range(levels + 1)]
    return Hierarchy.from_columns(spark.createDataFrame(rows, names), names)


def listed(spark, rows):
    names = [f"l{i}" for i in range(len(rows[0]))]
    return Hierarchy.from_columns(spark.createDataFrame([list(r) for r in rows], names), names)


def patients(spark):
    rows = [
        ("34", "male", "81667"), ("45", "female", "81675"), ("66", "male", "81925"), ("70", "female", "81931"),
        ("34", "female", "81931"), ("70", "male", "81931"), ("45", "male", "81931"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, age string, gender string, zipcode string")
    age = listed(spark, [("34", "<50", "*"), ("45", "<50", "*"), ("66", ">=50", "*"), ("70", ">=50", "*")])
    gender = listed(spark, [("male", "*"), ("female", "*")])
    zipcode = masks(spark, ["81667", "81675", "81925", "81931"], 5)
    return df, Definition(("age", "gender", "zipcode"), {"age": age, "gender": gender, "zipcode": zipcode})


def diseases(spark):
    rows = [
        ("47677", "29", "gastric ulcer"), ("47602", "22", "gastritis"), ("47678", "27", "stomach cancer"),
        ("47905", "43", "gastritis"), ("47909", "52", "flu"), ("47906", "47", "bronchitis"),
        ("47605", "30", "bronchitis"), ("47673", "36", "pneumonia"), ("47607", "32", "stomach cancer"),
    ]
    df = spark.createDataFrame(rows, "zipcode string, age string, disease string")
    age = listed(spark, [(a, "<=40" if int(a) <= 40 else ">40", "*") for _, a, _ in rows])
    zipcode = masks(spark, sorted({z for z, _, _ in rows}), 5)
    top = "respiratory & digestive system disease"
    lung, gut = "vascular lung disease", "digestive system disease"
    tree = listed(spark, [
        ("flu", "respiratory infection", lung, top), ("pneumonia", "respiratory infection", lung, top),
        ("bronchitis", "respiratory infection", lung, top), ("pulmonary edema", lung, lung, top),
        ("pulmonary embolism", lung, lung, top), ("gastric ulcer", "stomach disease", gut, top),
        ("stomach cancer", "stomach disease", gut, top), ("gastritis", "stomach disease", gut, top),
        ("colitis", "colon disease", gut, top), ("colon cancer", "colon disease", gut, top),
    ])
    return df, Definition(("age", "zipcode"), {"age": age, "zipcode": zipcode}), tree


def citizens(spark):
    rows = [
        ("47906", "35", "USA"), ("47903", "59", "Canada"), ("47906", "42", "USA"), ("47630", "18", "Brazil"),
        ("47630", "22", "Brazil"), ("47633", "63", "Peru"), ("48973", "33", "Spain"), ("48972", "47", "Bulgaria"),
        ("48970", "52", "France"),
    ]
    inside = {1, 2, 5, 7, 8}
    df = spark.createDataFrame([(*r, i in inside) for i, r in enumerate(rows)], "zip string, age string, nationality string, in_subset boolean")
    age = listed(spark, [(a, a[0] + "*", "<=40" if int(a) <= 40 else ">40", "*") for a in ("18", "22", "33", "35", "42", "47", "52", "59", "63")])
    nat = listed(spark, [
        ("Canada", "N. America", "America", "*"), ("USA", "N. America", "America", "*"), ("Peru", "S. America", "America", "*"),
        ("Brazil", "S. America", "America", "*"), ("Bulgaria", "E. Europe", "Europe", "*"), ("France", "W. Europe", "Europe", "*"),
        ("Spain", "W. Europe", "Europe", "*"),
    ])
    zips = listed(spark, [(z, z[:4] + "*", z[:3] + "*", z[:2] + "*", z[:1] + "*", "*") for z in ("47630", "47633", "47903", "47906", "48970", "48972", "48973")])
    return df, Definition(("zip", "age", "nationality"), {"zip": zips, "age": age, "nationality": nat})


def states(spark):
    rows = [
        ("20", "Female", "CA"), ("30", "Female", "CA"), ("40", "Female", "TX"), ("20", "Male", "NY"), ("40", "Male", "CA"), ("53", "Male", "CA"),
        ("76", "Male", "EU"), ("40", "Female", "AS"), ("32", "Female", "CA"), ("88", "Male", "CA"), ("48", "Female", "AS"), ("76", "Male", "UU"),
    ]
    return spark.createDataFrame(rows, "age string, sex string, state string")
