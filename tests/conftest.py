import os
import tempfile

import pytest
from pyspark.sql import SparkSession

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def session(**settings: str) -> SparkSession:
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("cloakframe-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="cloakframe-test-"))
    return spark


@pytest.fixture(scope="session")
def spark():
    # Tiny tables in hundreds of different plans: compiling them would take most of the time.
    return session(**{
        "spark.sql.shuffle.partitions": "2",
        "spark.sql.codegen.wholeStage": "false",
        "spark.sql.codegen.factoryMode": "NO_CODEGEN",
    })


@pytest.fixture(scope="session")
def sf():
    return SF
