import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from cartoload.session import configure

    session = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp")).getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield configure(session)
    session.stop()


@pytest.fixture
def one(spark):
    """Value of one column expression over typed inputs: ``one(expr, "a int, b string", (1, "x"))``."""
    def run(expression, schema="x int", row=(1,)):
        return spark.createDataFrame([row], schema).select(expression.alias("out")).first().out

    return run
