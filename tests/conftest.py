import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfspark.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate a column function over a list of single values."""
    def run(fn, items, kind="string"):
        from pyspark.sql import functions as F
        df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
        return [r["out"] for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]
    return run
