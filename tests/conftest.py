import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vitaloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def texts(spark):
    """Evaluate one column expression over texts: ``texts(build, "text", ...)`` returns the values in order."""
    from pyspark.sql import functions as F

    def run(build, *values):
        df = spark.createDataFrame(list(enumerate(values)), "n int, text string")
        out = df.select("n", build(F.col("text"), F.lower("text")).alias("v")).orderBy("n").collect()
        return [r["v"] for r in out]

    return run
