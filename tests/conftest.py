import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from bazaarlens.session import local_session

    return local_session(os.environ.get("BENCH_CPUS", "8"), "tests")


@pytest.fixture(scope="session")
def value(spark):
    """Value of one column expression over one text."""

    def run(text, build):
        from pyspark.sql import functions as F

        return spark.createDataFrame([(text,)], "t string").select(build(F.col("t")).alias("v")).first()["v"]

    return run
