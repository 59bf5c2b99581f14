import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lectern.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session(8, "lectern-tests", "6g")


@pytest.fixture
def one(spark):
    """Evaluate a column expression over one row: ``one(expr, a=.., b=..)``."""
    from pyspark.sql import functions as F

    def run(expr, **values):
        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
        return df.select(expr.alias("x")).first()["x"]

    return run
