import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rollcall.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("8", shuffle_partitions=4, memory="6g")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rollcall-test-"))
    yield session
    session.stop()


@pytest.fixture()
def days(spark):
    """Build a frame with a ``day`` column from (n-th day, ...) rows."""
    import datetime as dt

    from pyspark.sql import functions as F

    def make(rows, schema):
        df = spark.createDataFrame(rows, schema)
        start = F.lit(dt.date(2024, 1, 1))
        return df.withColumn("day", F.date_add(start, F.col("day") - 1))

    return make
