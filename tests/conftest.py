import datetime as dt

import pytest

from tidegrid.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hourly(spark):
    """Build an hourly frame from a list of values, starting 2024-01-01."""

    def build(values, series=None, start=dt.datetime(2024, 1, 1)):
        rows = [(series, start + dt.timedelta(hours=i), v) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "series string, ts timestamp_ntz, y double")

    return build
