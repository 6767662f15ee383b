import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from aerolith.session import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session("tests", master="local[4]", partitions=4)
    yield s
    s.stop()


@pytest.fixture
def series(spark):
    """Build a table of one or more stations from column lists."""

    def make(station_id=1, **columns):
        from datetime import datetime, timedelta

        n = len(next(iter(columns.values())))
        start = datetime(2024, 1, 1)
        rows = [
            (station_id, start + timedelta(hours=i), *[None if c[i] is None else float(c[i]) for c in columns.values()])
            for i in range(n)
        ]
        schema = "station_id int, time timestamp_ntz, " + ", ".join(f"{c} double" for c in columns)
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def values():
    """The values of a column in time order."""

    def get(df, column):
        return [r[column] for r in df.orderBy("station_id", "time").collect()]

    return get
