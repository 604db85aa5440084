import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wattframe.session import local_session  # noqa: E402

SCHEMA = "area string, ts timestamp_ntz, series string, value double"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def readings(spark):
    """Rows of one series from (time, value) pairs, or of several from a dict."""

    def build(data, area="a", step=3600, start="2024-01-01 00:00:00"):
        origin = dt.datetime.fromisoformat(start)
        data = data if isinstance(data, dict) else {"x": data}
        rows = []
        for series, values in data.items():
            for i, value in enumerate(values):
                when, value = value if isinstance(value, tuple) else (origin + dt.timedelta(seconds=step * i), value)
                when = dt.datetime.fromisoformat(when) if isinstance(when, str) else when
                rows.append((area, when, series, None if value is None else float(value)))
        return spark.createDataFrame(rows, SCHEMA)

    return build


@pytest.fixture
def values():
    """Values of a result in time order."""

    def read(df, column="value", series=None):
        df = df if series is None else df.where(df.series == series)
        return [r[column] for r in df.orderBy("area", "series", "ts").collect()]

    return read
