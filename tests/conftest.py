import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=8, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def make_bars(spark):
    """Bars from closes per symbol, one a day; high and low one unit around the close."""

    def build(series: dict[str, list[float]], volumes=None, spread=1.0):
        start = dt.datetime(2024, 1, 1)
        rows = [
            (sym, start + dt.timedelta(days=i), c, c + spread, c - spread, c, (volumes or [100])[i % len(volumes or [100])])
            for sym, closes in series.items()
            for i, c in enumerate(closes)
        ]
        return spark.createDataFrame(
            rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume bigint"
        )

    return build
