"""Batch = stream checks and a sample of the oracle comparison; the full one is ``python -m checks.compare``."""

import pytest

from barweave.session import local_session  # noqa: F401
from checks import compare
from checks.catalog import QUERIES
from checks.oracle_queries import ORACLES

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "bars_1m", "resample_4h", "dedup_bars", "store_bars", "missing_bars", "signal_cycle", "actionable_signals",
    "buy_signal", "persistence", "unified_signal", "stream_ohlcv_1m", "stream_late_data", "stream_persistence",
    "latest_quotes", "order_flow",
)


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, name):
    line = compare.check(spark, compare.connect(SF), SF, name)
    assert line.startswith("OK"), line


def test_stream_signals_give_one_row_per_symbol_and_closed_minute(spark):
    rows = QUERIES["stream_signals"](spark, SF).collect()
    closed = QUERIES["stream_ohlcv_1m"](spark, SF).select("symbol", "ts").collect()
    assert sorted((r.symbol, r.updated_at) for r in rows) == sorted(map(tuple, closed))
    assert {r.direction for r in rows} <= {"BUY", "SELL", "HOLD"}
