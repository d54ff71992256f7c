"""What several steps read is computed once."""

import pytest
from pyspark.sql import functions as F

from barweave.operators import serving as sv
from barweave.session import tune
from checks import catalog

SF = "/root/testdata/sf0.001"


def from_lineitem(df) -> bool:
    return any("lineitem" in f for f in df.inputFiles())


@pytest.mark.parametrize("name", ["enhanced_recommendation", "signal_analytics"])
def test_features_are_computed_once(spark, monkeypatch, name):
    seen = []
    features = lambda bars, **_: bars.groupBy("symbol").agg(F.max("close").alias("close"))
    monkeypatch.setattr(catalog.cycle, "symbol_features", features)
    monkeypatch.setattr(catalog.actionable, "actionable_signals", lambda f, *_: f)
    monkeypatch.setattr(catalog.ind, "indicator_history", lambda bars: bars)
    monkeypatch.setattr(catalog.actionable, name, lambda *frames: seen.extend(frames) or frames[-1])
    catalog.QUERIES[name](spark, SF)
    assert seen and not any(map(from_lineitem, seen))


def test_appended_cycles_read_stored_bars(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(catalog.history.IndicatorLog, "append", lambda log, bars, cycle: seen.append(bars))
    monkeypatch.setattr(catalog.history.IndicatorLog, "read", lambda log, cycles: spark.range(0).select(
        *[F.lit("").alias(c) for c in ("symbol", "ts", "rsi", "macd", "macd_signal", "sma_5", "sma_20", "volume_ratio", "rn")]))
    catalog.indicator_append(spark, SF)
    assert len(seen) == 6 and not any(map(from_lineitem, seen))


def test_loads_read_stored_bars(spark, monkeypatch):
    seen = []
    append = catalog.MonthlyLog.append
    monkeypatch.setattr(catalog.MonthlyLog, "append", lambda log, rows: seen.append(rows) or append(log, rows))
    catalog.compacted_bars(spark, SF)
    assert len(seen) == 3 and not any(map(from_lineitem, seen))


def test_history_is_loaded_from_stored_bars(spark, monkeypatch):
    seen = []
    load = catalog.cycle.load_history
    monkeypatch.setattr(catalog.cycle, "load_history", lambda *frames: seen.extend(frames[:2]) or load(*frames))
    catalog.bar_metadata(spark, SF)
    assert len(seen) == 2 and not any(map(from_lineitem, seen))


def test_splits_are_bounded_unless_the_submitter_sets_them(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        for given, wanted in (("134217728b", "32m"), ("128m", "128m"), ("1g", "1g")):
            spark.conf.set(name, given)
            assert tune(spark).conf.get(name) == wanted
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("name", ["live_prices", "live_prices_fallback"])
def test_quotes_are_computed_once(spark, monkeypatch, name):
    seen = []
    live = sv.live_prices
    monkeypatch.setattr(sv, "live_prices", lambda quotes, signals: seen.append(quotes) or live(quotes, signals))
    catalog.QUERIES[name](spark, SF)
    assert len(seen) == 1 and not any("events" in f for f in seen[0].inputFiles())
