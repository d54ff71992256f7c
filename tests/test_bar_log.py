"""Bars stored as a log of loads: stops, repeats, compaction, months; corrections by late ticks."""

import datetime as dt

import pytest
from barweave.operators import bars as b
from barweave.sources import files, market_tables as m
from barweave.sources.keyed_log import VERSION
from barweave.sources.monthly_log import MonthlyLog
from barweave.streaming import flows
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DAYS = [dt.datetime(2024, month, 5) for month in (1, 2, 3, 4)]


def bars(spark, closes, days=DAYS, symbol="A"):
    rows = [(symbol, day, c, c, c, c, 1) for day, c in zip(days, closes, strict=False)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume bigint")


def closes(spark, path, **span):
    return [r.close for r in files.read_stored_bars(spark, path, **span).orderBy("ts").collect()]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_stopped_load_loses_nothing(spark, tmp_path):
    path = f"{tmp_path}/bars"
    files.store_bars(spark, path, bars(spark, [1.0, 2.0, 3.0]))
    fails = F.when(F.col("ts") >= F.lit("2024-02-01").cast("timestamp"), F.raise_error(F.lit("stopped"))).otherwise(F.col("close"))
    with pytest.raises(Exception, match="stopped"):
        files.store_bars(spark, path, bars(spark, [8.0, 9.0]).withColumn("close", fails.cast("double")))
    assert closes(spark, path) == [1.0, 2.0, 3.0]
    assert files.store_bars(spark, path, bars(spark, [8.0])) == 1  # the stopped load's number is used again
    assert closes(spark, path) == [8.0, 2.0, 3.0]
    log = MonthlyLog(spark, path)
    log.compact(1)
    (tmp_path / "bars" / "base=1" / "_SUCCESS").unlink()  # a compaction that stopped before its commit
    assert closes(spark, path) == [8.0, 2.0, 3.0]
    log.compact(1)
    assert closes(spark, path) == [8.0, 2.0, 3.0]


def test_compaction_takes_shared_months_and_drops_one_generation_later(spark, tmp_path):
    path = f"{tmp_path}/bars"
    log = MonthlyLog(spark, path)
    log.append(bars(spark, [1.0, 2.0, 3.0, 4.0]))
    log.append(bars(spark, [5.0]))
    log.compact(1)
    assert log.live() == {"202401": ["base=1"], "202402": ["version=0"], "202403": ["version=0"], "202404": ["version=0"]}
    assert "Exchange" not in plan_of(log.read()) and (tmp_path / "bars/version=0/month=202401").exists()
    log.append(bars(spark, [6.0, 7.0]))
    before = plan_of(log.read(start="2024-04-01 00:00:00"))
    assert "PartitionFilters" in before and closes(spark, path) == [6.0, 7.0, 3.0, 4.0]
    assert closes(spark, path, start="2024-02-01 00:00:00", end="2024-03-31 00:00:00") == [7.0, 3.0]
    log.compact(2)
    assert not (tmp_path / "bars/version=0/month=202401").exists() and (tmp_path / "bars/version=0/month=202402").exists()
    assert (tmp_path / "bars/base=1/month=202401").exists()
    assert closes(spark, path) == [6.0, 7.0, 3.0, 4.0] and [r.close for r in log.read(before=2).orderBy("ts").collect()][1:] == [2.0, 3.0, 4.0]


def test_odd_bars_are_stored(spark, tmp_path):
    path = f"{tmp_path}/bars"
    assert MonthlyLog(spark, path).read().count() == 0
    files.store_bars(spark, path, bars(spark, []))
    assert MonthlyLog(spark, path).read().count() == 0
    odd = bars(spark, [1.0, 1.0, 2.0], [DAYS[0], DAYS[0], None])
    files.store_bars(spark, path, odd.unionByName(bars(spark, [3.0], symbol=None)))
    assert sorted((r.symbol or "", str(r.ts), r.close) for r in files.read_stored_bars(spark, path).collect()) == [("", str(DAYS[0]), 3.0), ("A", str(DAYS[0]), 1.0), ("A", "None", 2.0)]
    files.store_bars(spark, path, bars(spark, [5.0], [None]))
    assert sorted(r.close for r in files.read_stored_bars(spark, path).collect()) == [1.0, 3.0, 5.0]
    assert sorted(closes(spark, path, start="2024-01-01 00:00:00", end="2024-12-31 00:00:00")) == [1.0, 3.0]


def test_late_ticks_correct_their_bars_in_any_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(flows, "COMPACT_EVERY", 2)
    ticks = m.ticks(spark, SF).select("symbol", "ts", "seq", "ltp", "ltq")
    src, base = f"{tmp_path}/src", f"{tmp_path}/out"
    for i in (3, 1, 4, 0, 2):  # parts of every minute, in no order of time
        ticks.where(F.col("seq") % 5 == i).coalesce(1).write.mode("append").parquet(src)
        stream = flows.read_stream(spark, src, ticks.schema, files_per_batch=1)
        got, late = flows.run_corrected_bars(spark, stream, delay="30 seconds", base=base, checkpoint=f"{tmp_path}/state")
    wanted = b.ohlcv_bars(ticks)
    assert sorted(map(str, got.select(wanted.columns).collect())) == sorted(map(str, wanted.collect()))
    counted = {r.batch: r for r in late.collect()}
    assert sorted(counted) == [0, 1, 2, 3, 4] and counted[0].late_ticks == 0
    assert sum(r.ticks for r in counted.values()) == ticks.count() and all(counted[i].late_ticks > 0 for i in (1, 2, 3, 4))
    assert "ObjectHashAggregate" not in plan_of(got) and "SortAggregate" not in plan_of(got)


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    ticks = m.ticks(spark, SF).select("symbol", "ts", "seq", "ltp", "ltq")
    log = MonthlyLog(spark, f"{tmp_path}/parts", flows.PART_BAR, flows.merge_parts)
    for _ in range(2):
        log.write(flows.part_bars(ticks, "1 minute"), 0)
    log.write(flows.part_bars(ticks.where("false"), "1 minute"), 1)
    wanted = b.ohlcv_bars(ticks)
    assert sorted(map(str, log.read().drop(VERSION).select(wanted.columns).collect())) == sorted(map(str, wanted.collect()))
