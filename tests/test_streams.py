"""State carried from batch to batch: the cut of a source into batches changes nothing."""

import datetime as dt
import random
import time

from barweave import params
from barweave.operators import history, serving as sv, unified as un
from barweave.operators.bars import recent_bars
from barweave.plans import cycle
from barweave.sources import market_tables as m
from barweave.sources.keyed_log import KeyedLog, newest_rows
from barweave.streaming import flows
from checks import catalog
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def in_parts(rows, path, bounds):
    """One file per part of the time range, in order; the middle parts lack one symbol."""
    for i, (first, last) in enumerate(zip(bounds, bounds[1:], strict=False)):
        part = rows.where((F.col("ts") >= F.lit(first).cast("timestamp")) & (F.col("ts") < F.lit(last).cast("timestamp")))
        part.coalesce(1).write.mode("append").parquet(path)
        yield i


BOUNDS = ["2024-01-01", "2024-01-07", "2024-01-14", "2024-01-21", "2024-03-01"]


def gap(rows):
    """Rows without symbol U1 in the middle of the month."""
    middle = (F.col("ts") >= F.lit(BOUNDS[1]).cast("timestamp")) & (F.col("ts") < F.lit(BOUNDS[3]).cast("timestamp"))
    return rows.where(~(middle & (F.col("symbol") == "U1")))


def test_persistence_over_batches_and_restarts(spark, tmp_path):
    rows = gap(catalog.decided(spark, SF).select("symbol", "ts", "seq", "raw_direction", "confidence"))
    src, out, state, checkpoint = (f"{tmp_path}/{n}" for n in ("src", "out", "state", "checkpoint"))
    for _ in in_parts(rows, src, BOUNDS):  # a new query for every part continues from the checkpoint
        stream = flows.read_stream(spark, src, rows.schema, files_per_batch=1)
        got = flows.run_persistence(spark, stream, out, state, checkpoint=checkpoint)
    columns = ["symbol", "seq", "direction", "persistence_reason"]
    wanted = un.persistence(rows).select(columns).collect()
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, wanted))
    assert len(list((tmp_path / "state").glob("batch=*"))) <= 3


def test_latest_quotes_over_batches(spark, tmp_path):
    rows = gap(m.ticks(spark, SF).select("symbol", "ts", "seq", "ltp", "ltq"))
    src = f"{tmp_path}/src"
    list(in_parts(rows, src, BOUNDS))
    got = flows.run_latest_quotes(spark, flows.read_stream(spark, src, rows.schema, files_per_batch=1), f"{tmp_path}/out")
    wanted = sv.latest_quotes(rows)
    assert sorted(map(str, got.select(wanted.columns).collect())) == sorted(map(str, wanted.collect()))


def test_latest_quotes_are_compacted_and_keep_rows_without_symbol(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(flows, "COMPACT_EVERY", 1)
    rows = m.ticks(spark, SF).select(F.when(F.col("symbol") != "U2", F.col("symbol")).alias("symbol"), "ts", "seq", "ltp", "ltq")
    src = f"{tmp_path}/src"
    list(in_parts(rows, src, BOUNDS))
    got = flows.run_latest_quotes(spark, flows.read_stream(spark, src, rows.schema, files_per_batch=1), f"{tmp_path}/out")
    wanted = sv.latest_quotes(rows)
    assert sorted(map(str, got.select(wanted.columns).collect())) == sorted(map(str, wanted.collect()))
    assert len(list((tmp_path / "out").glob("*=*"))) <= 4 and got.where("symbol is null").count() == 1


def test_signals_do_not_depend_on_the_cut(spark, tmp_path):
    rows = m.ticks(spark, SF).where("symbol in ('U1', 'U2')").select("symbol", "ts", "seq", "ltp", "ltq")
    columns = ["symbol", "updated_at", "direction", "confidence", "score", "entry_price", "persistence_reason"]
    found = []
    for name, bounds in (("whole", [BOUNDS[0], BOUNDS[-1]]), ("parts", [BOUNDS[0], BOUNDS[2], BOUNDS[-1]])):
        src = f"{tmp_path}/{name}"
        list(in_parts(rows, src, bounds))
        stream = flows.read_stream(spark, src, rows.schema, files_per_batch=1)
        signals = flows.run_signal_cycles(spark, stream, lookback=20, base=f"{tmp_path}/{name}-out", checkpoint=f"{tmp_path}/{name}-state")
        found.append(sorted(map(str, signals.select(columns).collect())))
    assert found[0] == found[1] and len(found[0]) > 50


def test_a_backlog_is_decided_in_steps_outside_of_any_broadcast(spark, tmp_path, monkeypatch):
    rows = m.ticks(spark, SF).where("symbol in ('U1', 'U2')").select("symbol", "ts", "seq", "ltp", "ltq")
    rows.coalesce(1).write.parquet(f"{tmp_path}/src")
    columns = ["symbol", "updated_at", "direction", "confidence", "score", "entry_price", "persistence_reason"]
    decide, steps = flows.cycle_decisions, []

    def slow(batches):
        for batch in batches:
            if batch.num_rows:
                time.sleep(16)
            yield batch

    def decisions(frames, lookback):
        decided = decide(frames, lookback)
        steps.append(1)
        return decided.coalesce(1).mapInArrow(slow, decided.schema)

    found = []
    for name in ("plain", "slow"):
        if name == "slow":
            monkeypatch.setattr(flows, "cycle_decisions", decisions)
            monkeypatch.setattr(flows, "FRAME_BARS", 60, raising=False)
            spark.conf.set("spark.sql.broadcastTimeout", "15")
        try:
            stream = flows.read_stream(spark, f"{tmp_path}/src", rows.schema)
            signals = flows.run_signal_cycles(spark, stream, lookback=20, base=f"{tmp_path}/{name}-out", checkpoint=f"{tmp_path}/{name}-state")
        finally:
            spark.conf.unset("spark.sql.broadcastTimeout")
        found.append(sorted(map(str, signals.select(columns).collect())))
    assert found[0] == found[1] and len(found[0]) > 60 and len(steps) > 2
    assert len(list((tmp_path / "slow-out" / "decided").glob("batch=*"))) == 1


def rounded_rows(rows):
    def plain(v):
        return round(v, 8) + 0.0 if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    return sorted(str([plain(v) for v in r]) for r in rows)


def test_rolled_decisions_equal_those_of_frames(spark, monkeypatch):
    """Long, short and flat histories, missing volumes, a symbol that no bar has, segments and a cut between batches."""
    monkeypatch.setattr(flows, "SEGMENT_BARS", 128)
    lookback, start, rows, price = 110, dt.datetime(2024, 1, 1), [], 100.0
    draw = random.Random(4)
    for name, n in (("A", 300), ("B", 60), ("C", 130), (None, 3)):
        for k in range(n):
            flat = name == "C" and 20 <= k < 60
            price = price if flat else max(1.0, price + draw.choice((-2.0, -0.5, 0.0, 0.25, 1.5)))
            wide = 0.0 if flat else draw.choice((0.0, 0.5, 1.0))
            rows.append((name, start + dt.timedelta(minutes=k), price, price + wide, price - wide, price, None if k % 17 == 3 else draw.randint(1, 90)))
    bars = spark.createDataFrame(rows, flows.BAR_LOG).repartition(4).cache()
    columns = ["symbol", "ts", "seq", "score", "confidence", "raw_direction", "components", "daily_bias", "price"]
    whole = flows.rolling_decisions(None, bars, lookback).select(columns).collect()
    wanted = flows.cycle_decisions(flows.cycle_frames(None, bars, lookback), lookback).select(columns).collect()
    assert len(whole) == 490 and rounded_rows(whole) == rounded_rows(wanted)
    assert len({c.direction for r in whole for c in r.components}) == 3
    # a bar's decision does not depend on the batch that it comes in
    cut = F.lit(start + dt.timedelta(minutes=125))
    late, early = bars.where(F.col("ts") >= cut), recent_bars(bars.where(F.col("ts") < cut), lookback).select(*flows.BAR_COLUMNS)
    part = flows.rolling_decisions(early, late, lookback).select(columns).collect()
    assert sorted(map(str, part)) == sorted(str(r) for r in whole if r.ts >= start + dt.timedelta(minutes=125)) and len(part) == 180


def test_the_lookback_of_a_cycle_needs_no_copy_of_a_bar_for_each_frame(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(flows, "cycle_frames", None)
    bars = spark.createDataFrame([("A", dt.datetime(2024, 1, 1, 0, k), 1.0 + k, 2.0 + k, 0.5 + k, 1.5 + k, 10) for k in range(30)], flows.BAR_LOG)
    assert flows.write_decisions(bars.limit(0), bars, params.LOOKBACK, f"{tmp_path}/decided").count() == 30
    assert [cycle.rolls(n) for n in (20, 100, 101, params.LOOKBACK, params.ADAPTIVE_PERIODS)] == [False, False, True, True, False]


def test_a_batch_writes_the_state_of_its_own_symbols(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(flows, "COMPACT_EVERY", 2)
    ticks = m.ticks(spark, SF).where("symbol in ('U1', 'U2')").select("symbol", "ts", "seq", "ltp", "ltq")
    rows = ticks.where(f"symbol = 'U1' or ts < '{BOUNDS[1]}'")
    src, base = f"{tmp_path}/src", f"{tmp_path}/out"
    list(in_parts(rows, src, [*BOUNDS[:2], "2024-01-08", "2024-01-09"]))
    stream = flows.read_stream(spark, src, rows.schema, files_per_batch=1)
    signals = flows.run_signal_cycles(spark, stream, lookback=5, base=base, checkpoint=f"{tmp_path}/state")
    assert signals.groupBy("symbol", "updated_at").count().where("count > 1").count() == 0
    versions = sorted((tmp_path / "out" / "recent").glob("version=*"), key=lambda v: int(v.name.split("=")[1]))
    written = [{r.symbol for r in spark.read.parquet(str(v)).collect()} for v in versions]
    assert written[-1] == {"U1"} and written[-2] == {"U1"}
    bases = list((tmp_path / "out" / "recent").glob("base=*"))
    assert bases and all(r["count"] <= 5 for r in spark.read.parquet(str(bases[-1])).groupBy("symbol").count().collect())


def test_a_log_survives_stops_and_repeats(spark, tmp_path):
    log = KeyedLog(spark, f"{tmp_path}/log", "k string, v long")

    def write(version, **values):
        log.write(spark.createDataFrame(list(values.items()), "k string, v long"), version)

    def newest(before):
        return {r.k: r.v for r in log.newest(before, "k").collect()}

    assert newest(0) == {}
    write(0, a=1, b=1)
    write(1, a=2)
    log.compact(1, newest_rows("k"))
    write(2, b=3)
    write(2, b=4)  # a repeated batch replaces what it wrote
    assert newest(1) == {"a": 1, "b": 1} and newest(2) == {"a": 2, "b": 1} and newest(3) == {"a": 2, "b": 4}
    (tmp_path / "log" / "base=2").mkdir()  # a compaction that was stopped before it was complete
    assert newest(3) == {"a": 2, "b": 4}
    log.compact(2, newest_rows("k"))
    assert newest(2) == {"a": 2, "b": 1}  # batch 2 can still be repeated
    write(3, c=5)
    assert newest(4) == {"a": 2, "b": 4, "c": 5}
    log.compact(3, newest_rows("k"))
    assert newest(4) == {"a": 2, "b": 4, "c": 5} and not (tmp_path / "log" / "version=1").exists()


def test_appended_indicators_equal_the_whole_series(spark, tmp_path):
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    rows = [(s, d, 100.0 + (i * 7 + k) % 13, 10 + i % 5) for k, s in enumerate(("A", "B")) for i, d in enumerate(days)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, close double, volume bigint")
    found = []
    for name, cuts in (("whole", [60]), ("days", [1, 17, 18, 60])):
        log, first = history.IndicatorLog(spark, f"{tmp_path}/{name}"), 0
        for k, last in enumerate(cuts):
            part = bars.where((F.col("ts") >= F.lit(days[first])) & (F.col("ts") <= F.lit(days[last - 1])))
            log.append(part, k)
            if k == 1:
                log.append(part, k)  # a repeated cycle changes nothing
            first = last
        log.append(bars, len(cuts))  # bars that are known already change nothing
        found.append([[round(x, 9) if isinstance(x, float) else x for x in r] for r in log.read(len(cuts) + 1, 50).orderBy("symbol", "ts").collect()])
    assert found[0] == found[1] and len(found[0]) == 100


def test_a_cycle_sees_its_last_bars_only(spark):
    bars = m.ticks(spark, SF).where("symbol = 'U1'").select(
        "symbol", "ts", *[F.col("ltp").alias(c) for c in ("open", "high", "low", "close")], F.col("ltq").alias("volume")
    )
    frames = flows.cycle_frames(bars.where("ts < '2024-01-15'"), bars.where("ts >= '2024-01-15'"), 7)
    sizes = frames.groupBy("symbol").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    assert sizes.count() == bars.where("ts >= '2024-01-15'").count()
    assert {r.n for r in sizes.collect()} == {7}
    end = F.timestamp_micros(F.split("symbol", flows.SEPARATOR)[1].cast("bigint"))
    assert sizes.where(end != F.col("last")).count() == 0
