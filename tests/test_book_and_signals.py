import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from barweave.functions.carry import carry_last
from barweave.functions.topn import latest_n
from barweave.operators import orderbook as ob, serving as sv, unified as un
from barweave.sources import files

LEVEL = "array<struct<price:double,quantity:bigint>>"
QUOTE = f"symbol string, ltp double, best_bid double, best_ask double, bid_levels {LEVEL}, ask_levels {LEVEL}"


def demo_quote(spark, **changes):
    base = dict(
        symbol="T", ltp=100.50, best_bid=100.45, best_ask=100.55,
        bid_levels=[(100.45, 150), (100.40, 300), (100.35, 500)],
        ask_levels=[(100.55, 200), (100.60, 180), (100.65, 250)],
    )
    base.update(changes)
    return spark.createDataFrame([tuple(base.values())], QUOTE)


def test_hand_worked_book(spark):
    q = demo_quote(spark)
    s = ob.spread_analysis(q).first()
    assert s.spread_percentage == pytest.approx(0.09955, abs=1e-4) and s.spread_class == "TIGHT"
    assert s.ltp_position == "BETWEEN"
    d = ob.depth_analysis(q).first()
    assert (d.total_bid_quantity, d.total_ask_quantity) == (950, 630)
    assert d.bid_percentage == pytest.approx(60.1266, abs=1e-3) and d.depth_pressure == "BUY_PRESSURE"
    assert d.bid_weighted_price == pytest.approx(100.3816, abs=1e-4)
    assert d.ask_weighted_price == pytest.approx(100.6040, abs=1e-4)
    assert d.bid_concentration == pytest.approx(15.789, abs=1e-2)
    assert d.ask_concentration == pytest.approx(31.746, abs=1e-2)
    r = ob.book_support_resistance(q).first()
    assert (r.immediate_support, r.strong_support) == (100.45, 100.35)
    assert (r.immediate_resistance, r.strong_resistance) == (100.55, 100.65)


def test_book_guards(spark):
    assert ob.depth_analysis(demo_quote(spark, ask_levels=[])).first().depth_status == "insufficient_levels"
    assert ob.spread_analysis(demo_quote(spark, best_bid=0.0)).first().spread_status == "insufficient_data"
    no_price = ob.spread_analysis(demo_quote(spark, ltp=None)).first()
    assert no_price.ltp_position == "UNKNOWN" and no_price.bid_distance is None
    single = ob.depth_analysis(demo_quote(spark, bid_levels=[(100.45, 150)])).first()
    assert single.bid_concentration == 100


def test_candles_skip_bad_rows_and_read_z_as_exchange_time(spark):
    docs = [
        ["2024-01-02T09:15:00Z", 1, 2, 0.5, 1.5, 10],
        ["2024-01-02T09:16:00+00:00", 1, 2, 0.5, 1.5],
        ["not a time", 1, 2, 0.5, 1.5, 10],
        ["2024-01-02T09:17:00Z", 0, 2, 0.5, 1.5, 10],
        ["2024-01-02T09:18:00Z", "x", 2, 0.5, 1.5, 10],
        ["2024-01-02T09:18:00Z", 1, 2],
    ]
    df = spark.createDataFrame([("A", json.dumps(docs))], "symbol string, candles string")
    rows = files.parse_candles(df).orderBy("ts").collect()
    assert [(r.ts, r.volume) for r in rows] == [
        (dt.datetime(2024, 1, 2, 3, 45), 10), (dt.datetime(2024, 1, 2, 9, 16), 0)
    ]
    iso = files.parse_candles(df, z_is_ist=False).agg(F.min("ts")).first()[0]
    assert iso == dt.datetime(2024, 1, 2, 9, 15)


def decisions(spark, n=2000, seed=5):
    rnd = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = [
        (rnd.choice("AAAB"), start + dt.timedelta(minutes=i * 7), i, rnd.choice(["BUY", "SELL", "HOLD"]), rnd.random())
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "symbol string, ts timestamp, seq bigint, raw_direction string, confidence double")


def test_persistence_equals_the_sequential_rule(spark):
    rows, df = decisions(spark)
    last, want = {}, {}
    for sym, _, seq, direction, conf in rows:
        out = direction
        if direction != "HOLD":
            if direction != last.get(sym, "HOLD") and conf < 0.6:
                out = "HOLD"
            else:
                last[sym] = direction
        want[seq] = out
    for segment_rows in (64, 300, 10_000):
        got = {r.seq: r.direction for r in un.persistence(df, segment_rows=segment_rows).collect()}
        assert got == want, segment_rows
    state = {r.symbol: r.committed for r in un.commitments(df).collect()}
    assert state == {k: 1 if v == "BUY" else -1 for k, v in last.items()}


def test_carry_last_crosses_buckets_and_nulls(spark):
    rows = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i * 5), i, None if i % 3 else float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, seq bigint, v double")
    got = {r.seq: r.prev for r in carry_last(df, "k", "ts", "seq", "v", "prev", segment_rows=1).collect()}
    prev = None
    for _, _, i, v in rows:
        assert got[i] == prev
        prev = v if v is not None else prev


@pytest.mark.parametrize("splits", [1, 5])
def test_latest_n_with_a_hot_key(spark, splits):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id"
    )
    got = latest_n(df, ["k"], [F.col("id").desc()], 7, splits=splits)
    want = df.toPandas().sort_values("id", ascending=False).groupby("k").head(7)
    assert sorted((r.k, r.id) for r in got.collect()) == sorted(zip(want.k, want.id))


def test_payload_nulls_and_clamp(spark):
    from barweave.functions.scalar import clamp

    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (3.0,), (None,)], "x double")
    assert [r[0] for r in df.select(clamp(F.col("x"))).collect()] == [0.0, 0.0, 1.0, None]


def test_asof_context_takes_the_latest_at_or_before(spark):
    s = [("A", dt.datetime(2024, 1, d, 12), i, 1.0) for i, d in enumerate((1, 2, 5))]
    c = [("A", dt.datetime(2024, 1, 2, 12), 7.0), ("A", dt.datetime(2024, 1, 4), 8.0)]
    signals = spark.createDataFrame(s, "symbol string, ts timestamp, seq bigint, x double")
    context = spark.createDataFrame(c, "symbol string, ts timestamp, bias double")
    got = un.asof_context(signals, context, "bias", "bias").orderBy("seq").collect()
    assert [r.bias for r in got] == [None, 7.0, 8.0]


def test_market_hours(spark):
    times = ["2024-01-05 03:44:59", "2024-01-05 03:45:00", "2024-01-05 10:00:00", "2024-01-05 10:00:01", "2024-01-06 05:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    rows = sv.market_hours(df).orderBy("ts").collect()
    assert [r.is_open for r in rows] == [False, True, True, False, False]
    assert rows[0].status_message == "Market opens in 0:00:01" and rows[4].is_weekend
