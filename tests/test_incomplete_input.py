"""Rows without a key or a time, ties, odd numbers and limits: nothing is lost in silence."""

import datetime as dt

import pytest

from barweave.functions.carry import carry_last, segment_marks
from barweave.functions.topn import latest_n
from barweave.operators import bars as b, serving as sv, unified as un
from barweave.sources import files
from checks import compare
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
NEW = (
    "carry_nulls", "latest_quotes_ties", "signal_history_long", "merged_history_long", "parse_candle_numbers", "valid_bars_nan",
    "contributions_aliases", "context_forms", "rationale_custom", "ingest_run_stats", "append_signal_history",
)


@pytest.mark.parametrize("name", NEW)
def test_query_equals_oracle(spark, name):
    line = compare.check(spark, compare.connect(SF), SF, name)
    assert line.startswith("OK"), line


def test_carry_keeps_rows_without_key_or_time(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [("a", day, 1, 1.0), ("a", None, 2, 9.0), ("a", day + dt.timedelta(hours=5), 3, 2.0), (None, day, 4, 5.0), (None, day, 5, 6.0), (None, None, 6, 7.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, seq bigint, v double")
    got = {r.seq: r.before for r in carry_last(df, "k", "ts", "seq", "v", "before").collect()}
    assert got == {1: None, 2: None, 3: 1.0, 4: None, 5: 5.0, 6: None}


@pytest.mark.parametrize("segment_rows", [1, 200, 4_000_000])
def test_a_hot_key_is_carried_over_segments(spark, segment_rows):
    rows = spark.range(6000).select(
        F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        F.when(F.col("id") % 97 > 0, F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 900))).alias("ts"),
        F.col("id").alias("seq"), F.when(F.col("id") % 501 == 0, F.col("id") * 1.0).alias("v"),
    )
    last = {}
    for r in sorted(rows.where("ts is not null").collect(), key=lambda r: (r.ts, r.seq)):
        last[r.seq] = last.get((r.k,))
        if r.v is not None:
            last[(r.k,)] = r.v
    got = carry_last(rows, "k", "ts", "seq", "v", "before", segment_rows=segment_rows)
    assert {r.seq: r.before for r in got.collect()} == {r.seq: last.get(r.seq) for r in rows.collect()}
    marks = {(r._key, r._keyless): len(r._marks) for r in segment_marks(rows, "k", "ts", "seq", segment_rows).collect()}
    assert (marks.get(("hot", False), 0) > 10) == (segment_rows < 1000)


def test_splits_do_not_change_the_newest(spark):
    df = spark.range(4000).select((F.col("id") % 3).alias("k"), "id").repartition(7)
    for splits in (1, 4, 50):
        got = latest_n(df, ["k"], [F.col("id").desc()], 5, splits=splits).select("k", "id", "rn").collect()
        assert sorted(map(tuple, got)) == sorted((k, 3999 - (3999 - k) % 3 - 3 * i, i + 1) for k in range(3) for i in range(5))


def test_latest_quote_takes_the_last_message_of_an_instant(spark):
    at = dt.datetime(2024, 1, 1)
    for rows in ([("s", at, 2, 2.0), ("s", at, 1, 1.0)], [("s", at, 1, 1.0), ("s", at, 2, 2.0)]):
        df = spark.createDataFrame(rows, "symbol string, ts timestamp, seq bigint, ltp double").coalesce(1)
        assert sv.latest_quotes(df).collect()[0].ltp == 2.0
        assert sv.latest_quotes(df.withColumn("levels", F.array("ltp"))).collect()[0].levels == [2.0]


def test_latest_quote_does_not_depend_on_the_order_of_rows(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("s", at, 2.0, "b"), ("s", at, 1.0, "a"), ("s", at, 3.0, "c"), ("s", at, 3.0, "c"), (None, at, 4.0, "d"), ("t", None, 5.0, "e"), ("t", None, 6.0, "f")]
    seen = set()
    for given in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(given, "symbol string, ts timestamp, ltp double, venue string").coalesce(1)
        for fields in (("ltp",), ("ltp", "venue")):
            got = {r.symbol: r for r in sv.latest_quotes(df, fields=fields).collect()}
            assert {k: r.tick_count for k, r in got.items()} == {"s": 4, None: 1, "t": 2}
            assert got[None].ltp == 4.0 and got["t"].ltp is None and got["t"].last_update is None
            seen.add((fields, got["s"].ltp))
        assert (got["s"].ltp, got["s"].venue) in {(2.0, "b"), (1.0, "a"), (3.0, "c")}
        plan = sv.latest_quotes(df)._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert len(seen) == 2  # one winner for each list of fields, whatever the order


def test_candle_volumes_and_prices(spark):
    text = '[["2024-01-01T00:00:00Z",1,2,1,2,5.7],["2024-01-02T00:00:00Z",1,2,1,2,5.0],["2024-01-03T00:00:00Z","NaN",2,1,2,5],["2024-01-04T00:00:00Z",1,2,1,2,"x"]]'
    docs = spark.createDataFrame([("s", text)], "symbol string, candles string")
    assert [r.volume for r in files.parse_candles(docs).orderBy("ts").collect()] == [5, 5]


def test_ranges_and_limits_are_the_callers(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("s", start + dt.timedelta(minutes=i), *[float(i + 1)] * 4, 1) for i in range(700)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume bigint")
    end = str(start + dt.timedelta(minutes=699))
    assert b.chart_data(bars, "s", "1m", 650, end).count() == 650
    assert b.bars_in_range(bars, "1m", 600, end).count() == 601


def test_history_of_both_sources(spark, make_bars):
    intraday, history = make_bars({"a": [1.0] * 3}), make_bars({"a": [2.0] * 5})
    assert b.stack_sources(intraday, history).count() == 8
    assert b.union_intraday_historical(intraday, history, 3).count() == 3


def test_repeated_append_replaces_its_batch(spark, tmp_path):
    rows = spark.createDataFrame([("s", dt.datetime(2024, 1, d), d) for d in (1, 2)], "symbol string, updated_at timestamp, seq bigint")
    for batch in ("one", "one", "two"):
        files.append_signal_history(rows, f"{tmp_path}/h", batch)
    assert spark.read.parquet(f"{tmp_path}/h").count() == 4


def test_titles(spark):
    names = ["news_flow", "market_regime", "book-depth x", "éclat 2nd"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(un.titled(F.col("n"))).collect()] == [n.title() for n in names]
