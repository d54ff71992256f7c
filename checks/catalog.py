"""Registered queries: every operator over the whole given tables.

Results are flat (nested values become text) and doubles are rounded, so that they
can be compared value by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from barweave import params
from barweave.functions import scalar
from barweave.operators import (
    actionable, bars as b, history, indicators as ind, orderbook as ob, quant as q, serving as sv, trajectory as tr,
    unified as un,
)
from barweave.functions.topn import latest_n
from barweave.operators.quantiles import percentiles
from barweave.plans import cycle
from barweave.session import shared_dir
from barweave.sources import feed, files, market_tables as m
from barweave.sources.monthly_log import MonthlyLog, month_of
from barweave.streaming import flows

C = F.col
AS_OF = "2001-11-05 04:30:00"
MONTH_START, HOUR_START = 1_704_067_200_000_000, 1_704_880_800_000_000  # 2024-01-01 00:00 and 2024-01-10 10:00 UTC
EVENTS_END = "2024-01-31 00:00:00"
TRADE_ORDER = ("ts", "trade_seq")


def rounded(x: Column, digits: int = 6) -> Column:
    """Half up by floor, which gives the same double in any engine."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5).cast("double") / scale


def stamp(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def levels_text(x: Column) -> Column:
    return F.array_join(
        F.transform(x, lambda v: F.format_string("%.4f x %d", v["price"], v["quantity"])), "|"
    )


def flat(df: DataFrame, *names: str) -> DataFrame:
    """Scalar columns of ``df``, or the named ones, in comparable form."""
    kept = names or tuple(
        f.name for f in df.schema.fields if not isinstance(f.dataType, (T.StructType, T.MapType))
    )
    out = []
    for n in kept:
        t = df.schema[n].dataType
        c = C(n)
        if isinstance(t, (T.DoubleType, T.FloatType)):
            c = rounded(c)
        elif isinstance(t, (T.TimestampType, T.DateType)):
            c = stamp(c)
        elif isinstance(t, T.ArrayType):
            if not isinstance(t.elementType, T.StringType):
                continue
            c = F.array_join(c, "|")
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)):
            c = c.cast("bigint")
        out.append(c.alias(n))
    return df.select(*out)


def bars_of(s, d):
    return m.daily_bars(s, d)


def stored(s, rows: DataFrame, label: str) -> DataFrame:
    """Rows that several steps read: computed once, as a table of their own."""
    path = shared_dir(s, label)
    rows.write.parquet(path)
    return s.read.schema(rows.schema).parquet(path)


def calm(s, d):
    return m.calm_bars(s, d)


def trending(s, d):
    return m.trending_bars(s, d)


def names(s, d) -> DataFrame:
    """Part names as instrument names; some get an ampersand."""
    p = m.table(s, d, "part")
    name = F.when(C("p_size") > 25, F.concat("p_name", F.lit(" & "), "p_type")).otherwise(C("p_name"))
    return p.select(name.alias("name"), F.concat(F.lit("P"), "p_partkey").alias("instrument_key"))


# --- scans, sources, sinks -------------------------------------------------------------------


def read_instruments(s, d):
    docs = names(s, d).select(
        F.to_json(F.struct(F.array(F.struct("name", "instrument_key")).alias("symbols"))).alias("value")
    )
    return files.parse_instruments(docs)


def read_bars(s, d):
    path = shared_dir(s, "bars")
    files.write_bars(bars_of(s, d), path)
    return flat(files.read_bars(s, path, "1997-01-01 00:00:00", "1999-06-30 00:00:00"))


def candle_documents(s, d) -> DataFrame:
    """One candle array per order line: zones, missing volumes and bad numbers occur."""
    li = m.table(s, d, "lineitem")
    day = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")
    when = F.when(C("l_linestatus") == "F", F.concat(day, F.lit("Z"))).otherwise(F.concat(day, F.lit("+00:00")))
    price = F.when(C("l_returnflag") == "R", "0.0").otherwise(F.format_string("%.2f", "l_extendedprice"))
    openp = F.when(C("l_linenumber") == 7, '"n/a"').otherwise(price)
    volume = F.when(C("l_linenumber") == 1, "").otherwise(F.concat(F.lit(","), C("l_quantity").cast("bigint")))
    return li.select(
        F.concat(F.lit("S"), "l_suppkey").alias("symbol"),
        F.format_string('[["%s",%s,%s,%s,%s%s]]', when, openp, F.format_string("%.2f", C("l_extendedprice") + 1),
                        price, F.format_string("%.2f", "l_extendedprice"), volume).alias("candles"),
    )


def parse_candle_arrays(s, d):
    return flat(files.parse_candles(candle_documents(s, d)))


def market_feed(s, d):
    return feed.explode_feed(feed.parse_feed(m.feed_messages(s, d)))


def explode_feed(s, d):
    ticks = feed.feed_ticks(market_feed(s, d).drop("seq"))
    return flat(ticks.withColumn("n_levels", F.size("levels")).drop("levels"))


def corrections(bars: DataFrame) -> DataFrame:
    """The bars since 2001 with a higher close."""
    return bars.where(C("ts") >= F.lit("2001-01-01").cast("timestamp")).withColumn("close", C("close") + 1)


def new_bars(s, d):
    return corrections(bars_of(s, d))


def upsert_bars(s, d):
    return flat(b.long_series(files.upsert_bars(bars_of(s, d), new_bars(s, d))))


def store_bars(s, d):
    path = shared_dir(s, "store")
    files.store_bars(s, path, bars_of(s, d))
    files.store_bars(s, path, new_bars(s, d))
    return flat(files.read_stored_bars(s, path))


def compacted_bars(s, d):
    """Three loads, two compactions, and a load that a stopped job left incomplete."""
    path = shared_dir(s, "compacted")
    log = MonthlyLog(s, path)
    bars = stored(s, bars_of(s, d), "daily")
    log.append(bars)
    log.compact(log.append(corrections(bars).withColumn("close", C("close") + 1)))
    log.compact(log.append(corrections(bars)))
    bars.withColumns({"close": C("close") + 9, "version": F.lit(7), "month": month_of()}).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy("month").parquet(f"{path}/version=7")
    return flat(files.read_stored_bars(s, path, "1999-01-01 00:00:00", "2001-06-30 00:00:00"))


def intraday(bars: DataFrame) -> DataFrame:
    return bars.where(C("ts") >= F.lit("2000-06-01").cast("timestamp")).withColumn("close", C("close") + 0.01)


def loaded(s, d, n=250):
    bars = stored(s, bars_of(s, d), "daily")
    return cycle.load_history(intraday(bars), bars, n)


def bar_metadata(s, d):
    return flat(b.bar_metadata(loaded(s, d)))


def supplier_symbols(s, d):
    return m.table(s, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"), "s_acctbal")


def ingest_run_stats(s, d):
    """Customers are asked for as well and have no bars."""
    customers = m.table(s, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("symbol"))
    return flat(b.ingest_run_stats(supplier_symbols(s, d).select("symbol").unionByName(customers), bars_of(s, d)))


def signals_of_events(s, d):
    return un.unified_signal(m.component_snapshots(s, d))


def append_signal_history(s, d):
    path = shared_dir(s, "history")
    files.append_signal_history(signals_of_events(s, d), path, "first")
    files.append_signal_history(signals_of_events(s, d), path, "first")  # a repeated job adds nothing
    kept = files.capped_history(s.read.parquet(path), 20)
    return flat(kept, "symbol", "updated_at", "seq", "direction", "confidence", "rn")


def signal_payload(s, d):
    p = un.signal_payload(signals_of_events(s, d))
    get = {k: F.get_json_object("payload", f"$.{k}") for k in ("direction", "persistence_reason", "updated_at")}
    nums = {k: F.get_json_object("payload", f"$.{k}").cast("double") for k in ("confidence", "score", "risk_reward")}
    return flat(p.select(
        "symbol", *[c.alias(f"p_{k}") for k, c in get.items()], *[c.alias(f"p_{k}") for k, c in nums.items()],
        F.get_json_object("payload", "$.components[0].score").cast("double").alias("p_first_score"),
        F.get_json_object("payload", "$.timeframes.execution").alias("p_timeframe"),
    ))


# --- projections, filters, predicates --------------------------------------------------------


def valid_bars(s, d):
    raw = m.table(s, d, "events").select(
        F.concat(F.lit("U"), "user_id").alias("symbol"), C("ts").cast("timestamp").alias("ts"),
        C("value").alias("open"), (C("value") + 1).alias("high"),
        (C("value") - F.when(C("event_type") == "error", 5).otherwise(0)).alias("low"), C("value").alias("close"),
        F.when(C("event_type") != "view", F.get_json_object("props", "$.k").cast("bigint")).alias("volume"),
    )
    return flat(files.valid_bars(raw))


def best_quote(s, d):
    return flat(feed.best_quote(feed.feed_ticks(market_feed(s, d).drop("seq"))).drop("levels"))


def top_levels(s, d):
    df = feed.top_levels(feed.feed_ticks(market_feed(s, d).drop("seq"))).drop("levels")
    return flat(df.withColumns({c: levels_text(C(c)) for c in ("bid_levels", "ask_levels")}))


def parse_exchange_ts(s, d):
    e = m.table(s, d, "events")
    millis = F.unix_millis(C("ts").cast("timestamp"))
    raw = F.when(C("event_type") == "click", F.floor(millis / 1000)).otherwise(millis)
    return flat(e.select(C("event_id"), scalar.epoch_to_ts(raw).alias("exchange_ts")))


def quotes_with_gaps(s, d):
    """Quotes of the ticks; error events carry no price."""
    return m.ticks(s, d).withColumn("ltp", F.when(C("event_type") != "error", C("ltp")))


def active_symbols(s, d):
    latest = sv.latest_quotes(quotes_with_gaps(s, d).select("symbol", "ts", "seq", "ltp", "ltq"))
    return sv.active_symbols(latest)


def bars_in_range(s, d):
    minutes = b.ohlcv_bars(m.ticks(s, d))
    return flat(b.bars_in_range(minutes, "4h", 50, EVENTS_END).select("symbol", "ts", "close", "volume"))


def market_hours(s, d):
    return flat(sv.market_hours(m.ticks(s, d).select("seq", "ts")))


def high_vol_session(s, d):
    return m.ticks(s, d).select("seq", scalar.is_high_vol_session(C("ts")).alias("high_vol"))


def session_vol_factor(s, d):
    return m.ticks(s, d).select("seq", rounded(scalar.session_vol_factor(C("ts"))).alias("factor"))


def clamp(s, d):
    x = F.when(C("ltq") == 0, float("inf")).when(C("ltq") == 1, float("nan")).otherwise((C("ltq") - 50) / 20.0)
    return m.ticks(s, d).select("seq", rounded(scalar.clamp(x)).alias("clamped"))


def stale_symbols(s, d):
    return flat(b.stale_symbols(supplier_symbols(s, d), bars_of(s, d), "2001-10-28 00:01:00"))


def price_tick_direction(s, d):
    df = sv.price_tick_direction(m.ticks(s, d))
    return flat(df, "symbol", "seq", "ltp", "prev_ltp", "tick_direction")


def signal_freshness(s, d):
    signals = m.ticks(s, d).select("symbol", "seq", C("ts").alias("updated_at"))
    return flat(sv.signal_freshness(signals, "2024-01-30 12:00:00").drop("updated_at"))


def signal_quality(s, d):
    side = F.when(C("event_type") == "click", "BUY").when(C("event_type") == "error", "SELL").otherwise("HOLD")
    return flat(m.ticks(s, d).select("seq", actionable.signal_quality(side, C("ltq") > 4).alias("quality")))


def signal_for(s, d):
    return flat(sv.signal_for(signals_of_events(s, d), "U7"), "symbol", "seq", "direction", "confidence")


def all_signals(s, d):
    return flat(sv.latest_signals(signals_of_events(s, d)), "symbol", "seq", "direction", "confidence", "score")


def named_quotes(s, d):
    return feed.label_symbols(feed.feed_quotes(market_feed(s, d)), m.instruments(s, d))


def live_symbols(s, d):
    latest = sv.latest_quotes(named_quotes(s, d), ("symbol", "instrument_key"), ("ltp",))
    return flat(sv.live_symbols(latest))


def latest_quotes(s, d):
    latest = sv.latest_quotes(named_quotes(s, d).drop("levels"), ("symbol", "instrument_key"))
    return flat(latest.withColumns({c: levels_text(C(c)) for c in ("bid_levels", "ask_levels")}))


def daily_trend_from_technical(s, d):
    t = m.ticks(s, d)
    a = F.when(C("event_type") == "click", C("ltp"))
    c = F.when(C("event_type") != "view", C("ltp") * 2)
    tech = F.struct(a.alias("daily_trend"), c.alias("trend_daily"))
    return flat(t.select("seq", un.daily_trend_from_technical(tech).alias("daily_trend")))


# --- joins -----------------------------------------------------------------------------------


def align_series(s, d):
    return flat(b.align_series(b.long_series(bars_of(s, d))))


def label_symbols(s, d):
    rows = m.ticks(s, d).withColumnRenamed("symbol", "instrument_key")
    return flat(feed.label_symbols(rows, m.instruments(s, d)), "seq", "instrument_key", "symbol")


def subscribed_only(s, d):
    rows = m.ticks(s, d).withColumnRenamed("symbol", "instrument_key")
    return flat(feed.subscribed_only(rows, m.instruments(s, d)), "seq", "instrument_key", "ltp")


def sector_of(s, d):
    return names(s, d).select("instrument_key", tr.sector_of(C("name"), m.TEST_SECTORS).alias("sector"))


def latest_event_signals(s, d):
    return sv.latest_signals(signals_of_events(s, d))


def live_prices(s, d):
    # read twice: for the rows and for whether there are any
    latest = stored(s, sv.latest_quotes(feed.feed_quotes(market_feed(s, d)), ("instrument_key",), sv.PRICE_FIELDS), "quotes")
    return flat(sv.live_prices(latest.withColumnRenamed("instrument_key", "symbol"), latest_event_signals(s, d)))


def live_prices_fallback(s, d):
    none = sv.latest_quotes(
        feed.feed_quotes(market_feed(s, d)).drop("levels").where(C("ltp") < 0), ("instrument_key",), sv.PRICE_FIELDS
    )
    none = stored(s, none, "quotes")
    return flat(sv.live_prices(none.withColumnRenamed("instrument_key", "symbol"), latest_event_signals(s, d)))


def assemble_snapshot(s, d):
    t = m.ticks(s, d)
    price = t.select("symbol", C("seq").alias("version"), F.struct("ltp", F.when(C("event_type") == "click", C("ltq")).alias("ltq")).alias("price"))
    technical = t.where(C("event_type") == "error").select(
        "symbol", C("seq").alias("version"), F.struct(C("ltp").alias("score"), C("event_type").alias("direction")).alias("technical")
    )
    out = un.assemble_snapshot(price, technical)
    return flat(out.select(
        "symbol", "price.ltp", "price.ltq", C("technical.score").alias("technical_score"),
        C("technical.direction").alias("technical_direction"),
    ))


def stored_part(s, d):
    return bars_of(s, d).where(C("ts") < F.lit("2001-06-01").cast("timestamp"))


def missing_bars(s, d):
    return flat(b.missing_bars(bars_of(s, d), stored_part(s, d), AS_OF))


def absent_bars(s, d):
    return flat(b.absent_bars(bars_of(s, d), stored_part(s, d)))


def bars_with_context(s, d):
    t = m.ticks(s, d).select("symbol", "ts", "seq", "ltp")
    minutes = b.ohlcv_bars(m.ticks(s, d), "1 day").select("symbol", (C("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), C("close").alias("daily_close"))
    return flat(un.asof_context(t, minutes, "daily_close", "daily_close"), "symbol", "seq", "ltp", "daily_close")


# --- aggregations ----------------------------------------------------------------------------


def bars_1m(s, d):
    return flat(b.ohlcv_bars(m.ticks(s, d)))


def bars_1d(s, d):
    return flat(bars_of(s, d))


def resample(timeframe):
    def run(s, d):
        return flat(b.resample_bars(b.ohlcv_bars(m.ticks(s, d)), timeframe))

    return run


def bar_change_summary(s, d):
    hourly = b.resample_bars(b.ohlcv_bars(m.ticks(s, d)), "1h")
    return flat(b.bar_change_summary(hourly), "symbol", "ts", "open", "close", "change_pct")


def chart_stats(s, d):
    return flat(b.chart_stats(bars_of(s, d)))


def chart_data(s, d):
    return flat(b.chart_data(b.ohlcv_bars(m.ticks(s, d)), "U7", "4h", 100, EVENTS_END))


def depth_stats(s, d):
    df = ob.depth_analysis(m.book_quotes(s, d))
    return flat(df, "symbol", "total_bid_quantity", "total_ask_quantity", "bid_percentage", "ask_percentage",
                "bid_weighted_price", "ask_weighted_price", "bid_concentration", "ask_concentration",
                "n_bid_levels", "n_ask_levels", "depth_pressure", "depth_status")


def rule_rows(s, d):
    f = m.rule_features(s, d).withColumn("symbol", F.concat("symbol", F.lit("#"), "seq"))
    return actionable.actionable_signals(f, usd_inr_change=0.5)


def signals_summary(s, d):
    out = actionable.signals_summary(rule_rows(s, d))
    return flat(out.select(
        *[c for c in out.columns if not c.startswith("best") and c != "sector_distribution"],
        C("best_buy.symbol").alias("best_buy"), C("best_sell.symbol").alias("best_sell"),
        *[F.coalesce(C("sector_distribution")[n], F.lit(0)).alias(f"n_{n.lower()}")
          for n in ("BANKING", "IT", "PHARMA", "OTHER")],
    ))


def pipeline_stats(s, d):
    return flat(sv.pipeline_stats(quotes_with_gaps(s, d), signals_of_events(s, d)))


def percentile_linear(s, d):
    return flat(percentiles(bars_of(s, d), "symbol", "close", {f"p{p}": p / 100 for p in (5, 10, 20, 90)}))


def percentile_linear_hot(s, d):
    """Nine bars in ten belong to one symbol."""
    rows = bars_of(s, d).withColumn("symbol", F.when(C("symbol").endswith("7"), C("symbol")).otherwise("HOT"))
    return flat(percentiles(rows, "symbol", "close", {"p5": 0.05, "p50": 0.5, "p95": 0.95}))


def hot_ticks(s, d) -> DataFrame:
    return m.ticks(s, d).withColumn("symbol", F.when(C("symbol").endswith("7"), C("symbol")).otherwise("HOT"))


def price_tick_direction_hot(s, d):
    return flat(sv.price_tick_direction(hot_ticks(s, d)), "symbol", "seq", "ltp", "prev_ltp", "tick_direction")


def persistence_hot(s, d):
    rows = decided(s, d).withColumn("symbol", F.when(C("symbol").endswith("7"), C("symbol")).otherwise("HOT"))
    return flat(un.persistence(rows), "symbol", "seq", "direction", "persistence_reason")


def one_hour(df: DataFrame) -> DataFrame:
    """The events' month squeezed into one hour, and nine symbols in ten made one."""
    micros = F.lit(HOUR_START) + F.expr(f"(unix_micros(ts) - {MONTH_START}) div 744")
    symbol = F.when(C("symbol").endswith("7"), C("symbol")).otherwise("HOT")
    return df.withColumns({"ts": F.timestamp_micros(micros), "symbol": symbol})


def price_tick_direction_hour(s, d):
    """One hour of one symbol, dealt out over segments."""
    rows = sv.price_tick_direction(one_hour(m.ticks(s, d)), segment_rows=512)
    return flat(rows, "symbol", "seq", "ltp", "prev_ltp", "tick_direction")


def persistence_hour(s, d):
    rows = un.persistence(one_hour(decided(s, d)), segment_rows=512)
    return flat(rows, "symbol", "seq", "direction", "persistence_reason")


def asof_context_hour(s, d):
    """The newest error value at or before each tick of the hour."""
    ticks = one_hour(m.ticks(s, d))
    errors = ticks.where(C("seq") % 13 == 0).select("symbol", "ts", C("ltp").alias("mark"))
    rows = un.asof_context(ticks, errors, "mark", "mark", segment_rows=512)
    return flat(rows, "symbol", "seq", "ltp", "mark")


def recent_bars_hot(s, d):
    """The newest rows of a symbol that holds nine rows in ten."""
    ticks = hot_ticks(s, d).select("symbol", "ts", "seq", "ltp")
    return flat(latest_n(ticks, ["symbol"], [C("ts").desc(), C("seq").desc()], 250, splits=params.HOT_KEY_SPLITS))


def percentile_rank_score(s, d):
    f = q.quant_features(calm(s, d))
    return flat(f.select("symbol", *[
        q.percentile_rank(C(f"z_{p}_below"), C(f"z_{p}_at_most"), C(f"z_{p}_n")).alias(f"rank_{p}")
        for p in params.REVERSION_PERIODS
    ]))


def trend_fit(s, d):
    rows = tr.with_prices(b.recent_bars(calm(s, d), 100))
    x = C("i").cast("double")
    return flat(rows.groupBy("symbol").agg(
        F.regr_slope("close", x).alias("slope"), tr.fit_strength(C("close"), x, F.count("close")).alias("strength")
    ))


def autocorr_lag1(s, d):
    return flat(q.volatility_regime(calm(s, d)), "symbol", "vol_clustering")


# --- indicators ------------------------------------------------------------------------------


def series_query(*columns, method="simple"):
    def run(s, d):
        return flat(ind.indicator_series(b.recent_bars(calm(s, d)), method), "symbol", "ts", *columns)

    return run


def market_regime(s, d):
    return flat(ind.market_regime(trending(s, d)))


def adaptive(*columns):
    def run(s, d):
        return flat(ind.adaptive_levels(calm(s, d)), "symbol", *columns)

    return run


def swing_points(s, d):
    return flat(ind.swing_points(calm(s, d)))


WHOLE = 1_000_000  # a lookback above every history, and above the rows of the closed form


def whole_series(*columns: str, method: str = "simple"):
    """Series of whole histories."""

    def run(s, d):
        rows = b.recent_bars(calm(s, d), WHOLE)
        return flat(ind.indicator_series(rows, method, WHOLE), "symbol", "ts", *columns)

    return run


APPEND_CUTS = ("1995-10-01", "1997-01-01", "1998-06-01", "1998-07-01", "2000-01-01", "2100-01-01")


def indicator_append(s, d):
    """Bars that arrive in six cycles; the symbols ending in 7 miss the third and catch up in the fourth."""
    log = history.IndicatorLog(s, shared_dir(s, "indicators"))
    rows = stored(s, calm(s, d), "calm")
    for k, (first, last) in enumerate(zip(("1900-01-01", *APPEND_CUTS), APPEND_CUTS, strict=False)):
        behind = C("symbol").endswith("7")
        part = (C("ts") >= F.lit(first).cast("timestamp")) & (C("ts") < F.lit(last).cast("timestamp"))
        if k == 2:
            part &= ~behind
        if k == 3:
            part |= behind & (C("ts") >= F.lit(APPEND_CUTS[1]).cast("timestamp")) & (C("ts") < F.lit(last).cast("timestamp"))
        log.append(rows.where(part), k)
    return flat(log.read(len(APPEND_CUTS)), "symbol", "ts", "rsi", "macd", "macd_signal", "sma_5", "sma_20", "volume_ratio", "rn")


def recent_bars_whole(s, d):
    return flat(b.recent_bars(bars_of(s, d), WHOLE))


WILDER_LATEST = ("sma_20", "ema_20", "bb_upper", "bb_lower", "rsi", "atr", "macd", "macd_signal", "adx")


def indicators_latest_wilder(s, d):
    return flat(ind.indicators_latest(calm(s, d), "wilder"), "symbol", "ts", *WILDER_LATEST, "market_regime")


def record_query(method: str):
    """The nested record, read back field by field."""

    def run(s, d):
        record = ind.indicator_record(ind.indicators_latest(calm(s, d), method))
        return flat(record.select(
            "symbol", "timestamp", "current_price", "ohlcv.high", "sma.sma_20", "ema.ema_20", "rsi", "macd.macd", "macd.signal",
            "bollinger.upper", "bollinger.lower", "atr", "adx", "market_regime",
        ))

    return run


def indicators_latest(s, d):
    return flat(ind.indicators_latest(calm(s, d)))


def indicator_history(s, d):
    return flat(ind.indicator_history(calm(s, d)).drop("rn"))


def recent_bars(s, d):
    return flat(b.recent_bars(bars_of(s, d)))


def dedup_bars(s, d):
    rows = b.union_intraday_historical(intraday(bars_of(s, d)), bars_of(s, d), 10_000)
    return flat(b.dedup_bars(rows))


def union_intraday_historical(s, d):
    return flat(b.union_intraday_historical(intraday(bars_of(s, d)), bars_of(s, d), 120), "symbol", "ts", "close", "source")


# --- quant, book, trajectory, signals --------------------------------------------------------


def of_calm(operator, *columns):
    def run(s, d):
        return flat(operator(calm(s, d)), *columns)

    return run


def momentum_score(s, d):
    df = q.momentum_score(calm(s, d))
    return flat(df.withColumn("n_timeframes", F.size("timeframe_analysis")))


def stop_loss_atr(s, d):
    return flat(q.stop_loss(calm(s, d), "atr"), "symbol", "stop_loss", "stop_loss_pct", "stop_method")


def spread_analysis(s, d):
    df = ob.spread_analysis(m.book_quotes(s, d))
    return flat(df, "symbol", "spread_absolute", "spread_percentage", "spread_class", "ltp_position", "ltp_bias",
                "bid_distance", "ask_distance", "spread_status")


def order_flow(s, d):
    return flat(ob.order_flow(m.trades(s, d), TRADE_ORDER))


def book_support_resistance(s, d):
    df = ob.book_support_resistance(m.book_quotes(s, d))
    return flat(df, "symbol", "immediate_support", "immediate_resistance", "strong_support", "strong_resistance",
                "support_distance_pct", "resistance_distance_pct")


def tick_micro_trend(s, d):
    return flat(ob.tick_micro_trend(m.trades(s, d), TRADE_ORDER))


def book_analysis(s, d):
    return ob.orderbook_analysis(m.book_quotes(s, d), m.trades(s, d), TRADE_ORDER)


def orderbook_signal(s, d):
    return flat(book_analysis(s, d), "symbol", "market_sentiment", "short_term_direction", "liquidity_quality",
                "entry_recommendation", "confidence", "key_factors")


def orderbook_analysis(s, d):
    return flat(book_analysis(s, d), "symbol", "spread_class", "depth_pressure", "flow_direction", "micro_trend",
                "strong_support", "strong_resistance", "entry_recommendation", "confidence")


def price_trajectory(s, d):
    return flat(tr.price_trajectory(trending(s, d)))


def trajectory_part(*columns):
    def run(s, d):
        return flat(tr.price_trajectory(trending(s, d)), "symbol", *columns)

    return run


def momentum_part(*columns):
    def run(s, d):
        return flat(tr.momentum_trajectory(trending(s, d)), "symbol", *columns)

    return run


def adx_regime(s, d):
    adx = F.when(C("ltq") > 3, C("ltq").cast("double"))
    return m.ticks(s, d).select("seq", tr.adx_regime(adx).alias("regime"))


def sector_bias(s, d):
    r = m.rule_features(s, d).withColumn("sector", tr.sector_of(C("symbol")))
    change = C("acceleration")
    return flat(r.select("seq", "sector", tr.sector_bias(C("sector"), C("ts"), change).alias("bias")))


def rule_signals(side):
    def run(s, d):
        f = m.rule_features(s, d)
        fn = actionable.buy_signals if side == "BUY" else actionable.sell_signals
        return flat(fn(f, usd_inr_change=0.5), "symbol", "signal_ts", "strength", "confidence", "entry_price",
                    "target_price", "stop_loss", "time_horizon", "reasons", "risk_reward_ratio", "market_regime",
                    "sector_bias", "gap_risk_factor", "signal_quality_score")

    return run


def quant_boost(s, d):
    return flat(actionable.quant_boost(m.rule_features(s, d)), "seq", "quant_boost", "quant_reasons")


def statistical_target(s, d):
    r = m.rule_features(s, d)
    return flat(r.select("seq", actionable.statistical_target(C("close"), C("resistance"), C("momentum_abs")).alias("target")))


def combined_recommendation(s, d):
    r = m.rule_features(s, d)
    rule = F.when(C("entry_recommendation") != "WAIT", C("entry_recommendation"))
    return r.select("seq", actionable.combined_recommendation(rule, C("recommendation")).alias("final"))


def actionable_rows(s, d):
    bars = trending(s, d)
    book = ob.orderbook_analysis(m.book_quotes(s, d), m.trades(s, d), TRADE_ORDER)
    return cycle.actionable_cycle(bars, book, AS_OF, m.SYMBOL_SECTORS)


def actionable_signals(s, d):
    return flat(actionable_rows(s, d), "symbol", "signal_type", "strength", "confidence", "entry_price",
                "target_price", "stop_loss", "time_horizon", "reasons")


def enhanced_recommendation(s, d):
    f = stored(s, cycle.symbol_features(trending(s, d), as_of=AS_OF), "features")
    signals = actionable.actionable_signals(f, AS_OF, m.SYMBOL_SECTORS)
    return flat(actionable.enhanced_recommendation(signals, f))


def signal_analytics(s, d):
    bars = stored(s, b.recent_bars(trending(s, d)).drop("rn"), "recent")
    f = stored(s, cycle.symbol_features(bars, as_of=AS_OF), "features")
    signals = actionable.actionable_signals(f, AS_OF, m.SYMBOL_SECTORS)
    history = ind.indicator_history(bars)
    return flat(actionable.signal_analytics(supplier_symbols(s, d), signals, f, f, history))


def basic_signal(s, d):
    latest = ind.indicators_latest(calm(s, d), lookback=params.ADAPTIVE_PERIODS)
    return flat(actionable.basic_signal(latest), "symbol", "overall_signal", "signal_trend", "signal_confidence",
                "volume_label", "trend_score", "suggested_entry", "basic_stop", "basic_target", "reasons")


def component_rows(s, d):
    f = cycle.symbol_features(calm(s, d), momentum=False)
    book = ob.orderbook_analysis(m.book_quotes(s, d), m.trades(s, d), TRADE_ORDER)
    return cycle.component_snapshot(f, book)


def component(name):
    def run(s, d):
        c = component_rows(s, d)
        return flat(c.select("symbol", *[C(name)[k].alias(k) for k in ("score", "confidence", "direction", "reason")]))

    return run


def daily_context(s, d):
    latest = ind.indicators_latest(calm(s, d)).withColumn("ctx", un.daily_context())
    return flat(latest.select("symbol", "ctx.bias", "ctx.direction", "ctx.confidence"))


def price_block(s, d):
    return flat(component_rows(s, d).select("symbol", "price.*"))


def decided(s, d):
    return un.decide(m.component_snapshots(s, d))


def contributions(s, d):
    rows = un.contributions(m.component_snapshots(s, d)).select("symbol", "seq", F.explode("components").alias("c"))
    return flat(rows.select("symbol", "seq", "c.*"))


def combine(s, d):
    return flat(decided(s, d), "symbol", "seq", "score")


def base_confidence(s, d):
    return flat(decided(s, d), "symbol", "seq", "base_confidence")


def context_adjust(s, d):
    return flat(decided(s, d), "symbol", "seq", "confidence", "context_note")


def raw_direction(s, d):
    return flat(decided(s, d), "symbol", "seq", "raw_direction")


def persistence(s, d):
    return flat(un.persistence(decided(s, d)), "symbol", "seq", "direction", "persistence_reason")


def signal_part(*columns):
    def run(s, d):
        return flat(signals_of_events(s, d), "symbol", "seq", *columns)

    return run


def signal_cycle(s, d):
    bars = calm(s, d)
    out = cycle.signal_cycle(bars, m.book_quotes(s, d), m.trades(s, d), order=TRADE_ORDER)
    return flat(out, "symbol", "direction", "confidence", "score", "entry_price", "stop_loss", "target_price",
                "risk_per_unit", "position_size_qty", "risk_reward", "persistence_reason")


def bootstrap_snapshot(s, d):
    return flat(un.bootstrap_snapshot(bars_of(s, d)))


# --- top lists -------------------------------------------------------------------------------


def signal_history(s, d):
    return flat(sv.signal_history(signals_of_events(s, d), "U7", 30), "symbol", "seq", "direction", "confidence")


def merged_history(s, d):
    return flat(sv.merged_history(signals_of_events(s, d), 100), "symbol", "seq", "direction", "confidence")


def leaderboard(s, d):
    return flat(sv.leaderboard(latest_event_signals(s, d)), "symbol", "direction", "confidence", "entry_price")


def last_history_rows(s, d):
    return flat(sv.last_history_rows(signals_of_events(s, d), "U7"), "symbol", "seq", "direction", "confidence")


# --- streams ---------------------------------------------------------------------------------


def stream_ticks(s, d) -> DataFrame:
    e = flows.read_stream(s, d, m.table(s, d, "events").schema, "events.parquet")
    return e.where(C("value") > 0).select(
        F.concat(F.lit("U"), "user_id").alias("symbol"), C("ts").cast("timestamp").alias("ts"),
        C("event_id").alias("seq"), C("value").alias("ltp"),
        F.get_json_object("props", "$.k").cast("bigint").alias("ltq"), "event_type",
    )


def stream_ohlcv_1m(s, d):
    return flat(flows.run_to_table(s, flows.stream_bars(stream_ticks(s, d), delay="0 seconds"), "stream-bars"))


def stream_late_data(s, d):
    """A second file holds ticks behind the watermark; they change nothing."""
    src, out, checkpoint = (shared_dir(s, f"late-{n}") for n in ("in", "out", "state"))
    on_time = m.ticks(s, d)
    late = on_time.where(C("ts") < F.lit("2024-01-10").cast("timestamp")).withColumn("ltp", C("ltp") + 1000)
    for part in (on_time, late):
        part.write.mode("append").parquet(src)
        bars = flows.stream_bars(flows.read_stream(s, src, on_time.schema), delay="0 seconds")
        table = flows.run_to_table(s, bars, "late", out, checkpoint)
    return flat(table)


def corrected(s, d) -> tuple[DataFrame, DataFrame]:
    """All ticks but every fifth, then those and the first days once more at other prices."""
    src, base, checkpoint = (shared_dir(s, f"corrected-{n}") for n in ("in", "out", "state"))
    ticks = m.ticks(s, d)
    again = ticks.where(C("ts") < F.lit("2024-01-10").cast("timestamp")).withColumns({"ltp": C("ltp") + 1000, "seq": C("seq") + 10_000_000_000})
    for part in (ticks.where("seq % 5 <> 0"), ticks.where("seq % 5 = 0").unionByName(again)):
        part.write.mode("append").parquet(src)
        found = flows.run_corrected_bars(s, flows.read_stream(s, src, ticks.schema), delay="30 seconds", base=base, checkpoint=checkpoint)
    return found


def stream_corrected_bars(s, d):
    return flat(corrected(s, d)[0])


def stream_late_ticks(s, d):
    return flat(corrected(s, d)[1])


def stream_latest_quotes(s, d):
    quotes = stream_ticks(s, d).select("symbol", "ts", "seq", "ltp", "ltq")
    return flat(flows.run_latest_quotes(s, quotes))


def stream_dedup(s, d):
    """Every tick twice; repeats inside the watermark are dropped."""
    twice = stream_ticks(s, d).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    return flat(flows.run_to_table(s, flows.stream_dedup(twice), "stream-dedup"), "symbol", "ts", "ltp", "ltq")


def stream_persistence(s, d):
    src = shared_dir(s, "cycles")
    decided(s, d).select("symbol", "ts", "seq", "raw_direction", "confidence").write.parquet(src)
    rows = flows.read_stream(s, src, s.read.parquet(src).schema)
    return flat(flows.run_persistence(s, rows), "symbol", "seq", "direction", "persistence_reason")


def stream_signals(s, d):
    rows = stream_ticks(s, d)
    out = flows.run_signal_cycles(s, rows)
    return flat(out, "symbol", "updated_at", "direction", "confidence", "score", "entry_price", "persistence_reason")


# --- incomplete and tied input ---------------------------------------------------------------


def carry_nulls(s, d):
    """Ticks without a symbol or without a time stay rows of the result."""
    rows = m.ticks(s, d).withColumns({
        "symbol": F.when(C("seq") % 7 != 0, C("symbol")), "ts": F.when(C("seq") % 11 != 0, C("ts")),
    })
    return flat(sv.price_tick_direction(rows), "symbol", "seq", "ltp", "prev_ltp", "tick_direction")


def latest_quotes_ties(s, d):
    """All ticks of a day carry the same time; the message order decides."""
    rows = m.ticks(s, d).select("symbol", F.date_trunc("day", "ts").alias("ts"), "seq", "ltp", "ltq")
    return flat(sv.latest_quotes(rows))


def signal_history_long(s, d):
    """One symbol with every signal, and a limit above the default retention."""
    rows = signals_of_events(s, d).withColumn("symbol", F.lit("ALL"))
    return flat(sv.signal_history(rows, "ALL", 1000), "seq", "direction", "confidence")


def merged_history_long(s, d):
    return flat(sv.merged_history(signals_of_events(s, d), 1000), "symbol", "seq", "direction", "confidence")


def parse_candle_numbers(s, d):
    """Fractional volumes are truncated; NaN is no price and text no volume."""
    li = m.table(s, d, "lineitem")
    volume = (F.when(C("l_linenumber") == 4, '"many"').when(C("l_linenumber") == 2, F.format_string("%.1f", "l_quantity"))
              .otherwise(F.format_string("%.2f", C("l_quantity") + 0.75)))
    openp = F.when(C("l_linenumber") == 5, '"NaN"').otherwise(F.format_string("%.2f", "l_extendedprice"))
    rows = li.select(
        F.concat(F.lit("S"), "l_suppkey").alias("symbol"),
        F.format_string('[["%s",%s,%s,%s,%s,%s]]', F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), openp,
                        openp, openp, openp, volume).alias("candles"),
    )
    return flat(files.parse_candles(rows))


def valid_bars_nan(s, d):
    price = F.when(C("event_type") == "error", F.lit(float("nan"))).otherwise(C("ltp"))
    rows = m.ticks(s, d).select("symbol", "ts", *[price.alias(c) for c in ("open", "high", "low", "close")], C("ltq").alias("volume"))
    return flat(files.valid_bars(rows))


def component_forms(s, d) -> DataFrame:
    """Components that use the other names of direction, lean, confidence and text."""
    side = F.when(C("event_type") == "click", "buy").when(C("event_type") == "error", "SELL").otherwise("none")
    lean = C("ltq") / 49.7 - 1.0
    return m.ticks(s, d).select(
        "symbol", "ts", "seq",
        F.struct(side.alias("signal"), F.lit("").alias("reason"), F.lit("path").alias("summary"), (C("ltp") / 400.0).alias("strength")).alias("news_flow"),
        F.when(C("ltq") >= 20, F.struct(lean.alias("trend"), F.lit(0.0).alias("bias"), F.lit(0.5).alias("score"))).alias("quant"),
        F.struct(F.lit("").alias("direction"), side.alias("side"), lean.alias("bias")).alias("book-depth"),
        F.struct(F.struct((lean / 2).alias("score")).alias("daily_trend")).alias("context"),
        F.struct(F.lit(0.3).alias("1d")).alias("market"),
    )


FORM_WEIGHTS = {"news_flow": 0.5, "quant": 0.25, "book-depth": 0.25}


def contributions_aliases(s, d):
    rows = un.contributions(component_forms(s, d), FORM_WEIGHTS).select("symbol", "seq", F.explode("components").alias("c"))
    return flat(rows.select("symbol", "seq", "c.*"))


def context_forms(s, d):
    """Daily context as a number, as a score, and as a direction with or without confidence."""
    t = m.ticks(s, d)
    lean = C("ltq") / 49.7 - 1.0
    side = F.when(C("event_type") == "click", "bullish").when(C("event_type") == "error", "SELL").otherwise("flat")
    forms = {
        "number": F.struct(F.struct((lean * 2).alias("daily_trend")).alias("context")),
        "score": F.struct(F.struct(F.struct(lean.alias("score")).alias("1d")).alias("context")),
        "bias": F.struct(F.struct(F.struct(F.when(C("ltq") > 30, lean).alias("bias"), F.lit(0.1).alias("score")).alias("1d")).alias("market")),
        "side": F.struct(F.struct(F.struct(side.alias("direction")).alias("daily_trend")).alias("market")),
        "confidence": F.struct(F.struct(F.struct(side.alias("direction"), (C("ltp") / 90.0).alias("confidence")).alias("daily_trend")).alias("context")),
    }
    parts = []
    for form, context in forms.items():
        rows = t.select("seq", context.alias("c")).select("seq", "c.*")
        parts.append(rows.select(F.lit(form).alias("form"), "seq", un.snapshot_bias(rows).alias("bias")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return flat(out)


def rationale_custom(s, d):
    decided_rows = un.decide(component_forms(s, d), FORM_WEIGHTS).withColumn("direction", C("raw_direction"))
    return flat(un.rationale(decided_rows), "symbol", "seq", "rationale")


# --- further forms ---------------------------------------------------------------------------


def stop_loss_by(method):
    def run(s, d):
        return flat(q.stop_loss(calm(s, d), method), "symbol", "stop_loss", "stop_loss_pct", "stop_method")

    return run


def chart_minutes(s, d):
    """The minute chart: the bars of the last three days as they are."""
    return flat(b.chart_data(b.ohlcv_bars(m.ticks(s, d)), "U7", "1m", 4320, EVENTS_END))


def read_instruments_file(s, d):
    """Instrument lists of at most 1,000 entries, one document a file."""
    path = shared_dir(s, "instruments")
    number = F.substring("instrument_key", 2, 20).cast("bigint")
    listed = names(s, d).groupBy(F.floor(number / 1000).alias("list")).agg(F.collect_list(F.struct("name", "instrument_key")).alias("symbols"))
    listed.select("symbols").write.option("maxRecordsPerFile", 1).json(path)
    return files.read_instruments(s, path)


QUERIES = {
    **{f"stop_loss_{method}": stop_loss_by(method) for method in ("var", "volatility", "support", "percentile")},
    "chart_minutes": chart_minutes,
    "read_instruments_file": read_instruments_file,
    "carry_nulls": carry_nulls,
    "latest_quotes_ties": latest_quotes_ties,
    "signal_history_long": signal_history_long,
    "merged_history_long": merged_history_long,
    "parse_candle_numbers": parse_candle_numbers,
    "valid_bars_nan": valid_bars_nan,
    "contributions_aliases": contributions_aliases,
    "context_forms": context_forms,
    "rationale_custom": rationale_custom,
    # scans, sources, sinks
    "read_instruments": read_instruments,
    "read_bars": read_bars,
    "parse_candle_arrays": parse_candle_arrays,
    "explode_feed": explode_feed,
    "upsert_bars": upsert_bars,
    "store_bars": store_bars,
    "compacted_bars": compacted_bars,
    "bar_metadata": bar_metadata,
    "append_signal_history": append_signal_history,
    "signal_payload": signal_payload,
    "ingest_run_stats": ingest_run_stats,
    "latest_entry": lambda s, d: flat(b.latest_entry(bars_of(s, d))),
    "indicator_history": indicator_history,
    # projections, filters, predicates
    "valid_bars": valid_bars,
    "best_quote": best_quote,
    "top_levels": top_levels,
    "parse_exchange_ts": parse_exchange_ts,
    "active_symbols": active_symbols,
    "bars_in_range": bars_in_range,
    "market_hours": market_hours,
    "high_vol_session": high_vol_session,
    "session_vol_factor": session_vol_factor,
    "clamp": clamp,
    "stale_symbols": stale_symbols,
    "price_tick_direction": price_tick_direction,
    "signal_freshness": signal_freshness,
    "signal_quality": signal_quality,
    "signal_for": signal_for,
    "all_signals": all_signals,
    "live_symbols": live_symbols,
    "daily_trend_from_technical": daily_trend_from_technical,
    # joins
    "align_series": align_series,
    "label_symbols": label_symbols,
    "subscribed_only": subscribed_only,
    "sector_of": sector_of,
    "live_prices": live_prices,
    "live_prices_fallback": live_prices_fallback,
    "assemble_snapshot": assemble_snapshot,
    "missing_bars": missing_bars,
    "absent_bars": absent_bars,
    "bars_with_context": bars_with_context,
    # aggregations
    "bars_1m": bars_1m,
    "bars_1d": bars_1d,
    "resample_1h": resample("1h"),
    "resample_4h": resample("4h"),
    "resample_1d": resample("1d"),
    "bar_change_summary": bar_change_summary,
    "chart_stats": chart_stats,
    "chart_data": chart_data,
    "depth_stats": depth_stats,
    "signals_summary": signals_summary,
    "pipeline_stats": pipeline_stats,
    "percentile_linear": percentile_linear,
    "percentile_linear_hot": percentile_linear_hot,
    "price_tick_direction_hot": price_tick_direction_hot,
    "persistence_hot": persistence_hot,
    "recent_bars_hot": recent_bars_hot,
    "price_tick_direction_hour": price_tick_direction_hour,
    "persistence_hour": persistence_hour,
    "asof_context_hour": asof_context_hour,
    "percentile_rank_score": percentile_rank_score,
    "trend_fit": trend_fit,
    "autocorr_lag1": autocorr_lag1,
    # indicators
    "sma": series_query("sma_5", "sma_10", "sma_20", "sma_50"),
    "ema": series_query("ema_5", "ema_10", "ema_20"),
    "rsi": series_query("rsi"),
    "macd": series_query("macd", "macd_signal", "macd_hist"),
    "bollinger": series_query("bb_upper", "bb_middle", "bb_lower"),
    "atr": series_query("tr", "atr"),
    "adx": series_query("adx"),
    "market_regime": market_regime,
    "adaptive_rsi_levels": adaptive("rsi_oversold", "rsi_overbought"),
    "adaptive_volume_levels": adaptive("volume_high", "volume_low"),
    "swing_points": swing_points,
    "volume_roc": series_query("volume_roc"),
    "obv": series_query("obv"),
    "vwap": series_query("vwap"),
    "volume_ratio": series_query("volume_sma_20", "volume_ratio"),
    "indicators_latest": indicators_latest,
    "indicators_latest_wilder": indicators_latest_wilder,
    "indicator_record": record_query("simple"),
    "indicator_record_wilder": record_query("wilder"),
    "recent_bars_whole": recent_bars_whole,
    "indicator_append": indicator_append,
    "whole_means": whole_series("sma_20", "ema_5", "ema_20"),
    "whole_macd": whole_series("macd", "macd_signal"),
    "whole_adx": whole_series("rsi", "adx"),
    "whole_wilder": whole_series("rsi", "atr", "macd", "macd_signal", "adx", method="wilder"),
    "wilder_means": series_query("sma_20", "ema_20", "bb_upper", "bb_lower", method="wilder"),
    "wilder_rsi_atr": series_query("rsi", "atr", method="wilder"),
    "wilder_macd": series_query("macd", "macd_signal", method="wilder"),
    "wilder_adx": series_query("adx", method="wilder"),
    # quant
    "momentum_score": momentum_score,
    "mean_reversion": of_calm(q.mean_reversion),
    "volatility_regime": of_calm(q.volatility_regime, "symbol", "vol_regime", "current_vol", "vol_percentile", "vol_score", "vol_forecast"),
    "support_resistance": of_calm(q.support_resistance),
    "volume_confirmation": of_calm(q.volume_confirmation),
    "stop_loss": of_calm(q.stop_loss),
    "stop_loss_atr": stop_loss_atr,
    "position_size": of_calm(q.position_size),
    "quant_score": of_calm(q.quant_score),
    "risk_metrics": of_calm(q.risk_metrics),
    "trading_plan": of_calm(q.trading_plan),
    # order book
    "spread_analysis": spread_analysis,
    "order_flow": order_flow,
    "book_support_resistance": book_support_resistance,
    "tick_micro_trend": tick_micro_trend,
    "orderbook_signal": orderbook_signal,
    "orderbook_analysis": orderbook_analysis,
    # trajectory
    "price_trajectory": price_trajectory,
    "trend_strength": trajectory_part("short_trend", "medium_trend", "long_trend"),
    "acceleration": trajectory_part("acceleration"),
    "trend_consistency": trajectory_part("trend_consistency"),
    "overall_trajectory": trajectory_part("overall_trajectory"),
    "gap_risk_factor": trajectory_part("gap_risk_factor"),
    "indicator_trajectory": momentum_part("rsi_direction", "rsi_strength", "rsi_level", "volume_direction", "volume_strength"),
    "macd_cross": momentum_part("macd_cross", "macd_trend", "macd_divergence"),
    "ma_cross": momentum_part("ma_signal", "ma_alignment", "sma_5_trend", "sma_20_trend"),
    "momentum_composite": momentum_part("composite_momentum", "momentum_direction", "momentum_abs"),
    "adx_regime": adx_regime,
    "sector_bias": sector_bias,
    "buy_signal": rule_signals("BUY"),
    "sell_signal": rule_signals("SELL"),
    "quant_boost": quant_boost,
    "statistical_target": statistical_target,
    "combined_recommendation": combined_recommendation,
    "enhanced_recommendation": enhanced_recommendation,
    "actionable_signals": actionable_signals,
    "signal_analytics": signal_analytics,
    # basic and unified signals
    "basic_signal": basic_signal,
    "technical_component": component("technical"),
    "quant_component": component("quant"),
    "orderbook_component": component("orderbook"),
    "regime_component": component("market_regime"),
    "trajectory_component": component("trajectory"),
    "daily_context": daily_context,
    "price_block": price_block,
    "contributions": contributions,
    "combine": combine,
    "base_confidence": base_confidence,
    "context_adjust": context_adjust,
    "raw_direction": raw_direction,
    "persistence": persistence,
    "risk_levels": signal_part("entry_price", "stop_loss", "target_price"),
    "unified_position_size": signal_part("risk_per_unit", "position_size_value", "position_size_qty"),
    "risk_reward": signal_part("risk_reward"),
    "rationale": signal_part("rationale"),
    "unified_signal": signal_part("direction", "confidence", "score", "entry_price", "persistence_reason"),
    "signal_cycle": signal_cycle,
    "bootstrap_snapshot": bootstrap_snapshot,
    # sort, limit, top lists, set operations
    "recent_bars": recent_bars,
    "signal_history": signal_history,
    "merged_history": merged_history,
    "leaderboard": leaderboard,
    "last_history_rows": last_history_rows,
    "union_intraday_historical": union_intraday_historical,
    "union_buy_sell": lambda s, d: flat(rule_rows(s, d), "symbol", "signal_type", "strength_rank", "confidence"),
    "dedup_bars": dedup_bars,
    # streams
    "stream_ohlcv_1m": stream_ohlcv_1m,
    "stream_late_data": stream_late_data,
    "stream_corrected_bars": stream_corrected_bars,
    "stream_late_ticks": stream_late_ticks,
    "latest_quotes": latest_quotes,
    "stream_latest_quotes": stream_latest_quotes,
    "stream_signals": stream_signals,
    "stream_persistence": stream_persistence,
    "stream_dedup": stream_dedup,
}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: one unified signal per symbol."""
    return signal_cycle(spark, sf_dir)
