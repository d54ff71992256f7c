"""Bars: building, resampling, merging, selecting and describing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barweave import params
from barweave.functions.scalar import lit_or_col, order_key, ratio
from barweave.functions.topn import latest_n

PRICES = ("open", "high", "low", "close")

# Bins are aligned to midnight in India (18:30 UTC): width, offset from the UTC epoch.
TIMEFRAMES = {
    "1h": ("1 hour", "30 minutes"),
    "4h": ("4 hours", "2 hours 30 minutes"),
    "1d": ("1 day", "18 hours 30 minutes"),
}
LOOKBACK_UNIT = {"1m": "1 minute", "1h": "1 hour", "4h": "4 hours", "1d": "1 day"}


def ohlcv_bars(ticks: DataFrame, width: str = "1 minute", order: Column | None = None) -> DataFrame:
    """Ticks to bars per symbol and tumbling window; batch and streaming input alike.

    First and last price follow (event time, sequence id). Every buffer is
    updatable in place, so the aggregation is hash-based with map-side combine and
    a hot symbol costs one partial row per task and window.
    """
    order = order_key(F.col("ts"), F.col("seq")) if order is None else order
    return (
        ticks.groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("ltp", order).alias("open"),
            F.max("ltp").alias("high"),
            F.min("ltp").alias("low"),
            F.max_by("ltp", order).alias("close"),
            F.sum("ltq").alias("volume"),
            F.count("*").alias("tick_count"),
            F.min("ts").alias("first_tick_time"),
            F.max("ts").alias("last_tick_time"),
        )
        .select(
            "symbol",
            F.col("w.start").alias("ts"),
            *PRICES,
            "volume",
            "tick_count",
            "first_tick_time",
            "last_tick_time",
        )
    )


def resample_bars(bars: DataFrame, timeframe: str) -> DataFrame:
    """Bars to 1h / 4h / 1d bars aligned to midnight in India; empty bins do not appear."""
    width, offset = TIMEFRAMES[timeframe]
    return (
        bars.groupBy("symbol", F.window("ts", width, width, offset).alias("w"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("ts"), *PRICES, "volume")
    )


def bar_change_summary(bars: DataFrame) -> DataFrame:
    change = F.when(F.col("open") > 0, (F.col("close") - F.col("open")) / F.col("open") * 100)
    return bars.withColumn("change_pct", F.coalesce(change, F.lit(0.0)))


def chart_stats(bars: DataFrame) -> DataFrame:
    """Statistics of a chart range; high and low are those of the closes."""
    return (
        bars.groupBy("symbol")
        .agg(
            F.max_by("close", "ts").alias("latest_price"),
            F.min_by("close", "ts").alias("first_price"),
            F.sum("volume").alias("volume_24h"),
            F.max("close").alias("high_24h"),
            F.min("close").alias("low_24h"),
            F.count("*").alias("data_points"),
            F.min("ts").alias("range_start"),
            F.max("ts").alias("range_end"),
        )
        .withColumn("price_change", F.col("latest_price") - F.col("first_price"))
        .withColumn(
            "price_change_pct",
            F.when(
                F.col("first_price") > 0, ratio(F.col("price_change"), F.col("first_price")) * 100
            ).otherwise(0.0),
        )
    )


def bars_in_range(bars: DataFrame, timeframe: str, limit: int, as_of) -> DataFrame:
    """Bars of the last ``limit`` units before ``as_of`` (a literal or a column)."""
    count, unit = LOOKBACK_UNIT.get(timeframe, "1 minute").split()
    unit = unit if unit.endswith("s") else unit + "s"
    end = lit_or_col(as_of).cast("timestamp")
    span = F.expr(f"INTERVAL {limit * int(count)} {unit}")
    return bars.where((F.col("ts") >= end - span) & (F.col("ts") <= end))


def chart_data(bars: DataFrame, symbol: str, timeframe: str, limit: int, as_of) -> DataFrame:
    """Chart series of one symbol: range filter, then resampling or the last minutes."""
    chosen = bars_in_range(bars.where(F.col("symbol") == symbol), timeframe, limit, as_of)
    if timeframe in TIMEFRAMES:
        return resample_bars(chosen, timeframe).orderBy("ts")
    newest = chosen.orderBy(F.col("ts").desc()).limit(limit)
    return newest.select("symbol", "ts", *PRICES, "volume").orderBy("ts")


def recent_bars(bars: DataFrame, n: int = params.LOOKBACK, splits: int = params.HOT_KEY_SPLITS) -> DataFrame:
    """Latest ``n`` bars of each symbol with ``rn`` = 1 for the newest.

    A symbol is ranked in ``splits`` parts first, so that a hot one does not send the
    newest rows of every task to a single task.
    """
    return latest_n(bars, ["symbol"], [F.col("ts").desc()], n, splits=splits)


def align_series(series: DataFrame, fields: tuple[str, ...] = PRICES + ("volume",)) -> DataFrame:
    """Long form (symbol, ts, field, value) to one row per (symbol, ts)."""
    return series.groupBy("symbol", "ts").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields]
    )


def long_series(bars: DataFrame, fields: tuple[str, ...] = PRICES + ("volume",)) -> DataFrame:
    """Wide bars to one row per field, the form a store keeps one series per field in."""
    wide = bars.select("symbol", "ts", *[F.col(f).cast("double").alias(f) for f in fields])
    return wide.unpivot(["symbol", "ts"], list(fields), "field", "value")


def union_intraday_historical(
    intraday: DataFrame, historical: DataFrame, target: int = params.LOOKBACK
) -> DataFrame:
    """Intraday rows first, history only for symbols with fewer than ``target`` of them.

    This is the rule of a source whose history is only fetched on demand; ``stack_sources``
    keeps everything.
    """
    enough = intraday.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") >= target)
    needed = historical.join(enough.select("symbol"), "symbol", "left_anti")
    return stack_sources(intraday, needed)


def stack_sources(intraday: DataFrame, historical: DataFrame) -> DataFrame:
    """All rows of both sources, tagged; intraday has the better rank."""

    def tag(df, name, rank):
        return df.withColumn("source", F.lit(name)).withColumn("source_rank", F.lit(rank))

    return tag(intraday, "intraday", 0).unionByName(tag(historical, "historical", 1))


def dedup_bars(bars: DataFrame) -> DataFrame:
    """One bar per symbol and epoch second, the first source wins.

    Within a source the earlier bar of a second wins. The ordering is one integer,
    the same for all fields, so each field comes from the same row.
    """
    order = F.col("source_rank").cast("bigint") * 1_000_000 + F.pmod(
        F.unix_micros("ts"), F.lit(1_000_000)
    )
    fields = ("ts", *PRICES, "volume", "source_rank")
    return (
        bars.withColumn("_second", F.unix_seconds("ts"))
        .groupBy("symbol", "_second")
        .agg(*[F.min_by(f, order).alias(f) for f in fields])
        .withColumn("source", F.when(F.col("source_rank") == 0, "intraday").otherwise("historical"))
        .drop("_second")
    )


def missing_bars(history: DataFrame, stored: DataFrame, as_of, gap_minutes: int = 2) -> DataFrame:
    """History rows after the last stored bar, for symbols whose store lags ``as_of``.

    Symbols that were never stored are left out.
    """
    end = lit_or_col(as_of).cast("timestamp")
    last = (
        stored.groupBy("symbol")
        .agg(F.max("ts").alias("last_ts"))
        .where(end - F.col("last_ts") > F.expr(f"INTERVAL '{gap_minutes}' MINUTE"))
    )
    return history.join(last, "symbol").where(F.col("ts") > F.col("last_ts")).drop("last_ts")


def absent_bars(history: DataFrame, stored: DataFrame) -> DataFrame:
    """History rows that the store does not hold at all."""
    return history.join(stored.select("symbol", "ts"), ["symbol", "ts"], "left_anti")


def latest_entry(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.max("ts").alias("last_ts"), F.max_by("close", "ts").alias("last_close")
    )


def stale_symbols(symbols: DataFrame, bars: DataFrame, as_of, minutes: int = 2) -> DataFrame:
    """Symbols without data, or whose last bar is older than ``minutes``."""
    end = lit_or_col(as_of).cast("timestamp")
    last = bars.groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    old = end - F.col("last_ts") > F.expr(f"INTERVAL '{minutes}' MINUTE")
    return symbols.select("symbol").join(last, "symbol", "left").where(F.col("last_ts").isNull() | old)


def bar_metadata(bars: DataFrame, sources: tuple[str, ...] = ("intraday", "historical")) -> DataFrame:
    """Count, range and sources of each symbol's bars."""
    used = [F.when(F.bool_or(F.col("source") == s), F.lit(s)) for s in sources]
    return bars.groupBy("symbol").agg(
        F.count("*").alias("candles_count"),
        F.min("ts").alias("oldest_time"),
        F.max("ts").alias("newest_time"),
        F.array_compact(F.array(*used)).alias("strategies"),
    )


def ingest_run_stats(symbols: DataFrame, bars: DataFrame) -> DataFrame:
    """Totals of a load: symbols asked for, symbols with bars, bars, rates."""
    counts = bars.groupBy("symbol").agg(F.count("*").alias("n"))
    return (
        symbols.select("symbol")
        .join(counts, "symbol", "left")
        .agg(
            F.count("*").alias("total_symbols"),
            F.count("n").alias("symbols_successful"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_candles"),
        )
        .withColumn(
            "success_rate",
            F.coalesce(ratio(F.col("symbols_successful"), F.col("total_symbols")) * 100, F.lit(0.0)),
        )
        .withColumn(
            "avg_candles_per_symbol",
            F.col("total_candles") / F.greatest(F.lit(1), F.col("symbols_successful")),
        )
    )
