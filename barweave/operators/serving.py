"""Serving queries: prices, leaderboards, histories, status and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from barweave import params
from barweave.functions.carry import carry_last
from barweave.functions.scalar import clean_name, ist, lit_or_col, order_key, ratio
from barweave.functions.topn import latest_n

C = F.col
HISTORY_DEFAULT = 60
SIGNAL_ROWS, PRICE_ROWS = 8, 12
PRICE_FIELDS = ("ltp", "best_bid", "best_ask", "spread_pct")
FRESH_SECONDS = 70


def market_hours(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Open flag, weekend flag and status text of each time; Mon-Fri 09:15-15:30 IST."""
    local = ist(C(ts))
    second = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    # fractions of a second after the close are already closed
    micros = F.unix_micros(C(ts)) % 1_000_000
    opens, closes = 9 * 3600 + 15 * 60, 15 * 3600 + 30 * 60
    df = df.withColumns({"_second": second, "_weekday": F.weekday(local) < 5})
    inside = (C("_second") >= opens) & (
        (C("_second") < closes) | ((C("_second") == closes) & (micros == 0))
    )

    def clock(seconds: Column) -> Column:
        return F.format_string(
            "%d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
        )

    return df.withColumns(
        {
            "is_open": C("_weekday") & inside,
            "is_weekend": ~C("_weekday"),
            "status_message": F.when(
                C("_weekday") & inside, F.concat(F.lit("Market closes in "), clock(closes - C("_second")))
            )
            .when(
                C("_weekday") & (C("_second") < opens),
                F.concat(F.lit("Market opens in "), clock(opens - C("_second"))),
            )
            .otherwise("Market closed"),
        }
    ).drop("_second", "_weekday")


def active_symbols(quotes: DataFrame) -> DataFrame:
    return quotes.agg(F.count_if(C("ltp").isNotNull()).alias("active_symbols"))


def live_symbols(quotes: DataFrame) -> DataFrame:
    """Symbols with a price: clean name, price, number of ticks, last update."""
    return quotes.where(C("ltp").isNotNull()).select(
        "symbol",
        clean_name(C("symbol")).alias("symbol_clean"),
        "instrument_key",
        C("ltp").alias("latest_price"),
        C("tick_count").alias("data_points"),
        F.lit(0.0).alias("return_pct"),
        "last_update",
    )


def _in_place(kind: T.DataType) -> bool:
    """Values of fixed width, which an aggregation buffer can replace in place (hash aggregation)."""
    return isinstance(kind, T.NumericType | T.DatetimeType | T.BooleanType)


def latest_quotes(quotes: DataFrame, keys: tuple[str, ...] = ("symbol",), fields: tuple[str, ...] | None = None) -> DataFrame:
    """Last quote and number of ticks of each key, all fields or those named; batch and streaming (update mode).

    Quotes of the same instant are ordered by ``seq`` where the feed brings it (exchange
    times are whole seconds or milliseconds, so ties are normal), else by a hash of their
    values: which row wins never depends on the layout of files. A key without any time has
    no newest quote: its fields are NULL.

    Fields of fixed width come from one hash aggregation. Where a text or an array is asked
    for, the aggregation finds the newest order key only and a join on (key, order key)
    fetches the row, so the feed is never sorted and a hot key spreads over its order keys.
    """
    fields = list(fields or [c for c in quotes.columns if c not in (*keys, "ts", "seq")])
    tie = C("seq") if "seq" in quotes.columns else F.xxhash64(*fields)
    order = order_key(C("ts"), F.coalesce(tie, F.lit(0)))
    counted = [F.max("ts").alias("last_update"), F.count("*").alias("tick_count")]
    if quotes.isStreaming or all(_in_place(quotes.schema[c].dataType) for c in fields):
        # the same ordering picks the same row for every field
        newest = [F.max_by(c, order).alias(c) for c in fields]
        return quotes.groupBy(*keys).agg(*newest, *counted).select(*keys, *fields, "last_update", "tick_count")
    rows = quotes.withColumn("_order", order)
    newest = rows.groupBy(*keys).agg(F.max("_order").alias("_newest"), *counted)
    newest = newest.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = C("_order").eqNullSafe(C("_newest"))
    for k in keys:
        same &= C(k).eqNullSafe(C(f"_key_{k}"))
    # few rows are left; repeated deliveries of the newest quote count once
    wide = rows.join(newest, same).withColumn("_tie", F.xxhash64(*fields))
    wide = latest_n(wide, list(keys), [C("_tie").desc()], 1)
    shown = [F.when(C("_newest").isNotNull(), C(c)).alias(c) for c in fields]
    return wide.select(*keys, *shown, "last_update", "tick_count")


def price_tick_direction(prices: DataFrame, segment_rows: int = params.SEGMENT_ROWS) -> DataFrame:
    """up / down against the symbol's previous price, NULL for equal or first."""
    df = carry_last(prices, "symbol", "ts", "seq", "ltp", "prev_ltp", segment_rows=segment_rows)
    return df.withColumn(
        "tick_direction",
        F.when(C("ltp") > C("prev_ltp"), "up").when(C("ltp") < C("prev_ltp"), "down"),
    )


def signal_freshness(signals: DataFrame, as_of, limit: int = FRESH_SECONDS) -> DataFrame:
    age = F.greatest(
        F.lit(0),
        F.floor(
            (F.unix_micros(lit_or_col(as_of).cast("timestamp")) - F.unix_micros("updated_at")) / 1_000_000
        ),
    )
    df = signals.withColumn("age_seconds", age)
    return df.withColumn("freshness", F.when(C("age_seconds") <= limit, "fresh").otherwise("stale"))


def latest_signals(signals: DataFrame) -> DataFrame:
    """Newest signal of every symbol."""
    return latest_n(signals, ["symbol"], [C("updated_at").desc(), C("seq").desc()], 1, splits=params.HOT_KEY_SPLITS).drop("rn")


def signal_for(signals: DataFrame, symbol: str) -> DataFrame:
    """Newest signal of one symbol; no row when there is none."""
    mine = signals.where(C("symbol") == symbol)
    return mine.orderBy(C("updated_at").desc(), C("seq").desc()).limit(1)


def live_prices(quotes: DataFrame, signals: DataFrame) -> DataFrame:
    """Quotes with the symbol's signal, most confident first.

    Without any quote the signals' own price context is shown instead. Both cases come
    from one join; whether there is any quote is a flag of one row.
    """
    quoted = quotes.select("symbol", *[C(c).alias(f"_{c}") for c in (*PRICE_FIELDS, "last_update")], F.lit(True).alias("_quoted"))
    own = signals.select("symbol", "direction", "confidence", "updated_at", "entry_price", C("extra.price_context").alias("_own"))
    rows = quoted.join(own, "symbol", "full_outer")
    is_quoted = F.coalesce("_quoted", F.lit(False))
    rows = rows.where(is_quoted | ~quotes.select(F.lit(1)).limit(1).exists())
    fallback = {c: C("_own")[c] for c in PRICE_FIELDS} | {"ltp": F.coalesce(C("_own")["ltp"], C("entry_price"))}
    shown = rows.select(
        "symbol", *[F.when(is_quoted, C(f"_{c}")).otherwise(fallback[c]).alias(c) for c in PRICE_FIELDS],
        F.coalesce("_last_update", "updated_at").alias("updated_at"), "direction", "confidence",
    )
    return shown.orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "symbol")


def leaderboard(rows: DataFrame, k: int = SIGNAL_ROWS) -> DataFrame:
    """Most confident rows; a missing confidence counts as 0."""
    return rows.orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "symbol").limit(k)


def signal_history(history: DataFrame, symbol: str, limit: int = HISTORY_DEFAULT) -> DataFrame:
    """Last ``limit`` signals of one symbol, oldest first.

    How much history there is, is a property of the table (see ``capped_history``).
    """
    mine = history.where(C("symbol") == symbol)
    newest = mine.orderBy(C("updated_at").desc(), C("seq").desc()).limit(limit)
    return newest.orderBy("updated_at", "seq")


def merged_history(history: DataFrame, limit: int = HISTORY_DEFAULT) -> DataFrame:
    """Newest signals over all symbols, of whatever history the table retains."""
    return history.orderBy(C("updated_at").desc(), C("seq").desc()).limit(limit)


def last_history_rows(history: DataFrame, symbol: str, fetched: int = 20, shown: int = 12) -> DataFrame:
    """The ``shown`` oldest of the last ``fetched`` signals, newest first."""
    newest = signal_history(history, symbol, fetched)
    return newest.orderBy("updated_at", "seq").limit(shown).orderBy(C("updated_at").desc(), C("seq").desc())


def pipeline_stats(ticks: DataFrame, signals: DataFrame) -> DataFrame:
    """Processed and usable ticks, success rate, active symbols and symbols with a signal.

    Both inputs are reduced to one row per symbol first, so the stacked rows are few.
    """
    seen = ticks.groupBy("symbol").agg(
        F.count("*").alias("processed"), F.count("ltp").alias("successful")
    )
    signalled = signals.select("symbol").distinct()
    rows = seen.select("symbol", "processed", "successful", F.lit(0).alias("signalled")).unionByName(
        signalled.select(
            "symbol", F.lit(0).cast("bigint").alias("processed"), F.lit(0).cast("bigint").alias("successful"),
            F.lit(1).alias("signalled"),
        )
    )
    return rows.agg(
        F.coalesce(F.sum("processed"), F.lit(0)).alias("processed_ticks"),
        F.coalesce(F.sum("successful"), F.lit(0)).alias("successful_ticks"),
        F.count_if(C("successful") > 0).alias("active_symbols"),
        F.coalesce(F.sum("signalled"), F.lit(0)).alias("symbols_with_signals"),
    ).withColumn(
        "success_rate",
        F.coalesce(ratio(C("successful_ticks"), C("processed_ticks")) * 100, F.lit(0.0)),
    )
