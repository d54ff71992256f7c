"""Explicit schemas of the inputs; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

BAR = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
    ]
)

INSTRUMENTS = T.StructType(
    [
        T.StructField(
            "symbols",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("instrument_key", T.StringType()),
                    ]
                )
            ),
        )
    ]
)

LAST_TRADE = T.StructType(
    [
        T.StructField("ltp", T.DoubleType()),
        T.StructField("ltt", T.LongType()),
        T.StructField("ltq", T.LongType()),
        T.StructField("cp", T.DoubleType()),
    ]
)

# Level keys come in a long and a short spelling.
DEPTH_LEVEL = T.StructType(
    [
        T.StructField("bidQ", T.LongType()),
        T.StructField("bidP", T.DoubleType()),
        T.StructField("askQ", T.LongType()),
        T.StructField("askP", T.DoubleType()),
        T.StructField("bq", T.LongType()),
        T.StructField("bp", T.DoubleType()),
        T.StructField("aq", T.LongType()),
        T.StructField("ap", T.DoubleType()),
    ]
)

GREEKS = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("delta", "theta", "gamma", "vega", "rho")]
)

EXCHANGE_BAR = T.StructType(
    [
        T.StructField("interval", T.StringType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("vol", T.LongType()),
        T.StructField("ts", T.LongType()),
    ]
)

_EXCHANGE_BARS = T.StructType([T.StructField("ohlc", T.ArrayType(EXCHANGE_BAR))])

MARKET_FEED = T.StructType(
    [
        T.StructField("ltpc", LAST_TRADE),
        T.StructField(
            "marketLevel", T.StructType([T.StructField("bidAskQuote", T.ArrayType(DEPTH_LEVEL))])
        ),
        T.StructField("optionGreeks", GREEKS),
        T.StructField("marketOHLC", _EXCHANGE_BARS),
        T.StructField("atp", T.DoubleType()),
        T.StructField("vtt", T.LongType()),
        T.StructField("oi", T.DoubleType()),
        T.StructField("iv", T.DoubleType()),
        T.StructField("tbq", T.DoubleType()),
        T.StructField("tsq", T.DoubleType()),
    ]
)

INDEX_FEED = T.StructType(
    [T.StructField("ltpc", LAST_TRADE), T.StructField("marketOHLC", _EXCHANGE_BARS)]
)

FEED = T.StructType(
    [
        T.StructField("ltpc", LAST_TRADE),
        T.StructField(
            "fullFeed",
            T.StructType(
                [T.StructField("marketFF", MARKET_FEED), T.StructField("indexFF", INDEX_FEED)]
            ),
        ),
        T.StructField(
            "firstLevelWithGreeks",
            T.StructType(
                [
                    T.StructField("ltpc", LAST_TRADE),
                    T.StructField("firstDepth", DEPTH_LEVEL),
                    T.StructField("optionGreeks", GREEKS),
                ]
            ),
        ),
    ]
)

FEED_MESSAGE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("feeds", T.MapType(T.StringType(), FEED)),
        T.StructField("currentTs", T.LongType()),
    ]
)

CANDLES = T.ArrayType(T.ArrayType(T.StringType()))
