"""Indicator history that grows by appending: a new bar costs one row, not the whole lookback.

What a symbol's next values need of its past is small: for every recursion its last value
(a batch of k bars maps it to (1 - a)^k times itself plus a part of the new bars alone), and
for the rolling means the last ``TAIL`` bars. This summary is the state; appending in any
cuts gives the series of the whole history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barweave import params
from barweave.functions import series as s
from barweave.functions.scalar import ratio
from barweave.operators.indicators import cap_history
from barweave.sources.keyed_log import KeyedLog, newest_rows

C = F.col
TAIL = 20  # bars that the longest rolling mean reads
BAR = "struct<ts: timestamp, close: double, volume: double, gain: double, loss: double>"
STATE = f"symbol string, n long, last_ts timestamp, ema_12 double, ema_26 double, macd_signal double, tail array<{BAR}>"
HISTORY = "symbol string, ts timestamp, rsi double, macd double, macd_signal double, sma_5 double, sma_20 double, volume_ratio double"
COMPACT_EVERY = 20


def _with_past(state: DataFrame, bars: DataFrame) -> DataFrame:
    """New bars with the state of their symbol, and before them the bars of its tail."""
    known = state.select("symbol", "n", "last_ts", *[C(c).alias(f"_{c}") for c in ("ema_12", "ema_26", "macd_signal")], "tail")
    bars = bars.select("symbol", "ts", C("close").cast("double").alias("close"), C("volume").cast("double").alias("volume"))
    joined = bars.join(known, "symbol", "left").where(C("last_ts").isNull() | (C("ts") > C("last_ts")))
    carried = ("n", "_ema_12", "_ema_26", "_macd_signal")
    new = joined.select("symbol", "ts", "close", "volume", F.lit(None).cast("double").alias("gain"), F.lit(None).cast("double").alias("loss"), F.lit(True).alias("is_new"), *carried)
    ticking = joined.select("symbol").distinct()
    old = known.join(ticking, "symbol", "left_semi").select("symbol", F.explode("tail").alias("b"), *carried)
    return new.unionByName(old.select("symbol", "b.*", F.lit(False).alias("is_new"), *carried))


def append(state: DataFrame, bars: DataFrame, largest: int = s.CLOSED_FORM_ROWS) -> DataFrame:
    """Series of the new bars, of which a symbol has at most ``largest``, and of the tails before them.

    ``is_new`` marks the new bars.

    A bar that is not after its symbol's last one is left out: a corrected bar needs the
    history recomputed. A bar without a close carries no value and is left out as well.
    """
    rows = _with_past(state, bars.where(C("close").isNotNull() & C("ts").isNotNull()))
    delta = C("close") - s.lag("close")
    rows = rows.withColumns(
        {
            "i": F.row_number().over(s.by_time()) - 1,
            "at": F.coalesce("n", F.lit(0)) + F.sum(C("is_new").cast("long")).over(s.running()) - 1,
            "gain": F.when(C("is_new"), F.when(delta > 0, delta).otherwise(0.0)).otherwise(C("gain")),
            "loss": F.when(C("is_new"), F.when(delta < 0, -delta).otherwise(0.0)).otherwise(C("loss")),
        }
    )

    def step(x: Column, n: int) -> tuple[Column, float]:
        """The recursion's term for new bars; bars of the tail are in the state already."""
        u, d = s.ema(x, n, first=C("at") == 0)
        return F.when(C("is_new"), u), d

    def carried(name: str, n: int) -> Column:
        """The part of the state, decayed over the new bars up to this one."""
        decay = F.pow(F.lit(1 - 2.0 / (n + 1)), C("at") - F.coalesce("n", F.lit(0)) + 1)
        return C(name) + F.coalesce(C(f"_{name}"), F.lit(0.0)) * decay

    rows = s.linear(rows, {"ema_12": step(C("close"), 12), "ema_26": step(C("close"), 26)}, largest + TAIL)
    rows = rows.withColumns({"ema_12": carried("ema_12", 12), "ema_26": carried("ema_26", 26)})
    rows = rows.withColumn("macd", C("ema_12") - C("ema_26"))
    rows = s.linear(rows, {"macd_signal": step(C("macd"), 9)}, largest + TAIL).withColumn("macd_signal", carried("macd_signal", 9))
    rows = rows.withColumns({"_up": s.mean(C("gain"), 14), "_down": s.mean(C("loss"), 14)})
    return rows.withColumns(
        {
            "rsi": 100 * ratio(C("_up"), C("_up") + C("_down")),
            "sma_5": s.mean(C("close"), 5, partial=True),
            "sma_20": s.mean(C("close"), 20, partial=True),
            "volume_ratio": ratio(C("volume"), s.mean(C("volume"), 20, partial=True)),
            "rn": F.row_number().over(Window.partitionBy("symbol").orderBy(C("ts").desc())),
        }
    )


def summaries(series: DataFrame) -> DataFrame:
    """The state after the new bars, one row per symbol that has any."""

    def newest(name: str) -> Column:
        return F.max(F.when(C("rn") == 1, C(name)))

    bar = F.struct("ts", "close", "volume", "gain", "loss")
    return series.groupBy("symbol").agg(
        (newest("at") + 1).alias("n"), newest("ts").alias("last_ts"), *[newest(c).alias(c) for c in ("ema_12", "ema_26", "macd_signal")],
        F.array_sort(F.collect_list(F.when(C("rn") <= TAIL, bar))).alias("tail"),
    )


class IndicatorLog:
    """Indicator history and state of all symbols below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.history = KeyedLog(spark, f"{path}/history", HISTORY)
        self.state = KeyedLog(spark, f"{path}/state", STATE)

    def append(self, bars: DataFrame, cycle: int, limit: int = params.INDICATOR_HISTORY_LIMIT) -> None:
        """Adds the bars of a cycle; writes their rows and the state of their symbols only. A cycle can be repeated."""
        bars = bars.select("symbol", "ts", "close", "volume").persist()
        largest = bars.groupBy("symbol").count().agg(F.max("count")).first()[0] or 0
        series = append(self.state.newest(cycle, "symbol"), bars, largest).persist()
        self.history.write(series.where("is_new"), cycle)
        self.state.write(summaries(series), cycle)
        series.unpersist()
        bars.unpersist()
        if cycle % COMPACT_EVERY == COMPACT_EVERY - 1:
            self.history.compact(cycle, lambda rows: cap_history(rows, limit).drop("rn"))
            self.state.compact(cycle, newest_rows("symbol"))

    def read(self, cycles: int, limit: int = params.INDICATOR_HISTORY_LIMIT) -> DataFrame:
        """The newest ``limit`` rows of every symbol after so many cycles."""
        return cap_history(self.history.read(cycles).drop("version"), limit)
