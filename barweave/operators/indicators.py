"""Technical indicators over the recent bars of each symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barweave import params
from barweave.functions import series as s
from barweave.functions.scalar import ratio
from barweave.functions.topn import latest_n
from barweave.operators.bars import recent_bars

C = F.col


def with_position(recent: DataFrame) -> DataFrame:
    """Zero-based row index ``i`` and row count ``n_rows`` of each symbol, and the previous row."""
    return recent.withColumns(
        {
            "n_rows": F.max("rn").over(s.whole()),
            "prev_close": s.lag("close"),
            "prev_high": s.lag("high"),
            "prev_low": s.lag("low"),
            "prev_volume": s.lag("volume"),
        }
    ).withColumns(
        {
            "i": C("n_rows") - C("rn"),
            "ret": ratio(C("close"), C("prev_close")) - 1,
        }
    )


def indicator_series(recent: DataFrame, method: str = "simple", lookback: int = params.LOOKBACK) -> DataFrame:
    """All indicator series for every recent bar, of which a symbol has at most ``lookback``.

    ``simple``: rolling means and first-value seeded EMAs, fully determined by the
    window. ``wilder``: the classic charting definitions (SMA-seeded EMA, Wilder
    smoothing for RSI / ATR / ADX, population deviation for the bands).
    """
    if method not in ("simple", "wilder"):
        raise ValueError(f"unknown method {method!r}")
    df = with_position(recent)
    delta = C("close") - C("prev_close")
    df = df.withColumns(
        {
            "gain": F.when(delta > 0, delta).otherwise(0.0),
            "loss": F.when(delta < 0, -delta).otherwise(0.0),
            "tr": F.greatest(
                C("high") - C("low"),
                F.abs(C("high") - C("prev_close")),
                F.abs(C("low") - C("prev_close")),
            ),
            "up_move": C("high") - C("prev_high"),
            "low_move": C("low") - C("prev_low"),
            "volume_roc": (ratio(C("volume"), C("prev_volume")) - 1) * 100,
            "typical": (C("high") + C("low") + C("close")) / 3,
            "signed_volume": F.when(C("i") == 0, C("volume"))
            .when(delta > 0, C("volume"))
            .when(delta < 0, -C("volume"))
            .otherwise(0),
        }
    )
    df = df.withColumns(
        {
            "obv": F.sum("signed_volume").over(s.running()),
            "vwap": F.try_divide(
                F.sum(C("typical") * C("volume")).over(s.running()), F.sum("volume").over(s.running())
            ),
        }
    )
    df = _simple(df, lookback) if method == "simple" else _wilder(df, lookback)
    return df.withColumns(
        {
            "macd_hist": C("macd") - C("macd_signal"),
            "volume_ratio": ratio(C("volume"), C("volume_sma_20")),
        }
    )


def _simple(df: DataFrame, lookback: int) -> DataFrame:
    rising = F.when(C("up_move") < 0, 0.0).otherwise(C("up_move"))
    falling = F.when(C("low_move") > 0, 0.0).otherwise(C("low_move"))
    close, volume = C("close"), C("volume")
    df = df.withColumns(
        {
            **{f"sma_{n}": s.mean(close, n, partial=True) for n in (5, 10, 20, 50)},
            "volume_sma_20": s.mean(volume, 20, partial=True),
            "band": s.deviation(close, 20) * 2,
            "avg_gain": s.mean(C("gain"), 14),
            "avg_loss": s.mean(C("loss"), 14),
            "atr": s.mean(C("tr"), 14),
        }
    )
    up, plus_dm = s.adjusted_ema("plus_dm", rising, 1 / 14)
    down, minus_dm = s.adjusted_ema("minus_dm", falling, 1 / 14)
    df = s.linear(df, {**{f"ema_{n}": s.ema(close, n) for n in (5, 10, 12, 20, 26)}, **up, **down}, lookback)
    df = df.withColumns({"macd": C("ema_12") - C("ema_26"), "plus_dm": plus_dm, "minus_dm": minus_dm})
    plus_di = 100 * ratio(C("plus_dm"), C("atr"))
    minus_di = F.abs(100 * ratio(C("minus_dm"), C("atr")))
    df = df.withColumns(
        {
            "rsi": 100 * ratio(C("avg_gain"), C("avg_gain") + C("avg_loss")),
            "bb_upper": C("sma_20") + C("band"),
            "bb_middle": C("sma_20"),
            "bb_lower": C("sma_20") - C("band"),
            "dx": ratio(F.abs(plus_di - minus_di), F.abs(plus_di + minus_di)) * 100,
        }
    )
    df = df.withColumn("smooth_dx", (s.lag("dx") * 13 + C("dx")) / 14)
    terms, adx = s.adjusted_ema("adx", C("smooth_dx"), 1 / 14)
    return s.linear(df, {"macd_signal": s.ema(C("macd"), 9), **terms}, lookback).withColumn("adx", adx)


def _wilder(df: DataFrame, lookback: int) -> DataFrame:
    close, volume, i = C("close"), C("volume"), C("i")
    down_move = -C("low_move")
    plus = F.when((C("up_move") > 0) & (C("up_move") > down_move), C("up_move")).otherwise(0.0)
    minus = F.when((down_move > 0) & (down_move > C("up_move")), down_move).otherwise(0.0)
    df = df.withColumns({"plus_raw": plus, "minus_raw": minus})

    def inner(n: int, seed: str) -> tuple[Column, float]:
        """EMA from row 25, where both MACD legs start."""
        return s.seeded_ema(close, 2.0 / (n + 1), 25, C(seed))

    def smoothed(x: Column, seed: str) -> tuple[Column, float]:
        return s.seeded_ema(x, 1 / 14, 14, C(seed))

    means = {
        **{f"sma_{n}": s.mean(close, n) for n in (5, 10, 20, 50)},
        **{f"_m{n}": F.avg(close).over(s.last_rows(n)) for n in (5, 10, 12, 20, 26)},
        "volume_sma_20": s.mean(volume, 20),
        "band": s.full(F.stddev_pop(close).over(s.last_rows(20)), close, 20) * 2,
        "_gain": F.avg("gain").over(s.last_rows(14)),
        "_loss": F.avg("loss").over(s.last_rows(14)),
        "_tr": F.avg("tr").over(s.last_rows(14)),
        # running Wilder sums start with the 13 rows after the first
        "_dm_seed_p": F.sum("plus_raw").over(s.last_rows(13)),
        "_dm_seed_m": F.sum("minus_raw").over(s.last_rows(13)),
        "_tr_seed": F.sum("tr").over(s.last_rows(13)),
    }
    df = df.withColumns(means)

    def wilder_sum(x: Column, seed: str) -> tuple[Column, float]:
        """S_t = S_(t-1) * 13/14 + x_t from row 13."""
        return F.when(i == 13, C(seed)).when(i > 13, x), 13 / 14

    terms = {
        **{f"ema_{n}": s.seeded_ema(close, 2.0 / (n + 1), n - 1, C(f"_m{n}")) for n in (5, 10, 20)},
        "_leg_12": inner(12, "_m12"),
        "_leg_26": inner(26, "_m26"),
        "avg_gain": smoothed(C("gain"), "_gain"),
        "avg_loss": smoothed(C("loss"), "_loss"),
        "atr": smoothed(C("tr"), "_tr"),
        "_p": wilder_sum(C("plus_raw"), "_dm_seed_p"),
        "_m": wilder_sum(C("minus_raw"), "_dm_seed_m"),
    }
    df = s.linear(df, terms, lookback)
    df = df.withColumns(
        {
            **{f"ema_{n}": s.from_row(f"ema_{n}", n - 1) for n in (5, 10, 20)},
            **{c: s.from_row(c, 14) for c in ("avg_gain", "avg_loss", "atr", "_p", "_m")},
            "macd_line": F.when(i >= 25, C("_leg_12") - C("_leg_26")),
        }
    )
    df = df.withColumns(
        {
            "rsi": 100 * ratio(C("avg_gain"), C("avg_gain") + C("avg_loss")),
            "bb_upper": C("sma_20") + C("band"),
            "bb_middle": C("sma_20"),
            "bb_lower": C("sma_20") - C("band"),
            "dx": F.when(i >= 14, F.coalesce(100 * ratio(F.abs(C("_p") - C("_m")), C("_p") + C("_m")), F.lit(0.0))),
        }
    )
    df = df.withColumns(
        {
            "_signal_seed": F.avg("macd_line").over(s.last_rows(9)),
            "_adx_seed": F.avg("dx").over(s.last_rows(14)),
        }
    )
    terms = {
        "macd_signal": s.seeded_ema(C("macd_line"), 0.2, 33, C("_signal_seed")),
        "adx": s.seeded_ema(C("dx"), 1 / 14, 27, C("_adx_seed")),
    }
    df = s.linear(df, terms, lookback)
    return df.withColumns({"macd_signal": s.from_row("macd_signal", 33), "adx": s.from_row("adx", 27), "macd": s.from_row("macd_line", 33)})


# levels of a lookback that is too short for percentiles
FIXED_LEVELS = {"rsi_oversold": 30.0, "rsi_overbought": 70.0, "volume_high": 1.5, "volume_low": 0.5}


def regime(adx: Column) -> Column:
    """Market regime label of an ADX value."""
    return (
        F.when(adx > params.ADX_TRENDING, "TRENDING")
        .when(adx < params.ADX_RANGING, "RANGING")
        .when(adx.isNotNull(), "WEAK")
        .otherwise("UNKNOWN")
    )


LATEST = (
    "ts", "open", "high", "low", "close", "volume",
    "sma_5", "sma_10", "sma_20", "sma_50", "ema_5", "ema_10", "ema_20",
    "rsi", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_middle", "bb_lower",
    "atr", "adx", "volume_sma_20", "volume_roc", "obv", "vwap", "volume_ratio",
)


def latest_of(*names: str) -> dict[str, Column]:
    """Aggregates picking the newest row's value of each series."""
    return {n: F.max(F.when(C("rn") == 1, C(n))) for n in names}


def moves() -> dict[str, Column]:
    """What a row adds to the sums of the newest values; needs the previous row of ``with_position``."""
    delta = C("close") - C("prev_close")
    up, low = C("high") - C("prev_high"), C("low") - C("prev_low")
    return {
        "gain": F.when(delta > 0, delta).otherwise(0.0),
        "loss": F.when(delta < 0, -delta).otherwise(0.0),
        "tr": F.greatest(
            C("high") - C("low"), F.abs(C("high") - C("prev_close")), F.abs(C("low") - C("prev_close"))
        ),
        "plus_raw": F.when(up < 0, 0.0).otherwise(up),
        "minus_raw": F.when(low > 0, 0.0).otherwise(low),
    }


def newest_series(positioned: DataFrame, lookback: int = params.LOOKBACK) -> DataFrame:
    """The few running series that the newest values need: MACD and smoothed DX.

    Everything else of the newest bar is an aggregate over its last rows (see
    ``newest_aggregates``), which spares the rolling frames of the full series.
    """
    delta = C("close") - C("prev_close")
    df = positioned.withColumns(
        {
            **moves(),
            "signed_volume": F.when(C("i") == 0, C("volume"))
            .when(delta > 0, C("volume"))
            .when(delta < 0, -C("volume"))
            .otherwise(0),
        }
    )
    # the common weight of both sides and the ATR cancel in DX; only a zero ATR voids it
    df = df.withColumn("_moved", F.max(F.when(C("tr") > 0, C("i"))).over(s.running()))
    terms = {f"_ema_{n}": s.ema(C("close"), n) for n in (12, 26)}
    df = s.linear(df, terms | {f"_{c}": (C(f"{c}_raw"), 1 - 1 / 14) for c in ("plus", "minus")}, lookback)
    df = df.withColumn("macd", C("_ema_12") - C("_ema_26"))
    live = (C("i") >= 13) & (C("_moved") > C("i") - 14)
    plus, minus = C("_plus"), F.abs("_minus")
    df = df.withColumn("dx", F.when(live, ratio(F.abs(plus - minus), plus + minus) * 100))
    return df.withColumn("smooth_dx", (s.lag("dx") * 13 + C("dx")) / 14)


def _ema_weight(n: int) -> Column:
    """Weight of a row in the newest value of a first-value seeded EMA."""
    a = 2.0 / (n + 1)
    return F.when(C("i") == 0, 1.0).otherwise(a) * F.pow(F.lit(1 - a), C("rn") - 1)


def newest_aggregates() -> dict[str, Column]:
    """Newest indicator values as aggregates, equal to the last row of ``indicator_series``."""
    rn = C("rn")

    def last(n: int, x: str) -> Column:
        return F.when(rn <= n, C(x))

    def enough(n: int, value: Column) -> Column:
        return F.when(F.max("n_rows") >= n, value)

    def newest(x: Column) -> Column:
        return F.max(F.when(rn == 1, x))

    gain, loss = F.avg(last(14, "gain")), F.avg(last(14, "loss"))
    middle, band = F.avg(last(20, "close")), enough(20, F.stddev_samp(last(20, "close"))) * 2
    macd, signal = newest(C("macd")), F.sum(C("macd") * _ema_weight(9))
    volume_mean = F.avg(last(20, "volume"))
    decay = F.pow(F.lit(1 - 1 / 14), rn - 1)
    return {
        **{n: newest(C(n)) for n in ("ts", "open", "high", "low", "close", "volume")},
        **{f"sma_{n}": F.avg(last(n, "close")) for n in (5, 10, 20, 50)},
        **{f"ema_{n}": F.sum(C("close") * _ema_weight(n)) for n in (5, 10, 20)},
        "rsi": enough(14, 100 * ratio(gain, gain + loss)),
        "macd": macd,
        "macd_signal": signal,
        "macd_hist": macd - signal,
        "bb_upper": middle + band,
        "bb_middle": middle,
        "bb_lower": middle - band,
        "atr": enough(14, F.avg(last(14, "tr"))),
        "adx": F.try_divide(
            F.sum(C("smooth_dx") * decay), F.sum(F.when(C("smooth_dx").isNotNull(), decay))
        ),
        "volume_sma_20": volume_mean,
        "volume_roc": newest((ratio(C("volume"), C("prev_volume")) - 1) * 100),
        "obv": F.sum("signed_volume"),
        "vwap": F.try_divide(
            F.sum((C("high") + C("low") + C("close")) / 3 * C("volume")), F.sum("volume")
        ),
        "volume_ratio": ratio(newest(C("volume")), volume_mean),
    }


def wilder_newest_series(positioned: DataFrame) -> DataFrame:
    """The running series that the newest classic values need: the MACD line and DX."""
    i, delta = C("i"), C("close") - C("prev_close")
    up, down = C("high") - C("prev_high"), C("prev_low") - C("low")
    df = positioned.withColumns(
        {
            "gain": F.when(delta > 0, delta).otherwise(0.0),
            "loss": F.when(delta < 0, -delta).otherwise(0.0),
            "tr": F.greatest(
                C("high") - C("low"), F.abs(C("high") - C("prev_close")), F.abs(C("low") - C("prev_close"))
            ),
            "plus_raw": F.when((up > 0) & (up > down), up).otherwise(0.0),
            "minus_raw": F.when((down > 0) & (down > up), down).otherwise(0.0),
            "signed_volume": F.when(i == 0, C("volume"))
            .when(delta > 0, C("volume"))
            .when(delta < 0, -C("volume"))
            .otherwise(0),
            **{f"_m{n}": F.avg(F.when(i.between(26 - n, 25), C("close"))).over(s.whole()) for n in (12, 26)},
        }
    )
    df = df.withColumns({f"_{c}_seed": F.sum(F.when(i.between(1, 13), C(f"{c}_raw"))).over(s.whole()) for c in ("plus", "minus")})
    terms = {f"_leg_{n}": s.seeded_ema(C("close"), 2.0 / (n + 1), 25, C(f"_m{n}")) for n in (12, 26)}
    terms |= {f"_{c}": (F.when(i == 13, C(f"_{c}_seed")).when(i > 13, C(f"{c}_raw")), 13 / 14) for c in ("plus", "minus")}
    df = s.linear(df, terms, params.LOOKBACK)
    apart, both = F.abs(C("_plus") - C("_minus")), C("_plus") + C("_minus")
    return df.withColumns(
        {
            "macd_line": F.when(i >= 25, C("_leg_12") - C("_leg_26")),
            "dx": F.when(i >= 14, F.coalesce(100 * ratio(apart, both), F.lit(0.0))),
        }
    )


def wilder_newest_aggregates() -> dict[str, Column]:
    """Newest classic values, equal to the last row of ``indicator_series``.

    A recursion's newest value is one weighted sum: its seed and every later row, each
    by the decay from there to the newest row, which cannot overflow.
    """
    rn, i, n_rows = C("rn"), C("i"), F.max("n_rows")

    def last(n: int, x: str) -> Column:
        return F.when(rn <= n, C(x))

    def enough(n: int, value: Column) -> Column:
        return F.when(n_rows >= n, value)

    def newest(x: Column) -> Column:
        return F.max(F.when(rn == 1, x))

    def recursion(x: str, alpha: float, start: int, n: int) -> Column:
        """Newest value of a recursion that starts at row ``start`` with the mean of the last ``n`` rows."""
        seed = F.avg(F.when(i.between(start - n + 1, start), C(x)))
        later = F.sum(F.when(i > start, alpha * C(x) * F.pow(F.lit(1 - alpha), rn - 1)))
        return enough(start + 1, F.coalesce(later, F.lit(0.0)) + seed * F.pow(F.lit(1 - alpha), n_rows - 1 - start))

    middle = enough(20, F.avg(last(20, "close")))
    band = enough(20, F.stddev_pop(last(20, "close"))) * 2
    gain, loss = recursion("gain", 1 / 14, 14, 14), recursion("loss", 1 / 14, 14, 14)
    macd, signal = enough(34, newest(C("macd_line"))), recursion("macd_line", 0.2, 33, 9)
    volume_mean = enough(20, F.avg(last(20, "volume")))
    return {
        **{n: newest(C(n)) for n in ("ts", "open", "high", "low", "close", "volume")},
        **{f"sma_{n}": enough(n, F.avg(last(n, "close"))) for n in (5, 10, 20, 50)},
        **{f"ema_{n}": recursion("close", 2.0 / (n + 1), n - 1, n) for n in (5, 10, 20)},
        "rsi": 100 * ratio(gain, gain + loss),
        "macd": macd,
        "macd_signal": signal,
        "macd_hist": macd - signal,
        "bb_upper": middle + band,
        "bb_middle": middle,
        "bb_lower": middle - band,
        "atr": recursion("tr", 1 / 14, 14, 14),
        "adx": recursion("dx", 1 / 14, 27, 14),
        "volume_sma_20": volume_mean,
        "volume_roc": newest((ratio(C("volume"), C("prev_volume")) - 1) * 100),
        "obv": F.sum("signed_volume"),
        "vwap": F.try_divide(
            F.sum((C("high") + C("low") + C("close")) / 3 * C("volume")), F.sum("volume")
        ),
        "volume_ratio": ratio(newest(C("volume")), volume_mean),
    }


def swing_aggregates(window: int = 10) -> dict[str, Column]:
    """Extremes of the centred window read ``window`` rows before the end: rows -14..-5."""
    newest, oldest = window - window // 2 + 1, window + window // 2
    inside = C("rn").between(newest, oldest)
    enough = F.max("n_rows") >= oldest
    return {
        "swing_high": F.when(enough, F.max(F.when(inside, C("high")))),
        "swing_low": F.when(enough, F.min(F.when(inside, C("low")))),
    }


def adaptive_aggregates(periods: int = params.ADAPTIVE_PERIODS) -> dict[str, Column]:
    """10th / 90th percentile levels, fixed levels when the history is too short."""

    def level(x: str, p: float, fallback: float) -> Column:
        enough = (F.max("n_rows") >= periods) & (F.count(x) >= periods * 0.8)
        return F.when(enough, F.percentile(x, F.lit(p))).otherwise(fallback)

    return {
        "rsi_oversold": level("rsi", 0.1, 30.0),
        "rsi_overbought": level("rsi", 0.9, 70.0),
        "volume_high": level("volume_ratio", 0.9, 1.5),
        "volume_low": level("volume_ratio", 0.1, 0.5),
    }


def aggregate_symbols(series: DataFrame, *families: dict[str, Column]) -> DataFrame:
    """One row per symbol; the series is already partitioned by symbol, so nothing moves."""
    merged: dict[str, Column] = {}
    for family in families:
        merged.update(family)
    return series.groupBy("symbol").agg(*[c.alias(n) for n, c in merged.items()])


def indicators_latest(
    bars: DataFrame, method: str = "simple", lookback: int = params.LOOKBACK
) -> DataFrame:
    """Indicator record of each symbol's newest bar, flat."""
    series, families = latest_inputs(recent_bars(bars, lookback), method, lookback)
    out = aggregate_symbols(series, {"n_rows": F.max("n_rows")}, *families)
    return out.withColumn("market_regime", regime(C("adx")))


def latest_inputs(
    recent: DataFrame, method: str, lookback: int, with_series: bool = False
) -> tuple[DataFrame, list[dict[str, Column]]]:
    """Series and aggregate families of the newest indicators.

    Full series are computed only where something reads them: the adaptive levels of a
    long lookback, or the caller.
    """
    adaptive = lookback >= params.ADAPTIVE_PERIODS
    if not adaptive and not with_series:
        levels = {k: F.lit(v) for k, v in FIXED_LEVELS.items()}
        positioned = with_position(recent)
        if method == "simple":
            return newest_series(positioned), [newest_aggregates(), swing_aggregates(), levels]
        return wilder_newest_series(positioned), [wilder_newest_aggregates(), swing_aggregates(), levels]
    return indicator_series(recent, method, lookback), [latest_of(*LATEST), swing_aggregates(), adaptive_aggregates()]


def rolling_position(bars: DataFrame, lookback: int) -> DataFrame:
    """``with_position`` of the last ``lookback`` rows up to each row; ``i`` counts from the first row given."""
    previous = {f"prev_{c}": s.lag(c) for c in ("close", "high", "low")}
    df = bars.withColumns({"i": F.row_number().over(s.by_time()) - 1, **previous})
    return df.withColumns({"n_rows": F.least(C("i") + 1, F.lit(lookback)), "ret": ratio(C("close"), C("prev_close")) - 1})


def rolling_series(positioned: DataFrame, lookback: int) -> DataFrame:
    """Series of frames that begin with the first row given, which holds for the first ``lookback`` rows only."""
    terms, adx = s.adjusted_ema("adx", C("smooth_dx"), 1 / 14)
    df = s.linear(newest_series(positioned, lookback), {"_signal": s.ema(C("macd"), 9), **terms}, lookback)
    # the test of 14 rows for a move that voids DX, and what it is where the frame before them ends
    moved = {f"_moved_{n}": F.max(C("tr") > 0).over(s.last_rows(n)) for n in (13, 14)}
    return df.withColumns({"_adx": adx, **moved})


def rolling_windows(lookback: int) -> dict[str, Column]:
    """Window inputs of ``add_rolling_newest``; needs ``rolling_series``."""
    row = F.struct(
        F.coalesce("close", F.lit(0.0)).alias("close"), F.coalesce("plus_raw", F.lit(0.0)).alias("plus"),
        F.coalesce(-C("minus_raw"), F.lit(0.0)).alias("minus"), F.when(C("_moved_14"), 100.0).alias("scale"),
        F.coalesce("_moved_13", F.lit(False)).alias("moved"), F.coalesce(C("high") > C("low"), F.lit(False)).alias("wide"),
    )
    swing = s.by_time().rowsBetween(-14, -5)
    return {
        **{f"sma_{n}": F.avg("close").over(s.last_rows(n)) for n in (5, 10, 20, 50)},
        **{f"_{c}_14": F.avg(c).over(s.last_rows(14)) for c in ("gain", "loss", "tr")},
        "_sd_close_20": F.stddev_samp("close").over(s.last_rows(20)),
        "volume_sma_20": F.avg("volume").over(s.last_rows(20)),
        "_swing_high": F.max("high").over(swing),
        "_swing_low": F.min("low").over(swing),
        # full frames that begin later than the first row
        "_frame": F.when(C("i") >= lookback, F.collect_list(row).over(s.last_rows(lookback))),
    }


_EMA_12, _EMA_26, _DECAY = 2 / 13, 2 / 27, 1 - 1 / 14


def _dx(v: Column) -> Column:
    return ratio(F.abs(v["plus"] - v["minus"]), v["plus"] + v["minus"])


def _recursions(frame: Column, lookback: int) -> Column:
    """Values after the last row of a full frame, by the rules of ``newest_series``; a frame has more than 14 rows.

    A step finishes what the row before it left (signal line and DX), so each value is computed once a step.
    """
    first = F.get(frame, F.lit(0))

    def sums(v: Column, x: Column) -> dict[str, Column]:
        return {
            "ema_12": v["ema_12"] * (1 - _EMA_12) + x["close"] * _EMA_12, "ema_26": v["ema_26"] * (1 - _EMA_26) + x["close"] * _EMA_26,
            "signal": v["signal"] * 0.8 + (v["ema_12"] - v["ema_26"]) * 0.2, "plus": v["plus"] * _DECAY + x["plus"], "minus": v["minus"] * _DECAY + x["minus"],
        }

    def packed(values: dict[str, Column]) -> Column:
        return F.struct(*[c.alias(n) for n, c in values.items()])

    def step(v: Column, x: Column) -> Column:
        smooth = (v["dx_before"] * 13 + v["dx"]) / 14
        return packed(
            sums(v, x) | {
                "dx_before": v["dx"], "dx": _dx(v) * v["scale"], "scale": x["scale"], "adx": v["adx"] * _DECAY + F.coalesce(smooth, F.lit(0.0)),
                "weight": v["weight"] * _DECAY + F.nvl2(v["dx_before"] + v["dx"], F.lit(1.0), F.lit(0.0)),
            }
        )

    zero, none = F.lit(0.0), F.lit(None).cast("double")
    begun = packed({"ema_12": first["close"], "ema_26": first["close"], "signal": zero, "plus": zero, "minus": zero})
    # DX exists from row 13 on, which the frame's first row is 13 rows before: of that only its own range counts
    early = F.aggregate(F.slice(frame, 2, 13), begun, lambda v, x: packed(sums(v, x)))
    scale = F.when(first["wide"] | F.get(frame, F.lit(13))["moved"], 100.0)
    known = {n: early[n] for n in ("ema_12", "ema_26", "signal", "plus", "minus")}
    known |= {"dx_before": none, "dx": none, "scale": scale, "adx": zero, "weight": zero}
    return F.aggregate(F.slice(frame, 15, lookback - 14), packed(known), step)


def add_rolling_newest(df: DataFrame, lookback: int) -> DataFrame:
    """``newest_aggregates`` and ``swing_aggregates`` of each row's own frame, but for what no signal reads."""

    def enough(n: int, value: Column) -> Column:
        return F.when(C("n_rows") >= n, value)

    run, full = C("_run"), C("i") >= lookback
    df = df.withColumns({k: F.lit(v) for k, v in FIXED_LEVELS.items()})
    df = df.withColumn("_run", F.when(full, _recursions(C("_frame"), lookback))).withColumn("_last_dx", _dx(run) * run["scale"])
    # what the last step left to the rows after it: two values of the smoothed DX, one of the signal line
    smooth = [(run["dx_before"] * 13 + run["dx"]) / 14, (run["dx"] * 13 + C("_last_dx")) / 14]

    def finished(name: str, add) -> Column:
        return (run[name] * _DECAY + add(smooth[0])) * _DECAY + add(smooth[1])

    adx = finished("adx", lambda v: F.coalesce(v, F.lit(0.0)))
    weight = finished("weight", lambda v: F.when(v.isNull(), 0.0).otherwise(1.0))
    macd = run["ema_12"] - run["ema_26"]
    band, middle = enough(20, C("_sd_close_20")) * 2, C("sma_20")
    return df.withColumns(
        {
            "rsi": enough(14, 100 * ratio(C("_gain_14"), C("_gain_14") + C("_loss_14"))),
            "macd": F.when(full, macd).otherwise(C("macd")),
            "macd_signal": F.when(full, run["signal"] * 0.8 + macd * 0.2).otherwise(C("_signal")),
            "bb_upper": middle + band,
            "bb_middle": middle,
            "bb_lower": middle - band,
            "atr": enough(14, C("_tr_14")),
            "adx": F.when(full, F.try_divide(adx, weight)).otherwise(C("_adx")),
            "volume_ratio": ratio(C("volume"), C("volume_sma_20")),
            "swing_high": enough(15, C("_swing_high")),
            "swing_low": enough(15, C("_swing_low")),
        }
    ).drop("_run", "_frame")


def indicator_record(latest: DataFrame) -> DataFrame:
    """The nested form of ``indicators_latest``."""

    def pack(*names):
        return F.struct(*names)

    return latest.select(
        "symbol",
        C("ts").alias("timestamp"),
        C("close").alias("current_price"),
        pack("open", "high", "low", "close", "volume").alias("ohlcv"),
        pack("sma_5", "sma_10", "sma_20", "sma_50").alias("sma"),
        pack("ema_5", "ema_10", "ema_20").alias("ema"),
        "rsi",
        F.struct("macd", C("macd_signal").alias("signal"), C("macd_hist").alias("histogram")).alias("macd"),
        F.struct(
            C("bb_upper").alias("upper"), C("bb_middle").alias("middle"), C("bb_lower").alias("lower")
        ).alias("bollinger"),
        "atr",
        "adx",
        pack("swing_high", "swing_low").alias("swing_points"),
        F.struct(
            C("volume").alias("current_volume"), "volume_sma_20", "volume_roc", "obv", "vwap", "volume_ratio"
        ).alias("volume"),
        "market_regime",
    )


def swing_points(bars: DataFrame, lookback: int = params.LOOKBACK) -> DataFrame:
    series = with_position(recent_bars(bars, lookback))
    return aggregate_symbols(series, swing_aggregates())


def adaptive_levels(bars: DataFrame, periods: int = params.ADAPTIVE_PERIODS) -> DataFrame:
    series = indicator_series(recent_bars(bars, periods), lookback=periods)
    return aggregate_symbols(series, adaptive_aggregates(periods))


def market_regime(bars: DataFrame, lookback: int = params.LOOKBACK) -> DataFrame:
    series = newest_series(with_position(recent_bars(bars, lookback)), lookback)
    adx = {"adx": newest_aggregates()["adx"]}
    return aggregate_symbols(series, adx).withColumn("market_regime", regime(C("adx")))


def indicator_history(
    bars: DataFrame, n: int = params.INDICATOR_HISTORY_LIMIT, lookback: int = params.LOOKBACK
) -> DataFrame:
    """Last ``n`` rows of the series that trajectories are fitted on."""
    series = indicator_series(recent_bars(bars, lookback), lookback=lookback)
    return series.where(C("rn") <= n).select(
        "symbol", "ts", "rn", "rsi", "macd", "macd_signal", "sma_5", "sma_20", "volume_ratio"
    )


def cap_history(history: DataFrame, n: int = params.INDICATOR_HISTORY_LIMIT) -> DataFrame:
    """Newest ``n`` rows per symbol of an appended indicator history table."""
    return latest_n(history.drop("rn"), ["symbol"], [C("ts").desc()], n, splits=params.HOT_KEY_SPLITS)
