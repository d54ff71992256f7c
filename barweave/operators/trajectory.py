"""Price and momentum trajectories, sectors and sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from barweave import params
from barweave.functions import series as s
from barweave.functions.scalar import clamp, ist, lit_or_col, ratio, session_vol_factor
from barweave.operators.bars import recent_bars
from barweave.operators.indicators import aggregate_symbols, indicator_series, with_position

C = F.col
HISTORY = 100
MOMENTUM_ROWS = 30


def fit_strength(y: Column, x: Column, n: Column, over=lambda aggregate: aggregate) -> Column:
    """R squared with the sign of the least-squares slope, 0 for a flat line or one point.

    A flat line has no explained variance; the regression aggregate would call it 1. ``over`` may
    put each aggregate over a window.
    """
    slope, r2 = over(F.regr_slope(y, x)), over(F.regr_r2(y, x))
    flat = F.coalesce(over(F.var_pop(y)), F.lit(0.0)) == 0
    return (
        F.when(n < 2, 0.0)
        .when(flat, 0.0)
        .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r2 * F.when(slope > 0, 1.0).otherwise(-1.0))))
    )


def price_aggregates(price: str = "close") -> dict[str, Column]:
    """Inputs of the price trajectory over the last 100 rows; needs ``rn``, ``i``, ``n_rows``."""
    rn, p = C("rn"), C(price)
    kept = F.least(C("n_rows"), F.lit(HISTORY))
    # position inside the kept rows, 0 for the oldest
    place = kept - rn
    out = {
        "n_prices": F.least(F.max("n_rows"), F.lit(HISTORY)),
        "price_now": F.max(F.when(rn == 1, p)),
        "price_before": F.max(F.when(rn == 2, p)),
        "price_first": F.max(F.when(place == 0, p)),
        "price_second": F.max(F.when(place == 1, p)),
        "gap_mean": F.avg(F.when(place.between(1, 9) & (C("prev_price") > 0), F.abs(p - C("prev_price")) / C("prev_price"))),
    }
    for name, back in (("short", 5), ("medium", 15), ("long", 30)):
        part = F.when(rn <= back, p)
        out[f"price_{name}_ago"] = F.max(F.when(rn == back, p))
        out[f"fit_{name}"] = fit_strength(part, C("i").cast("double"), F.count(part))
    return out


def rolling_windows(price: str = "close") -> dict[str, Column]:
    """``price_aggregates`` of each row's own frame of 100 rows or more; needs ``prev_price``, ``i``, ``n_rows``."""
    p, prev, long = C(price), C("prev_price"), C("n_rows") >= HISTORY
    gap = F.when(prev > 0, F.abs(p - prev) / prev)
    # the first rows of the kept ones; a frame that is not full begins at the first row of all
    oldest = s.by_time().rowsBetween(2 - HISTORY, 10 - HISTORY)
    begun = F.avg(F.when(C("i").between(1, 9), gap)).over(s.running())
    out = {
        "n_prices": F.least(C("n_rows"), F.lit(HISTORY)),
        "price_now": p,
        "price_before": s.lag(price),
        "price_first": F.nth_value(price, 1).over(s.last_rows(HISTORY)),
        "price_second": F.nth_value(price, 2).over(s.last_rows(HISTORY)),
        "gap_mean": F.when(long, F.avg(gap).over(oldest)).otherwise(begun),
    }
    for name, back in (("short", 5), ("medium", 15), ("long", 30)):
        rows = s.last_rows(back)
        out[f"price_{name}_ago"] = s.lag(price, back - 1)
        out[f"fit_{name}"] = fit_strength(p, C("i").cast("double"), F.count(p).over(rows), lambda a, rows=rows: a.over(rows))
    return out


def add_price_trajectory(f: DataFrame, as_of=None) -> DataFrame:
    """Changes, trend strengths, acceleration, gap risk and the overall label.

    ``as_of`` is the time whose session scales the short trend (column ``ts`` by
    default); nothing depends on the wall clock.
    """
    factor = session_vol_factor(C("ts") if as_of is None else lit_or_col(as_of).cast("timestamp"))
    n = C("n_prices")
    known = n >= 10

    def change(name: str, back: int) -> Column:
        return F.when(n >= back, ratio(C("price_now"), C(f"price_{name}_ago")) - 1).otherwise(0.0)

    f = f.withColumns(
        {
            "trajectory_status": F.when(known, "ok").otherwise("insufficient_data"),
            **{
                f"{k}_change_pct": F.when(known, change(k, b) * 100)
                for k, b in (("short", 5), ("medium", 15), ("long", 30))
            },
            "short_trend": F.when(known, C("fit_short") * factor),
            "medium_trend": F.when(known, C("fit_medium")),
            "long_trend": F.when(known, C("fit_long")),
            # the mean second difference telescopes to the outermost first differences
            "acceleration": F.when(
                known,
                ratio(
                    (C("price_now") - C("price_before")) - (C("price_second") - C("price_first")), n - 2
                ),
            ),
            "gap_risk_factor": F.when(
                known, 1.0 - F.least(F.lit(0.3), F.coalesce(C("gap_mean"), F.lit(0.0)) * 2)
            ),
        }
    )
    f = f.withColumns(
        {
            "trend_consistency": F.when(known, trend_consistency("short_trend", "medium_trend", "long_trend")),
            **{
                f"{k}_direction": F.when(C(f"{k}_change_pct") > 0, "UP").when(known, "DOWN")
                for k in ("short", "medium", "long")
            },
        }
    )
    return f.withColumn(
        "overall_trajectory",
        F.when(
            known, overall_trajectory(C("short_trend"), C("medium_trend"), C("long_trend"), C("trend_consistency"))
        ),
    )


def trend_consistency(*trends: str) -> Column:
    """Mean size of the agreeing trends when at least two of three agree, else 0.1."""
    values = F.array(*trends)

    def mean_of(keep) -> Column:
        kept = F.filter(values, keep)
        return F.aggregate(kept, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(kept), F.lit(0))

    rising = F.size(F.filter(values, lambda v: v > 0.2))
    falling = F.size(F.filter(values, lambda v: v < -0.2))
    return (
        F.when(rising >= 2, mean_of(lambda v: v > 0))
        .when(falling >= 2, F.abs(mean_of(lambda v: v < 0)))
        .otherwise(0.1)
    )


def overall_trajectory(short: Column, medium: Column, long: Column, consistency: Column) -> Column:
    avg = short * 0.5 + medium * 0.3 + long * 0.2
    return (
        F.when((consistency > 0.7) & (avg > 0.4), "STRONG_BULLISH")
        .when((consistency > 0.5) & (avg > 0.2), "BULLISH")
        .when((consistency > 0.7) & (avg < -0.4), "STRONG_BEARISH")
        .when((consistency > 0.5) & (avg < -0.2), "BEARISH")
        .otherwise("NEUTRAL")
    )


PRICE_TRAJECTORY = (
    "trajectory_status", "short_change_pct", "medium_change_pct", "long_change_pct",
    "short_trend", "medium_trend", "long_trend", "short_direction", "medium_direction", "long_direction",
    "acceleration", "trend_consistency", "gap_risk_factor", "overall_trajectory",
)


def price_trajectory(prices: DataFrame, price: str = "close", as_of=None) -> DataFrame:
    """Trajectory of each symbol's last 100 prices (bars or any snapshot table)."""
    rows = with_prices(recent_bars(prices, HISTORY), price)
    f = aggregate_symbols(rows, price_aggregates(price), {"ts": F.max("ts")})
    return add_price_trajectory(f, as_of).select("symbol", "n_prices", *PRICE_TRAJECTORY)


def with_prices(recent: DataFrame, price: str = "close") -> DataFrame:
    return recent.withColumns(
        {"n_rows": F.max("rn").over(s.whole()), "prev_price": s.lag(price)}
    ).withColumn("i", C("n_rows") - C("rn"))


# --- momentum ------------------------------------------------------------------------------

SERIES = {"rsi": "rsi", "macd": "macd", "sma5": "sma_5", "sma20": "sma_20", "volume": "volume_ratio"}


def momentum_series(indicators: DataFrame, n: int = MOMENTUM_ROWS) -> DataFrame:
    """Positions of the defined values among the last ``n`` rows, and the previous row."""
    recent = C("rn") <= n
    df = indicators.withColumns(
        {
            f"_{k}": F.when(recent, C(c)) for k, c in SERIES.items()
        }
        | {"_macd_gap": C("macd") - C("macd_signal"), "_sma_gap": C("sma_5") - C("sma_20")}
    )
    return df.withColumns({f"_{k}_x": F.count(f"_{k}").over(s.running()).cast("double") for k in SERIES})


def momentum_aggregates(n: int = MOMENTUM_ROWS) -> dict[str, Column]:
    rn = C("rn")
    out = {"n_momentum": F.least(F.max("n_rows"), F.lit(n))}
    for k in SERIES:
        out[f"{k}_n"] = F.count(f"_{k}")
        out[f"{k}_fit"] = fit_strength(C(f"_{k}"), F.when(C(f"_{k}").isNotNull(), C(f"_{k}_x")), F.count(f"_{k}"))
    out["rsi_last"] = F.max_by("_rsi", F.when(C("_rsi").isNotNull(), -rn))
    for k in ("macd", "sma"):
        out[f"{k}_gap"] = F.max(F.when(rn == 1, C(f"_{k}_gap")))
        out[f"{k}_gap_before"] = F.max(F.when(rn == 2, C(f"_{k}_gap")))
    return out


def _direction(fit: Column, n: Column) -> Column:
    return (
        F.when(n < 3, F.lit(None)).when(fit > 0.2, "INCREASING").when(fit < -0.2, "DECREASING").otherwise("SIDEWAYS")
    )


def add_indicator_trajectories(f: DataFrame) -> DataFrame:
    """Direction and strength of RSI and volume ratio, level of the RSI."""
    rsi, fit = C("rsi_last"), C("rsi_fit")
    low, high = params.RSI_OVERSOLD, params.RSI_OVERBOUGHT
    return f.withColumns(
        {
            "rsi_direction": _direction(fit, C("rsi_n")),
            "rsi_strength": F.when(C("rsi_n") >= 3, F.abs(fit)),
            "rsi_level": F.when(C("rsi_n") < 3, F.lit(None))
            .when(rsi < low, "OVERSOLD")
            .when(rsi > high, "OVERBOUGHT")
            .when(rsi.between(low, low + 10) & (fit > 0), "OVERSOLD_RECOVERY")
            .when(rsi.between(high - 10, high) & (fit < 0), "OVERBOUGHT_BREAKDOWN")
            .otherwise("NORMAL"),
            "volume_direction": _direction(C("volume_fit"), C("volume_n")),
            "volume_strength": F.when(C("volume_n") >= 3, F.abs("volume_fit")),
        }
    )


def add_macd_cross(f: DataFrame) -> DataFrame:
    now, before = C("macd_gap"), C("macd_gap_before")
    known = C("macd_n") >= 3
    return f.withColumns(
        {
            "macd_cross": F.when(~known, F.lit(None))
            .when((before <= 0) & (now > 0), "BULLISH_CROSSOVER_CONFIRMED")
            .when((before >= 0) & (now < 0), "BEARISH_CROSSOVER_CONFIRMED")
            .otherwise("NEUTRAL"),
            "macd_trend": F.when(known, C("macd_fit")),
            "macd_divergence": F.when(known, now),
        }
    )


def add_ma_cross(f: DataFrame) -> DataFrame:
    now, before = C("sma_gap"), C("sma_gap_before")
    known = (C("sma5_n") >= 3) & (C("sma20_n") >= 3)
    return f.withColumns(
        {
            "ma_signal": F.when(~known, F.lit(None))
            .when((before <= 0) & (now > 0), "GOLDEN_CROSS")
            .when((before >= 0) & (now < 0), "DEATH_CROSS")
            .when(now > 0, "BULLISH_ALIGNMENT")
            .otherwise("BEARISH_ALIGNMENT"),
            "sma_5_trend": F.when(known, C("sma5_fit")),
            "sma_20_trend": F.when(known, C("sma20_fit")),
            "ma_alignment": F.when(~known, F.lit(None)).when(now > 0, "BULLISH").otherwise("BEARISH"),
        }
    )


def add_momentum_composite(f: DataFrame) -> DataFrame:
    """Weighted momentum of the four trajectories; needs at least five rows."""
    f = add_ma_cross(add_macd_cross(add_indicator_trajectories(f)))
    known = C("n_momentum") >= 5

    def either(column: str, plus: str, minus: str, weight) -> Column:
        return F.when(C(column) == plus, weight).when(C(column) == minus, -1 * weight).otherwise(0.0)

    score = (
        either("rsi_level", "OVERSOLD_RECOVERY", "OVERBOUGHT_BREAKDOWN", F.lit(0.3))
        + either("rsi_direction", "INCREASING", "DECREASING", 0.1 * C("rsi_strength"))
        + either("macd_cross", "BULLISH_CROSSOVER_CONFIRMED", "BEARISH_CROSSOVER_CONFIRMED", F.lit(0.4))
        + F.when(C("ma_signal") == "GOLDEN_CROSS", 0.3)
        .when(C("ma_signal") == "DEATH_CROSS", -0.3)
        .when(C("ma_alignment") == "BULLISH", 0.1)
        .when(C("ma_alignment") == "BEARISH", -0.1)
        .otherwise(0.0)
        + F.when(C("volume_direction") == "INCREASING", 0.1 * C("volume_strength")).otherwise(0.0)
    )
    f = f.withColumn("composite_momentum", F.when(known, clamp(score)))
    m = C("composite_momentum")
    return f.withColumns(
        {
            "momentum_direction": F.when(~known, F.lit(None))
            .when(m > 0.3, "BULLISH")
            .when(m < -0.3, "BEARISH")
            .otherwise("NEUTRAL"),
            "momentum_abs": F.abs(m),
        }
    )


MOMENTUM = (
    "rsi_direction", "rsi_strength", "rsi_level", "macd_cross", "macd_trend", "macd_divergence",
    "ma_signal", "ma_alignment", "sma_5_trend", "sma_20_trend", "volume_direction", "volume_strength",
    "composite_momentum", "momentum_direction", "momentum_abs",
)


def momentum_trajectory(bars: DataFrame, lookback: int = params.LOOKBACK) -> DataFrame:
    rows = momentum_series(indicator_series(recent_bars(bars, lookback), lookback=lookback))
    return add_momentum_composite(aggregate_symbols(rows, momentum_aggregates())).select("symbol", *MOMENTUM)


def adx_regime(adx: Column) -> Column:
    return (
        F.when(adx > params.ADX_TRENDING, "TRENDING").when(adx < params.ADX_RANGING, "RANGING").otherwise("UNDEFINED")
    )


# --- sectors -------------------------------------------------------------------------------


def sector_of(name: Column, sectors: dict[str, list[str]] | None = None) -> Column:
    """First sector with a part contained in the name, ignoring case.

    The sector list is a fixed handful of literals, so it becomes one CASE
    expression instead of a theta join.
    """
    lowered = F.lower(name)
    chain = None
    for sector, parts in (params.SECTORS if sectors is None else sectors).items():
        hit = reduce(lambda a, b: a | b, [lowered.contains(p.lower()) for p in parts])
        chain = F.when(hit, sector) if chain is None else chain.when(hit, sector)
    return F.lit(params.OTHER_SECTOR) if chain is None else chain.otherwise(params.OTHER_SECTOR)


def sector_bias(sector: Column, as_of: Column, usd_inr_change=0.0) -> Column:
    """Currency and trading-hour tilt of a sector, 0 outside the list."""
    change = lit_or_col(usd_inr_change)
    impact = F.lit(0.0)
    for name, factor in params.CURRENCY_IMPACT.items():
        impact = F.when(sector == name, F.lit(factor)).otherwise(impact)
    hour = F.hour(ist(as_of))
    tilt = (
        F.when((sector == "IT") & hour.between(20, 23), 0.2)
        .when((sector == "BANKING") & hour.between(10, 15), 0.1)
        .otherwise(0.0)
    )
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), impact * change + tilt))
    return F.when(sector == params.OTHER_SECTOR, 0.0).otherwise(bounded)
