"""Statistical scores of each symbol's recent bars.

Everything a score needs is collected by one aggregation per symbol
(``quant_features``); the scores themselves are projections. An operator that uses
only a part of the features leaves the rest to column pruning.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from barweave import params
from barweave.functions import series as s
from barweave.functions.scalar import normal_cdf, ratio
from barweave.operators.bars import recent_bars
from barweave.operators.indicators import aggregate_symbols, with_position

C = F.col
ANNUAL = float(params.TRADING_DAYS) ** 0.5


def total(columns: list[Column]) -> Column:
    return reduce(add, columns)


def percentile_rank(below: Column, at_most: Column, n: Column) -> Column:
    """Average of the strict and the weak rank, as a share of ``n``."""
    return ratio(below + at_most + F.when(at_most > below, 1).otherwise(0), 2 * n)


def quant_series(positioned: DataFrame, inside: Column | None = None) -> DataFrame:
    """Rolling inputs of the scores; expects ``with_position`` columns. ``inside`` says where pivots are looked for."""
    high, low = C("high"), C("low")
    df = positioned
    if "tr" not in df.columns:
        df = df.withColumn(
            "tr",
            F.greatest(high - low, F.abs(high - C("prev_close")), F.abs(low - C("prev_close"))),
        )
    beyond_high = [s.lag("high", 2), s.lead("high"), s.lead("high", 2)]
    beyond_low = [s.lag("low", 2), s.lead("low"), s.lead("low", 2)]
    # both neighbours on either side must lie inside the last 50 rows
    inside = C("rn").between(3, 48) if inside is None else inside
    df = df.withColumns(
        {
            # prices have no gaps and returns miss the first row only, so the row index
            # tells whether a frame is full
            **{
                f"_mean_{p}": F.when(C("i") >= p - 1, F.avg("close").over(s.last_rows(p)))
                for p in params.REVERSION_PERIODS
            },
            **{
                f"_sd_{p}": F.when(C("i") >= p - 1, F.stddev_samp("close").over(s.last_rows(p)))
                for p in params.REVERSION_PERIODS
            },
            "_vol": F.when(C("i") >= 20, F.stddev_samp("ret").over(s.last_rows(20))) * ANNUAL,
            "_market": F.when(C("i") >= 20, F.avg("ret").over(s.last_rows(20))),
            "_peak": F.max(F.when(C("i") >= 1, C("close"))).over(s.running()),
            "_sq_prev": s.lag("ret"),
            "_peak_high": F.when(
                inside & (high > C("prev_high")) & (high > F.greatest(*beyond_high)), high
            ),
            "_dip_low": F.when(inside & (low < C("prev_low")) & (low < F.least(*beyond_low)), low),
        }
    )
    df = df.withColumns(
        {f"_z_{p}": ratio(C("close") - C(f"_mean_{p}"), C(f"_sd_{p}")) for p in params.REVERSION_PERIODS}
    )
    return df.withColumns(
        {
            **{f"_z_{p}_last": F.last(f"_z_{p}").over(s.whole()) for p in params.REVERSION_PERIODS},
            "_vol_last": F.last("_vol").over(s.whole()),
        }
    )


def quant_aggregates() -> dict[str, Column]:
    rn, close, ret = C("rn"), C("close"), C("ret")

    def at(n: int, x: Column) -> Column:
        return F.max(F.when(rn == n, x))

    def newest(n: int, x: Column) -> Column:
        return F.when(rn <= n, x)

    out = {
        "n_rows": F.max("n_rows"),
        "close": at(1, close),
        "last_volume": at(1, C("volume")),
        "last_ret": at(1, ret),
    }
    for tf in params.MOMENTUM_SPANS:
        out[f"close_{tf}_ago"] = at(tf + 1, close)
        out[f"ret_sd_{tf}"] = F.stddev_samp(newest(tf, ret))
    for p in params.REVERSION_PERIODS:
        z, last = C(f"_z_{p}"), C(f"_z_{p}_last")
        out[f"z_{p}"] = at(1, z)
        out[f"z_{p}_n"] = F.count(z)
        out[f"z_{p}_below"] = F.count_if(z < last)
        out[f"z_{p}_at_most"] = F.count_if(z <= last)
    out["current_vol"] = F.stddev_samp(newest(20, ret)) * ANNUAL
    out["vol_n"] = F.count("_vol")
    out["vol_below"] = F.count_if(C("_vol") < C("_vol_last"))
    out["vol_at_most"] = F.count_if(C("_vol") <= C("_vol_last"))
    out["vol_clustering"] = F.corr(newest(9, ret * ret), newest(9, C("_sq_prev") * C("_sq_prev")))
    # at most 46 pivots of either kind can lie inside the last 50 rows
    out["pivot_highs"] = F.collect_list(C("_peak_high"))
    out["pivot_lows"] = F.collect_list(C("_dip_low"))
    out["range_high"] = F.max(newest(50, C("high")))
    out["range_low"] = F.min(newest(50, C("low")))
    out["all_high"], out["all_low"] = F.max("high"), F.min("low")
    for p in params.VOLUME_PERIODS:
        out[f"volume_mean_{p}"] = F.avg(newest(p, C("volume")))
    out["ret_var_30"] = F.percentile(newest(30, ret), F.lit(0.05))
    out["ret_sd_20"] = F.stddev_samp(newest(20, ret))
    out["atr_14"] = F.when(F.max("n_rows") >= 14, F.avg(newest(14, C("tr"))))
    out["low_p20"] = F.percentile(newest(20, C("low")), F.lit(0.2))
    out["ret_mean"] = F.avg(ret)
    out["ret_sd"] = F.stddev_samp(ret)
    out["max_drawdown"] = F.min(F.when(C("i") >= 1, ratio(close, C("_peak")) - 1))
    out["ret_var"] = F.percentile(ret, F.lit(0.05))
    out["loss_sd"] = F.stddev_samp(F.when(ret < 0, ret))
    out["loss_n"] = F.count_if(ret < 0)
    out["market_n"] = F.count("_market")
    out["market_cov"] = F.covar_samp("ret", "_market")
    out["market_var"] = F.var_pop("_market")
    out["market_mean"] = F.avg("_market")
    return out


def rolling_windows(lookback: int) -> dict[str, Column]:
    """Window inputs of ``add_rolling_inputs``; needs ``quant_series`` with pivots everywhere."""

    def newest(n: int, x: Column) -> Column:
        return x.over(s.last_rows(n))

    def since(first: int, x: str) -> Column:
        """Values of the rows from ``first`` on in a frame; those of earlier rows would need rows before the frame."""
        return F.collect_list(x).over(s.last_rows(lookback - first))

    # pivots with both neighbours inside the last 50 rows
    pivots = s.by_time().rowsBetween(-47, -2)
    return {
        **{f"close_{tf}_ago": s.lag("close", tf) for tf in params.MOMENTUM_SPANS},
        **{f"ret_sd_{tf}": newest(tf, F.stddev_samp("ret")) for tf in params.MOMENTUM_SPANS},
        **{f"_z_{p}_values": since(p - 1, f"_z_{p}") for p in params.REVERSION_PERIODS},
        "_vol_values": since(20, "_vol"),
        "pivot_highs": F.collect_list("_peak_high").over(pivots),
        "pivot_lows": F.collect_list("_dip_low").over(pivots),
        "range_high": newest(50, F.max("high")),
        "range_low": newest(50, F.min("low")),
        "all_high": newest(lookback, F.max("high")),
        "all_low": newest(lookback, F.min("low")),
        **{f"volume_mean_{p}": newest(p, F.avg("volume")) for p in params.VOLUME_PERIODS},
        "ret_var_30": newest(30, F.percentile("ret", F.lit(0.05))),
        "ret_sd_20": newest(20, F.stddev_samp("ret")),
        "_tr_mean": newest(14, F.avg("tr")),
        "low_p20": newest(20, F.percentile("low", F.lit(0.2))),
    }


def add_rolling_inputs(df: DataFrame) -> DataFrame:
    """``quant_aggregates`` of each row's own frame, but for the inputs of ``add_risk_metrics``."""
    out = {"last_volume": C("volume"), "last_ret": C("ret"), "current_vol": C("ret_sd_20") * ANNUAL}
    out["atr_14"] = F.when(C("n_rows") >= 14, C("_tr_mean"))

    def ranked(name: str, x: str) -> dict[str, Column]:
        values, last = C(f"{x}_values"), C(x)
        below, at_most = F.filter(values, lambda v: v < last), F.filter(values, lambda v: v <= last)
        return {f"{name}_n": F.size(values), f"{name}_below": F.size(below), f"{name}_at_most": F.size(at_most)}

    for p in params.REVERSION_PERIODS:
        out |= {f"z_{p}": C(f"_z_{p}"), **ranked(f"z_{p}", f"_z_{p}")}
    return df.withColumns(out | ranked("vol", "_vol"))


def quant_features(bars: DataFrame, lookback: int = params.LOOKBACK) -> DataFrame:
    series = quant_series(with_position(recent_bars(bars, lookback)))
    return aggregate_symbols(series, quant_aggregates())


# --- projections over the features --------------------------------------------------------


def add_momentum(f: DataFrame) -> DataFrame:
    enough = C("n_rows") >= max(params.MOMENTUM_SPANS) + 5
    spans = params.MOMENTUM_SPANS
    f = f.withColumns({f"mom_ret_{tf}": ratio(C("close"), C(f"close_{tf}_ago")) - 1 for tf in spans})
    f = f.withColumns(
        {f"mom_t_{tf}": ratio(C(f"mom_ret_{tf}"), C(f"ret_sd_{tf}")) * float(tf) ** 0.5 for tf in spans}
    )
    f = f.withColumns({f"mom_p_{tf}": 2 * (1 - normal_cdf(F.abs(C(f"mom_t_{tf}")))) for tf in spans})
    parts = []
    for tf in spans:
        weight = 1.0 / tf * F.greatest(F.lit(0.0), 1 - C(f"mom_p_{tf}"))
        used = enough & (C(f"ret_sd_{tf}") > 0)
        parts.append(
            (
                tf,
                F.when(used, C(f"mom_ret_{tf}") * weight).otherwise(0.0),
                F.when(used, weight).otherwise(0.0),
                F.when(used, C(f"mom_p_{tf}")),
            )
        )
    score = F.coalesce(ratio(total([p[1] for p in parts]), total([p[2] for p in parts])), F.lit(0.0))
    n_used = total([F.when(p[3].isNotNull(), 1).otherwise(0) for p in parts])
    analysis = F.array_compact(
        F.array(
            *[
                F.when(
                    p[3].isNotNull(),
                    F.struct(
                        F.lit(p[0]).alias("timeframe"),
                        C(f"mom_ret_{p[0]}").alias("return"),
                        C(f"mom_t_{p[0]}").alias("t_stat"),
                        C(f"mom_p_{p[0]}").alias("p_value"),
                        p[1].alias("weighted_score"),
                    ),
                )
                for p in parts
            ]
        )
    )
    return f.withColumns(
        {
            "momentum_score": score,
            "timeframe_analysis": analysis,
            "statistical_significance": ratio(total([F.coalesce(p[3], F.lit(0.0)) for p in parts]), n_used),
        }
    ).withColumn(
        "momentum_strength",
        F.when(F.abs("momentum_score") > 0.03, "STRONG")
        .when(F.abs("momentum_score") > 0.015, "MODERATE")
        .otherwise("WEAK"),
    )


def add_mean_reversion(f: DataFrame) -> DataFrame:
    enough = C("n_rows") >= max(params.REVERSION_PERIODS) * 2
    weights, probs, directions = [], [], []
    f = f.withColumns(
        {
            f"z_pct_{p}": percentile_rank(C(f"z_{p}_below"), C(f"z_{p}_at_most"), C(f"z_{p}_n"))
            for p in params.REVERSION_PERIODS
        }
    )
    for p in params.REVERSION_PERIODS:
        pct = C(f"z_pct_{p}")
        used = enough & (C("n_rows") > 2 * p) & C(f"z_{p}").isNotNull() & (C(f"z_{p}_n") > 20)
        prob = F.when(pct > 0.8, (pct - 0.8) / 0.2).when(pct < 0.2, (0.2 - pct) / 0.2).otherwise(0.0)
        side = F.when(pct > 0.8, -1.0).when(pct < 0.2, 1.0).otherwise(0.0)
        weights.append(F.when(used, 1.0 / p).otherwise(0.0))
        probs.append(F.when(used, prob / p).otherwise(0.0))
        directions.append(F.when(used, side / p).otherwise(0.0))
    f = f.withColumns(
        {
            "reversion_prob": F.coalesce(ratio(total(probs), total(weights)), F.lit(0.5)),
            "expected_direction": ratio(total(directions), total(weights)),
        }
    )
    return f.withColumn(
        "current_extreme", C("expected_direction").isNotNull() & (C("reversion_prob") > 0.3)
    )


def add_volatility(f: DataFrame, lookback: int = 30) -> DataFrame:
    enough = C("n_rows") >= 2 * lookback
    ranked = enough & (C("vol_n") >= 10)
    daily = C("current_vol") / ANNUAL
    forecast = F.sqrt((0.1 * C("last_ret") * C("last_ret") + 0.9 * daily * daily) * params.TRADING_DAYS)
    f = f.withColumn(
        "vol_percentile",
        F.when(ranked, percentile_rank(C("vol_below"), C("vol_at_most"), C("vol_n"))),
    )
    pct = C("vol_percentile")
    return f.withColumns(
        {
            "vol_regime": F.when(pct > 0.8, "HIGH_VOL").when(pct < 0.2, "LOW_VOL").otherwise("NORMAL"),
            "vol_score": F.when(pct > 0.8, pct).when(pct < 0.2, 1 - pct).otherwise(0.5),
            "vol_forecast": F.when(ranked, forecast).when(enough, C("current_vol")).otherwise(0.02),
        }
    )


def add_support_resistance(f: DataFrame, window: int = 50) -> DataFrame:
    enough = C("n_rows") >= window
    close = C("close")
    above = F.array_min(F.filter("pivot_highs", lambda v: v > C("close")))
    below = F.array_max(F.filter("pivot_lows", lambda v: v < C("close")))
    f = f.withColumns(
        {
            "resistance": F.when(enough, F.coalesce(above, C("range_high"))).otherwise(C("all_high")),
            "support": F.when(enough, F.coalesce(below, C("range_low"))).otherwise(C("all_low")),
        }
    )

    def touches(levels: str, level: str) -> Column:
        near = F.filter(levels, lambda v: F.abs(v - C(level)) / C("close") < 0.02)
        return F.when(enough, F.size(near)).otherwise(0)

    span = C("resistance") - C("support")
    return f.withColumns(
        {
            "resistance_strength": touches("pivot_highs", "resistance"),
            "support_strength": touches("pivot_lows", "support"),
            "range_position": F.when(enough, F.coalesce(ratio(close - C("support"), span), F.lit(0.5))),
            "range_width_pct": F.when(enough, ratio(span, close)),
        }
    )


def add_volume_confirmation(f: DataFrame) -> DataFrame:
    enough = C("n_rows") >= max(params.VOLUME_PERIODS)
    scores, weights = [], []
    for p in params.VOLUME_PERIODS:
        used = enough & (C("n_rows") > p)
        volume_ratio = F.coalesce(ratio(C("last_volume"), C(f"volume_mean_{p}")), F.lit(1.0))
        up = F.least(F.lit(2.0), volume_ratio) / 2.0
        down = F.greatest(F.lit(0.0), 2.0 - volume_ratio) / 2.0
        scores.append(F.when(used, F.when(C("last_ret") > 0, up).otherwise(down) / p).otherwise(0.0))
        weights.append(F.when(used, 1.0 / p).otherwise(0.0))
    f = f.withColumn("volume_score", F.coalesce(ratio(total(scores), total(weights)), F.lit(0.5)))
    score = C("volume_score")
    return f.withColumns(
        {
            "volume_trend": F.when(~enough, "NEUTRAL")
            .when(score > 0.7, "STRONG_CONFIRMATION")
            .when(score > 0.5, "WEAK_CONFIRMATION")
            .otherwise("DIVERGENCE"),
            "current_volume_ratio": F.when(
                C("n_rows") > 20, ratio(C("last_volume"), C("volume_mean_20"))
            ).otherwise(1.0),
        }
    )


def add_stop_loss(f: DataFrame, method: str = "ensemble") -> DataFrame:
    """Stop price; expects volatility regime and support columns."""
    close = C("close")
    enough = C("n_rows") >= 30
    multiplier = F.when(C("vol_regime") == "HIGH_VOL", 3.0).when(C("vol_regime") == "LOW_VOL", 1.5).otherwise(2.0)
    candidates = {
        "var": close * (1 + C("ret_var_30")),
        "volatility": close * (1 - 2 * C("ret_sd_20")),
        "atr": close - C("atr_14") * multiplier,
        "support": C("support"),
        "percentile": C("low_p20"),
    }
    f = f.withColumns({f"stop_{k}": v for k, v in candidates.items()})
    if method == "ensemble":

        def valid(k):
            return C(f"stop_{k}").between(close * 0.85, close * 1.02)

        weights = params.STOP_WEIGHTS
        weighted = [F.when(valid(k), C(f"stop_{k}") * w).otherwise(0.0) for k, w in weights.items()]
        used = [F.when(valid(k), w).otherwise(0.0) for k, w in weights.items()]
        raw = ratio(total(weighted), total(used))
    else:
        raw = C(f"stop_{method}") if method in candidates else F.lit(None).cast("double")
    raw = F.coalesce(raw, close * 0.95)
    bounded = F.least(F.greatest(raw, close * 0.90), close * 0.99)
    f = f.withColumn("stop_loss", F.when(enough, bounded).otherwise(close * 0.98))
    return f.withColumns(
        {
            "stop_loss_pct": F.when(enough, (close - C("stop_loss")) / close).otherwise(0.02),
            "stop_method": F.when(enough, F.lit(method)).otherwise("default"),
        }
    )


def add_position_size(f: DataFrame, portfolio: float, risk: float) -> DataFrame:
    enough = C("n_rows") >= 20
    base = F.when(C("stop_loss_pct") > 0, portfolio * risk / C("stop_loss_pct")).otherwise(portfolio * 0.01)
    by_vol = F.when(C("vol_regime") == "LOW_VOL", 1.5).when(C("vol_regime") == "HIGH_VOL", 0.7).otherwise(1.0)
    by_momentum = (
        F.when(C("momentum_strength") == "STRONG", 1.2)
        .when(C("momentum_strength") == "MODERATE", 1.0)
        .otherwise(0.8)
    )
    size = F.least(base * by_vol * by_momentum, F.lit(portfolio * 0.10))
    f = f.withColumns(
        {
            "position_size": F.when(enough, size).otherwise(portfolio * 0.01),
            "vol_multiplier": F.when(enough, by_vol),
            "confidence_multiplier": F.when(enough, by_momentum),
            "risk_adjusted": enough,
        }
    )
    return f.withColumn("position_pct", F.when(enough, C("position_size") / portfolio))


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def add_quant_score(f: DataFrame) -> DataFrame:
    close = C("close")
    enough = C("n_rows") >= 50
    target = F.when(C("resistance") > close, C("resistance")).otherwise(close * 1.05)
    reward = F.when(
        C("stop_loss") < close, (target - close) / F.nullif(close - C("stop_loss"), F.lit(0.0))
    ).otherwise(0.0)
    f = f.withColumn("risk_reward_ratio", reward)
    touches = F.least(F.lit(1.0), (C("support_strength") + C("resistance_strength")) / 10)
    scores = {
        "momentum": unit((C("momentum_score") + 0.05) / 0.10),
        "mean_reversion": C("reversion_prob"),
        "volatility": F.when(C("vol_regime") == "LOW_VOL", 0.8)
        .when(C("vol_regime") == "HIGH_VOL", 0.4)
        .otherwise(0.7),
        "support_resistance": touches * (1 - F.abs(C("range_position") - 0.5)),
        "volume": C("volume_score"),
        "risk_reward": unit((C("risk_reward_ratio") - 1) / 2),
    }
    f = f.withColumns({f"score_{k}": F.when(enough, v) for k, v in scores.items()})
    combined = total([C(f"score_{k}") * w for k, w in params.SCORE_WEIGHTS.items()])
    f = f.withColumn("final_score", F.when(enough, combined).otherwise(0.4))
    score = C("final_score")
    return f.withColumn(
        "recommendation",
        F.when(~enough, "INSUFFICIENT_DATA")
        .when(score >= 0.75, "STRONG_BUY")
        .when(score >= 0.6, "BUY")
        .when(score >= 0.4, "HOLD")
        .when(score >= 0.25, "SELL")
        .otherwise("STRONG_SELL"),
    )


def add_risk_metrics(f: DataFrame, risk_free: float = params.RISK_FREE_RATE) -> DataFrame:
    enough = C("n_rows") >= 30
    excess = C("ret_mean") - risk_free / params.TRADING_DAYS
    downside = F.when(C("loss_n") > 0, C("loss_sd")).otherwise(C("ret_sd"))
    proxied = C("market_n") > 10
    f = f.withColumn(
        "beta",
        F.when(enough & proxied, F.coalesce(ratio(C("market_cov"), C("market_var")), F.lit(1.0))).otherwise(1.0),
    )

    def guarded(x: Column) -> Column:
        return F.when(enough, F.coalesce(x, F.lit(0.0))).otherwise(0.0)

    return f.withColumns(
        {
            "sharpe_ratio": guarded(ratio(excess, C("ret_sd")) * ANNUAL),
            "sortino_ratio": guarded(ratio(excess, downside) * ANNUAL),
            "max_drawdown": guarded(C("max_drawdown")),
            "var_95": guarded(C("ret_var")),
            "volatility": guarded(C("ret_sd") * ANNUAL),
            "alpha": F.when(enough & proxied, C("ret_mean") - C("beta") * C("market_mean")).otherwise(0.0),
        }
    )


def add_trading_plan(f: DataFrame, portfolio: float, risk: float) -> DataFrame:
    close, stop = C("close"), C("stop_loss")
    buying = C("recommendation").isin("STRONG_BUY", "BUY")
    f = add_position_size(f, portfolio, risk).withColumns(
        {
            "plan_entry": F.when(buying, F.when(C("range_position") > 0.7, close * 0.99).otherwise(close)),
            "plan_target": F.when(
                buying,
                F.when(C("resistance") > close, C("resistance") * 0.98).otherwise(close * 1.08),
            ),
        }
    )
    entry, target = C("plan_entry"), C("plan_target")
    f = f.withColumn("plan_quantity", F.floor(C("position_size") / F.nullif(entry, F.lit(0.0))))
    protected = stop < entry
    return f.withColumns(
        {
            "plan_position_value": C("plan_quantity") * entry,
            "plan_stop": F.when(buying, stop),
            "plan_risk_amount": C("plan_quantity") * (entry - stop),
            "plan_reward_amount": C("plan_quantity") * (target - entry),
            "plan_risk_reward": F.when(
                buying, F.when(protected, ratio(target - entry, entry - stop)).otherwise(0.0)
            ),
            "plan_max_loss_pct": F.when(
                buying, F.when(protected, (entry - stop) / entry).otherwise(0.0)
            ),
            "plan_expected_gain_pct": ratio(target - entry, entry),
            "plan_reason": F.when(~buying, "Score too low for entry"),
        }
    )


def add_scores(f: DataFrame) -> DataFrame:
    """All six sub-models and the composite score, each computed once."""
    f = add_support_resistance(add_volatility(add_mean_reversion(add_momentum(f))))
    return add_quant_score(add_stop_loss(add_volume_confirmation(f)))


# --- operators: bars in, one row per symbol out -------------------------------------------


def momentum_score(bars: DataFrame) -> DataFrame:
    cols = [f"mom_{k}_{tf}" for tf in params.MOMENTUM_SPANS for k in ("ret", "t", "p")]
    return add_momentum(quant_features(bars)).select(
        "symbol", "momentum_score", "momentum_strength", "statistical_significance", "timeframe_analysis", *cols
    )


def mean_reversion(bars: DataFrame) -> DataFrame:
    cols = [f"{k}_{p}" for p in params.REVERSION_PERIODS for k in ("z", "z_pct")]
    return add_mean_reversion(quant_features(bars)).select(
        "symbol", "reversion_prob", "expected_direction", "current_extreme", *cols
    )


def volatility_regime(bars: DataFrame) -> DataFrame:
    return add_volatility(quant_features(bars)).select(
        "symbol", "vol_regime", "current_vol", "vol_percentile", "vol_score", "vol_clustering", "vol_forecast"
    )


def support_resistance(bars: DataFrame) -> DataFrame:
    return add_support_resistance(quant_features(bars)).select(
        "symbol", "support", "resistance", "support_strength", "resistance_strength", "range_position",
        "range_width_pct",
    )


def volume_confirmation(bars: DataFrame) -> DataFrame:
    return add_volume_confirmation(quant_features(bars)).select(
        "symbol", "volume_score", "volume_trend", "current_volume_ratio"
    )


def stop_loss(bars: DataFrame, method: str = "ensemble") -> DataFrame:
    f = add_stop_loss(add_support_resistance(add_volatility(quant_features(bars))), method)
    return f.select(
        "symbol", "close", "stop_loss", "stop_loss_pct", "stop_method",
        *[f"stop_{k}" for k in params.STOP_WEIGHTS],
    )


def position_size(
    bars: DataFrame, portfolio: float = params.PLAN_PORTFOLIO_VALUE, risk: float = params.PLAN_RISK_PCT
) -> DataFrame:
    f = add_support_resistance(add_volatility(add_momentum(quant_features(bars))))
    return add_position_size(add_stop_loss(f), portfolio, risk).select(
        "symbol", "position_size", "position_pct", "stop_loss_pct", "vol_multiplier",
        "confidence_multiplier", "risk_adjusted",
    )


def quant_score(bars: DataFrame) -> DataFrame:
    return add_scores(quant_features(bars)).select(
        "symbol", "final_score", "recommendation", *[f"score_{k}" for k in params.SCORE_WEIGHTS],
        "risk_reward_ratio",
    )


def risk_metrics(bars: DataFrame) -> DataFrame:
    return add_risk_metrics(quant_features(bars)).select(
        "symbol", "sharpe_ratio", "max_drawdown", "var_95", "volatility", "beta", "alpha", "sortino_ratio"
    )


def trading_plan(
    bars: DataFrame, portfolio: float = params.PLAN_PORTFOLIO_VALUE, risk: float = params.PLAN_RISK_PCT
) -> DataFrame:
    return add_trading_plan(add_scores(quant_features(bars)), portfolio, risk).select(
        "symbol", C("recommendation").alias("action"), C("final_score").alias("confidence_score"),
        "plan_entry", "plan_quantity", "plan_position_value", "plan_stop", "plan_target",
        "plan_risk_amount", "plan_reward_amount", "plan_risk_reward", "plan_max_loss_pct",
        "plan_expected_gain_pct", "plan_reason",
        C("vol_regime").alias("volatility_regime"), "momentum_strength", "volume_trend",
    )


