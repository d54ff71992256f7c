"""Rule-based basic signals and actionable BUY / SELL signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barweave import params
from barweave.functions.scalar import fixed, is_high_vol_session, lit_or_col, ratio, session_vol_factor, truthy
from barweave.operators import trajectory as tr

C = F.col


def basic_signal(latest: DataFrame) -> DataFrame:
    """Regime-dependent BUY / SELL / HOLD from the newest indicators.

    Expects the columns of ``indicators_latest`` and adds the decision, its
    confidence and reasons, the volume label and the risk levels.
    """
    trending, ranging = C("market_regime") == "TRENDING", C("market_regime") == "RANGING"
    other = ~(trending | ranging)
    has_sma = truthy(C("sma_5")) & truthy(C("sma_20"))
    sma_up = C("sma_5") > C("sma_20")
    has_macd = trending & truthy(C("macd")) & truthy(C("macd_signal"))
    macd_up = C("macd") > C("macd_signal")
    has_rsi = truthy(C("rsi"))
    oversold = has_rsi & (C("rsi") < C("rsi_oversold"))
    overbought = has_rsi & ~oversold & (C("rsi") > C("rsi_overbought"))
    has_bands = ranging & truthy(C("bb_lower")) & truthy(C("bb_upper"))
    below = has_bands & (C("close") < C("bb_lower"))
    above = has_bands & ~below & (C("close") > C("bb_upper"))
    strong_adx = trending & (C("adx") > 25)
    has_volume = truthy(C("volume_ratio"))
    high_volume = has_volume & (C("volume_ratio") > C("volume_high"))
    low_volume = has_volume & ~high_volume & (C("volume_ratio") < C("volume_low"))

    def points(*cases: tuple[Column, float]) -> Column:
        chain = F.when(cases[0][0], cases[0][1])
        for cond, value in cases[1:]:
            chain = chain.when(cond, value)
        return chain.otherwise(0.0)

    score = (
        points((trending & has_sma & sma_up, 1.5), (trending & has_sma, -1.5))
        + points((has_macd & macd_up, 1.0), (has_macd, -1.0))
        + points((strong_adx, 0.5))
        + points((ranging & oversold, 1.5), (ranging & overbought, -1.5))
        + points((below, 1.0), (above, -1.0))
        + points((other & has_sma & sma_up, 0.5), (other & has_sma, -0.5))
        + points((other & oversold, 0.5), (other & overbought, -0.5))
    )

    def compared(text: str, value: str, sign: str, level: str) -> Column:
        return F.concat(F.lit(f"{text} ("), fixed(C(value), 1), F.lit(f" {sign} "), fixed(C(level), 1), F.lit(")"))

    def valued(text: str) -> Column:
        return F.concat(F.lit(f"{text} ("), fixed(C("rsi"), 1), F.lit(")"))

    reasons = F.array_compact(
        F.array(
            F.when(trending, "Market Regime: TRENDING")
            .when(ranging, "Market Regime: RANGING")
            .otherwise("Market Regime: WEAK/UNKNOWN"),
            F.when(trending & has_sma & sma_up, "SMA5 > SMA20 (Trending Bullish)").when(
                trending & has_sma, "SMA5 < SMA20 (Trending Bearish)"
            ),
            F.when(has_macd & macd_up, "MACD bullish crossover").when(has_macd, "MACD bearish crossover"),
            F.when(strong_adx, "ADX > 25, confirms trend"),
            F.when(ranging & oversold, compared("RSI oversold", "rsi", "<", "rsi_oversold")).when(
                ranging & overbought, compared("RSI overbought", "rsi", ">", "rsi_overbought")
            ),
            F.when(below, "Price below lower Bollinger Band").when(above, "Price above upper Bollinger Band"),
            F.when(other & has_sma & sma_up, "SMA5 > SMA20 (Weak Bullish)").when(
                other & has_sma, "SMA5 < SMA20 (Weak Bearish)"
            ),
            F.when(other & oversold, valued("RSI oversold")).when(other & overbought, valued("RSI overbought")),
            F.when(high_volume, compared("High volume activity", "volume_ratio", ">", "volume_high")).when(
                low_volume, compared("Low volume activity", "volume_ratio", "<", "volume_low")
            ),
        )
    )
    df = latest.withColumns(
        {
            "trend_score": score,
            "reasons": reasons,
            "volume_label": F.when(high_volume, "HIGH").when(low_volume, "LOW").otherwise("NORMAL"),
        }
    )
    t = C("trend_score")
    buy, sell = t >= 2.0, t <= -2.0
    swings = truthy(C("swing_low")) & truthy(C("swing_high"))
    return df.withColumns(
        {
            "overall_signal": F.when(buy, "BUY").when(sell, "SELL").otherwise("HOLD"),
            "signal_trend": F.when(buy, "BULLISH").when(sell, "BEARISH").otherwise("NEUTRAL"),
            "signal_confidence": F.when(buy | sell, F.least(F.abs(t) / 4.0, F.lit(1.0))).otherwise(
                F.greatest(F.lit(0.3), 1.0 - F.abs(t) / 2.0)
            ),
            "suggested_entry": F.when(swings & buy, F.round(C("close") * 0.998, 2)).when(
                swings & sell, F.round(C("close") * 1.002, 2)
            ),
            "basic_stop": F.when(swings & buy, F.round(C("swing_low") * 0.99, 2)).when(
                swings & sell, F.round(C("swing_high") * 1.01, 2)
            ),
            "basic_target": F.when(swings & buy, F.round("swing_high", 2)).when(
                swings & sell, F.round("swing_low", 2)
            ),
        }
    )


def signal_quality(direction: Column, has_bars=True) -> Column:
    """Fixed prior quality of a direction, 0.5 without bars."""
    return (
        F.when(~lit_or_col(has_bars), 0.5).when(direction == "BUY", 0.7).when(direction == "SELL", 0.6).otherwise(0.5)
    )


def quant_boost(f: DataFrame) -> DataFrame:
    """Confidence change and reasons from the composite score; none below 50 bars."""
    known = C("n_rows") >= 50
    score = C("final_score")
    text = F.concat(F.lit("("), fixed(score, 2), F.lit(")"))
    boost = (
        F.when(score > 0.7, 0.15).when(score > 0.6, 0.10).when(score < 0.3, -0.20).otherwise(0.0)
        + F.when(C("score_momentum") > 0.7, 0.05).otherwise(0.0)
        + F.when(C("score_volatility") > 0.6, 0.05).otherwise(0.0)
    )
    reasons = F.array_compact(
        F.array(
            F.when(score > 0.7, F.concat(F.lit("Strong quantitative score "), text))
            .when(score > 0.6, F.concat(F.lit("Good quantitative score "), text))
            .when(score < 0.3, F.concat(F.lit("Poor quantitative score "), text)),
            F.when(C("score_momentum") > 0.7, "Strong statistical momentum"),
            F.when(C("score_volatility") > 0.6, "Favorable volatility regime"),
            F.when(C("score_mean_reversion") > 0.7, "High mean reversion probability"),
        )
    )
    return f.withColumns(
        {
            "quant_boost": F.when(known, boost).otherwise(0.0),
            "quant_reasons": F.when(known, reasons).otherwise(F.array().cast("array<string>")),
        }
    )


def statistical_target(close: Column, resistance: Column, momentum: Column) -> Column:
    """Just below a reachable resistance, else a momentum-scaled distance."""
    reachable = (resistance > close) & (resistance < close * 1.15)
    by_momentum = close * (1 + 0.03 + momentum * 0.02)
    return (
        F.when(resistance.isNull(), close * 1.05).when(reachable, resistance * 0.98).otherwise(by_momentum)
    )


def strength_label(confidence: Column) -> Column:
    return (
        F.when(confidence > 0.85, "VERY_STRONG")
        .when(confidence > 0.75, "STRONG")
        .when(confidence > 0.65, "MODERATE")
        .otherwise("WEAK")
    )


def strength_rank(label: Column) -> Column:
    return (
        F.when(label == "VERY_STRONG", 4).when(label == "STRONG", 3).when(label == "MODERATE", 2).otherwise(1)
    )


SIGNAL = (
    "signal_type", "strength", "strength_rank", "confidence", "entry_price", "target_price",
    "stop_loss", "trajectory_confirmed", "time_horizon", "reasons", "risk_reward_ratio", "signal_ts",
    "signal_quality_score", "market_regime", "position_size_pct", "max_portfolio_exposure",
    "sector_bias", "gap_risk_factor",
)


def _inputs(f: DataFrame, as_of, sectors, usd_inr_change) -> DataFrame:
    when = C("ts") if as_of is None else lit_or_col(as_of).cast("timestamp")
    f = f.withColumns(
        {
            "signal_ts": when,
            "sector": tr.sector_of(C("symbol"), sectors),
            "signal_regime": tr.adx_regime(C("adx")),
            "entry_price": C("ltp") if "ltp" in f.columns else C("close"),
        }
    )
    return f.withColumns(
        {
            "bias": tr.sector_bias(C("sector"), C("signal_ts"), usd_inr_change),
            "momentum_abs": F.coalesce("momentum_abs", F.lit(0.0)),
            "_session": is_high_vol_session(C("signal_ts")),
            "_advice": C("entry_recommendation") if "entry_recommendation" in f.columns else F.lit(None),
        }
    )


def _bias_text(kind: str, sign: str) -> Column:
    return F.concat(F.lit(f"{kind} sector bias for "), C("sector"), F.lit(f" ({sign}"), fixed(C("bias"), 1), F.lit(")"))


def _path_text(kind: str, where: str) -> Column:
    return F.concat(F.lit(f"{kind} trajectory ("), fixed(C("trend_consistency"), 2), F.lit(f") in {where} market"))


def _momentum_text(kind: str) -> Column:
    return F.concat(F.lit(f"Strong {kind} momentum ("), fixed(C("momentum_abs"), 2), F.lit(")"))


def _on_path(*labels: str) -> Column:
    return C("overall_trajectory").isin(*labels) & (C("trend_consistency") > params.TREND_CONSISTENCY_MIN)


# Evidence items: (condition, points, reason). Items 1 to 3 confirm the trajectory.


def _buy_items() -> list:
    regime = C("signal_regime")
    path = _on_path("STRONG_BULLISH", "BULLISH")
    recovering = C("rsi_level") == "OVERSOLD_RECOVERY"
    return [
        (C("bias") > 0.2, 0.1, _bias_text("Positive", "+")),
        ((regime == "TRENDING") & path, 0.3, _path_text("Confirmed bullish", "TRENDING")),
        ((regime == "RANGING") & recovering, 0.3, "RSI recovering from oversold in RANGING market"),
        ((regime == "UNDEFINED") & path, 0.15, _path_text("Bullish", "UNDEFINED")),
        ((C("momentum_direction") == "BULLISH") & (C("momentum_abs") > 0.4), 0.25, _momentum_text("bullish")),
        (recovering, 0.2, "RSI recovering from oversold"),
        (C("macd_cross") == "BULLISH_CROSSOVER_CONFIRMED", 0.2, "MACD bullish crossover confirmed"),
        (C("volume_direction") == "INCREASING", 0.15, "Increasing volume support"),
        (C("_session"), 0.05, "High volatility session timing"),
        (C("_advice") == "BUY", 0.1, "Orderbook shows buying pressure"),
    ]


def _sell_items() -> list:
    regime = C("signal_regime")
    path = _on_path("STRONG_BEARISH", "BEARISH")
    breaking = C("rsi_level") == "OVERBOUGHT_BREAKDOWN"
    death = F.coalesce(C("ma_signal") == "DEATH_CROSS", F.lit(False))
    falling = (C("volume_direction") == "INCREASING") & (C("short_direction") == "DOWN")
    return [
        (C("bias") < -0.2, 0.1, _bias_text("Negative", "")),
        ((regime == "TRENDING") & path, 0.3, _path_text("Confirmed bearish", "TRENDING")),
        ((regime == "RANGING") & breaking, 0.3, "RSI breaking down from overbought in RANGING market"),
        ((regime == "UNDEFINED") & path, 0.15, _path_text("Bearish", "UNDEFINED")),
        ((C("momentum_direction") == "BEARISH") & (C("momentum_abs") > 0.4), 0.25, _momentum_text("bearish")),
        (breaking, 0.2, "RSI breaking down from overbought"),
        (C("macd_cross") == "BEARISH_CROSSOVER_CONFIRMED", 0.2, "MACD bearish crossover confirmed"),
        (falling, 0.15, "Increasing volume on decline"),
        (C("_session"), 0.05, "High volatility session - increased selling pressure"),
        (C("_advice") == "SELL", 0.1, "Orderbook shows selling pressure"),
        (death, 0.15, "Moving average death cross"),
        (~death & (C("ma_alignment") == "BEARISH"), 0.1, "Bearish moving average alignment"),
    ]


def _evidence(items: list) -> Column:
    """Points, reason texts and confirmation of the items that hold."""
    points = sum((F.when(cond, p).otherwise(0.0) for cond, p, _ in items), F.lit(0.0))
    texts = F.array_compact(F.array(*[F.when(cond, lit_or_col(text)) for cond, _, text in items]))
    confirmed = F.coalesce(items[1][0], F.lit(False))
    for cond, _, _ in items[2:4]:
        confirmed = confirmed | F.coalesce(cond, F.lit(False))
    return F.struct(points.alias("points"), texts.alias("texts"), confirmed.alias("confirmed"))


def _judged(side: str, blocked: Column, confidence: Column, reasons: Column, early: Column) -> Column:
    """The signal struct of one side, NULL when it is not accepted."""
    least = F.when(C("signal_regime") == "RANGING", 0.60).otherwise(0.65)
    entry, target, stop = C("entry_price"), C(f"_{side}_target"), C(f"_{side}_stop")
    reward, risk = (target - entry, entry - stop) if side == "BUY" else (entry - target, stop - entry)
    accepted = (
        (C("trajectory_status") == "ok")
        & ~blocked
        & C(f"_{side}_evidence")["confirmed"]
        & (confidence >= least)
        & (F.size(reasons) >= 3)
    )
    strength = strength_label(confidence)
    fields = {
        "signal_type": F.lit(side),
        "strength": strength,
        "strength_rank": strength_rank(strength),
        "confidence": confidence,
        "entry_price": entry,
        "target_price": target,
        "stop_loss": stop,
        "trajectory_confirmed": F.lit(True),
        "time_horizon": F.when(early, "SHORT").when(C("momentum_abs") > 0.6, "MEDIUM").otherwise("LONG"),
        "reasons": reasons,
        "risk_reward_ratio": ratio(reward, risk),
        "signal_ts": C("signal_ts"),
        "signal_quality_score": signal_quality(F.lit(side)),
        "market_regime": C("signal_regime"),
        "position_size_pct": F.lit(1.0),
        "max_portfolio_exposure": F.lit(0.05),
        "sector_bias": C("sector"),
        "gap_risk_factor": C("gap_risk_factor"),
    }
    return F.when(accepted, F.struct(*[fields[n].alias(n) for n in SIGNAL]))


def actionable_signals(features: DataFrame, as_of=None, sectors=None, usd_inr_change=0.0) -> DataFrame:
    """BUY and SELL rows of the symbols whose trajectory and other factors agree.

    Both sides are judged in one pass over the features and then unfolded: a union
    of two filtered branches would compute all features twice.
    """
    f = quant_boost(_inputs(features, as_of, sectors, usd_inr_change))
    factor = session_vol_factor(C("signal_ts"))
    entry = C("entry_price")
    f = f.withColumns(
        {
            "_BUY_evidence": _evidence(_buy_items()),
            "_SELL_evidence": _evidence(_sell_items()),
            "_BUY_target": statistical_target(entry, C("resistance"), C("momentum_abs")),
            "_BUY_stop": C("stop_loss"),
            "_SELL_target": entry * (1 - (0.03 + C("momentum_abs") * 0.02 * factor)),
            "_SELL_stop": entry * (1 + 0.015 * factor),
        }
    )
    buy, sell = C("_BUY_evidence"), C("_SELL_evidence")
    f = f.withColumns(
        {
            # rounded so that sums of decimal points meet the decimal thresholds
            "_BUY_confidence": F.round(buy["points"] + C("quant_boost"), 9),
            "_SELL_confidence": F.round(sell["points"], 9),
            "_BUY_reasons": F.concat(buy["texts"], C("quant_reasons")),
        }
    )
    sides = F.array(
        _judged("BUY", C("bias") < -0.2, C("_BUY_confidence"), C("_BUY_reasons"), C("acceleration") > 0.5),
        _judged("SELL", C("bias") > 0.2, C("_SELL_confidence"), sell["texts"], C("acceleration") < -0.5),
    )
    rows = f.select("symbol", F.explode(sides).alias("s")).where(C("s").isNotNull())
    return rows.select("symbol", *[C("s")[n].alias(n) for n in SIGNAL])


def buy_signals(features: DataFrame, as_of=None, sectors=None, usd_inr_change=0.0) -> DataFrame:
    return actionable_signals(features, as_of, sectors, usd_inr_change).where(C("signal_type") == "BUY")


def sell_signals(features: DataFrame, as_of=None, sectors=None, usd_inr_change=0.0) -> DataFrame:
    return actionable_signals(features, as_of, sectors, usd_inr_change).where(C("signal_type") == "SELL")


def combined_recommendation(rule: Column, quant: Column) -> Column:
    """Agreement of the first rule signal (NULL for none) and the quant label."""
    return (
        F.when(rule.isNull(), quant)
        .when((rule == "BUY") & quant.isin("BUY", "STRONG_BUY"), "STRONG_BUY")
        .when((rule == "SELL") & quant.isin("SELL", "STRONG_SELL"), "STRONG_SELL")
        .when(rule.isin("BUY", "SELL") & (quant == "HOLD"), rule)
        .when(quant.isin("STRONG_BUY", "STRONG_SELL"), quant)
        .otherwise("HOLD")
    )


def first_signal(signals: DataFrame) -> DataFrame:
    """First signal of each symbol: BUY comes before SELL."""
    rank = F.when(C("signal_type") == "BUY", 0).otherwise(1)
    return signals.groupBy("symbol").agg(
        F.min_by("signal_type", rank).alias("rule_signal"), F.count("*").alias("total_signals")
    )


def enhanced_recommendation(signals: DataFrame, scores: DataFrame) -> DataFrame:
    """Final recommendation per symbol; without a score the rule signal or HOLD."""
    rows = scores.join(first_signal(signals), "symbol", "left")
    final = F.when(
        C("recommendation").isNull(), F.coalesce(C("rule_signal"), F.lit("HOLD"))
    ).otherwise(combined_recommendation(C("rule_signal"), C("recommendation")))
    return rows.select(
        "symbol", "rule_signal", "final_score", "recommendation", final.alias("final_recommendation")
    )


def signals_summary(signals: DataFrame) -> DataFrame:
    """Totals, means, sector counts and the best signal of each side."""
    confident = F.struct("confidence", "symbol")

    def best(side: str) -> Column:
        row = F.struct("symbol", "confidence", "entry_price", "target_price", "stop_loss")
        return F.max_by(row, F.when(C("signal_type") == side, confident))

    # sums per sector first; the total then runs over a handful of rows
    per_sector = signals.groupBy("sector_bias").agg(
        F.count("*").alias("n"),
        F.count_if(C("signal_type") == "BUY").alias("buys"),
        F.count_if(C("signal_type") == "SELL").alias("sells"),
        F.sum("confidence").alias("confidence"),
        F.sum("risk_reward_ratio").alias("rr"),
        F.count("risk_reward_ratio").alias("rr_n"),
        F.sum("gap_risk_factor").alias("gap"),
        F.count_if(C("strength_rank") >= 3).alias("strong"),
        best("BUY").alias("best_buy"),
        best("SELL").alias("best_sell"),
    )

    def overall(side: str) -> Column:
        b = C(f"best_{side}")
        return F.max_by(b, F.struct(b["confidence"], b["symbol"]))

    return per_sector.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_signals"),
        F.coalesce(F.sum("buys"), F.lit(0)).alias("buy_signals"),
        F.coalesce(F.sum("sells"), F.lit(0)).alias("sell_signals"),
        ratio(F.sum("confidence"), F.sum("n")).alias("avg_confidence"),
        ratio(F.sum("rr"), F.sum("rr_n")).alias("avg_risk_reward"),
        F.coalesce(F.sum("strong"), F.lit(0)).alias("strong_signals"),
        ratio(F.sum("gap"), F.sum("n")).alias("avg_gap_risk"),
        # one entry per sector of the fixed sector list
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("sector_bias", "n")))).alias(
            "sector_distribution"
        ),
        overall("buy").alias("best_buy"),
        overall("sell").alias("best_sell"),
    )


def signal_analytics(
    symbols: DataFrame, signals: DataFrame, prices: DataFrame, momentum: DataFrame, history: DataFrame
) -> DataFrame:
    """Per symbol: number of signals, both trajectories and the length of the history."""
    counts = signals.groupBy("symbol").agg(F.count("*").alias("total_signals"))
    lengths = history.groupBy("symbol").agg(F.count("*").alias("signal_history_length"))
    return (
        symbols.select("symbol")
        .join(counts, "symbol", "left")
        .join(prices.select("symbol", "overall_trajectory", "trend_consistency"), "symbol", "left")
        .join(momentum.select("symbol", "composite_momentum", "momentum_direction"), "symbol", "left")
        .join(lengths, "symbol", "left")
        .withColumns(
            {
                "total_signals": F.coalesce("total_signals", F.lit(0)),
                "signal_history_length": F.coalesce("signal_history_length", F.lit(0)),
            }
        )
    )
