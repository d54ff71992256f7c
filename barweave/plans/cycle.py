"""End-to-end flows: history load and the signal cycle over all symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barweave import params
from barweave.functions.scalar import lit_or_col
from barweave.operators import actionable, bars as b, indicators as ind, orderbook, quant, trajectory as tr, unified

C = F.col


def load_history(intraday: DataFrame, historical: DataFrame, n: int = params.LOOKBACK) -> DataFrame:
    """Valid bars of both sources, one per second, newest ``n`` per symbol."""
    from barweave.sources.files import valid_bars

    rows = b.union_intraday_historical(valid_bars(intraday), valid_bars(historical), n)
    return b.recent_bars(b.dedup_bars(rows), n)


def symbol_features(
    bars: DataFrame, lookback: int = params.LOOKBACK, method: str = "simple", momentum: bool = True, as_of=None,
    splits: int = params.HOT_KEY_SPLITS,
) -> DataFrame:
    """Indicators, quant scores and trajectories of each symbol in one row.

    One shuffle by symbol, one chain of windows and one aggregation feed every
    model, so nothing is computed twice. A symbol's bars are ranked in ``splits`` parts
    first (see ``recent_bars``).
    """
    return recent_features(b.recent_bars(bars, lookback, splits), lookback, method, momentum, as_of)


def recent_features(
    recent: DataFrame, lookback: int = params.LOOKBACK, method: str = "simple", momentum: bool = True, as_of=None
) -> DataFrame:
    """``symbol_features`` of bars that are cut to ``lookback`` and ranked from the newest (``rn``) already."""
    series, families = ind.latest_inputs(recent, method, lookback, with_series=momentum)
    series = quant.quant_series(series).withColumn("prev_price", C("prev_close"))
    families = families + [quant.quant_aggregates(), tr.price_aggregates("close")]
    if momentum:
        series = tr.momentum_series(series)
        families.append(tr.momentum_aggregates())
    f = ind.aggregate_symbols(series, *families)
    f = f.withColumn("market_regime", ind.regime(C("adx")))
    f = tr.add_price_trajectory(quant.add_scores(f.drop("max_drawdown")), as_of)
    return tr.add_momentum_composite(f) if momentum else f


def rolls(lookback: int) -> bool:
    """Whether ``rolling_rows`` holds: no model but those of whole frames looks back as far as a frame, and none reads full series."""
    return max(tr.HISTORY, orderbook.HISTORY_ROWS) < lookback < params.ADAPTIVE_PERIODS


def rolling_features(bars: DataFrame, lookback: int = params.LOOKBACK, kept: Column | bool = True) -> DataFrame:
    """``recent_features`` (simple, no momentum) of the last ``lookback`` bars up to each of the ``kept`` bars.

    One chain of windows serves all bars of a symbol, where frames would need a copy of up to ``lookback`` bars for each
    of them. Windows are bounded by a frame, so a bar's features do not depend on what lies before it; the recursions,
    which begin at a frame's first bar, are folded over frames that begin later than a symbol. Further columns stay, as far as their names are others.
    """
    series = ind.rolling_series(ind.rolling_position(bars, lookback), lookback)
    series = quant.quant_series(series, inside=F.lit(True)).withColumn("prev_price", C("prev_close"))
    windows = ind.rolling_windows(lookback) | quant.rolling_windows(lookback) | tr.rolling_windows()
    f = series.withColumns(windows).where(lit_or_col(kept))
    f = quant.add_rolling_inputs(ind.add_rolling_newest(f, lookback))
    f = f.withColumn("market_regime", ind.regime(C("adx")))
    return tr.add_price_trajectory(quant.add_scores(f))


def component_snapshot(features: DataFrame, book: DataFrame) -> DataFrame:
    """Component blocks of each symbol from its features and its order-book analysis."""
    quoted = book.select(
        "symbol", C("ltp"), C("ltq"), "best_bid", "best_ask", C("spread_percentage").alias("spread_pct"),
        "market_sentiment", "confidence", "key_factors", C("ts").alias("quote_ts"), F.lit(True).alias("has_quote"),
    )
    basics = actionable.basic_signal(features)
    # a symbol takes part when it has a quote; bars without a quote are not scored
    return component_rows(quoted.join(basics.withColumn("has_bars", F.lit(True)), "symbol", "left"))


def component_rows(rows: DataFrame) -> DataFrame:
    """Component blocks of rows that hold the basic signal and the order-book analysis of a symbol."""
    has_bars = F.coalesce("has_bars", F.lit(False))
    return rows.select(
        "symbol",
        F.coalesce("ts", "quote_ts").alias("ts"),
        F.lit(0).cast("bigint").alias("seq"),
        unified.trajectory_component().alias("trajectory"),
        unified.quant_component(has_bars).alias("quant"),
        unified.technical_component(has_bars).alias("technical"),
        unified.orderbook_component().alias("orderbook"),
        unified.regime_component(has_bars).alias("market_regime"),
        unified.daily_context()["bias"].alias("daily_bias"),
        unified.price_block(has_bars).alias("price"),
    )


def signal_cycle(
    bars: DataFrame,
    quotes: DataFrame,
    snapshots: DataFrame,
    state: DataFrame | None = None,
    order: tuple[str, ...] = ("ts", "seq"),
    lookback: int = params.LOOKBACK,
    splits: int = params.HOT_KEY_SPLITS,
) -> DataFrame:
    """One unified signal per quoted symbol from its bars, quote and recent snapshots."""
    features = symbol_features(bars, lookback, momentum=False, splits=splits)
    book = orderbook.orderbook_analysis(quotes, snapshots, order)
    return unified.unified_signal(component_snapshot(features, book), state=state, single_cycle=True)


def actionable_cycle(
    bars: DataFrame, book: DataFrame | None = None, as_of=None, sectors=None, lookback: int = params.LOOKBACK,
    splits: int = params.HOT_KEY_SPLITS,
) -> DataFrame:
    """Actionable BUY / SELL rows of all symbols, optionally with order-book advice."""
    features = symbol_features(bars, lookback, as_of=as_of, splits=splits)
    if book is not None:
        features = features.join(book.select("symbol", "entry_recommendation"), "symbol", "left")
    return actionable.actionable_signals(features, as_of, sectors)
