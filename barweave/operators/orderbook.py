"""Order-book analysis: per-quote projections and short snapshot histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barweave import params
from barweave.functions import series as s
from barweave.functions.scalar import ratio, truthy
from barweave.functions.topn import latest_n

C = F.col
FLOW_ROWS = 50
HISTORY_ROWS = 100
TREND_ROWS = 10


def spread_analysis(quotes: DataFrame) -> DataFrame:
    """Spread, its class and the position of the last price in it."""
    bid, ask, ltp = C("best_bid"), C("best_ask"), C("ltp")
    known = truthy(bid) & truthy(ask)
    traded = known & truthy(ltp)
    pct = F.when(bid > 0, (ask - bid) / F.nullif(bid, F.lit(0.0)) * 100).otherwise(0.0)
    df = quotes.withColumns(
        {
            "spread_absolute": F.when(known, ask - bid),
            "spread_percentage": F.when(known, pct),
            "bid_distance": F.when(traded, F.abs(ltp - bid)),
            "ask_distance": F.when(traded, F.abs(ltp - ask)),
        }
    )
    p = C("spread_percentage")
    return df.withColumns(
        {
            "spread_status": F.when(known, "ok").otherwise("insufficient_data"),
            "spread_class": F.when(p < 0.1, "TIGHT").when(p > 0.5, "WIDE").when(known, "NORMAL"),
            "ltp_position": F.when(traded & (ltp <= bid), "AT_BID")
            .when(traded & (ltp >= ask), "AT_ASK")
            .when(traded, "BETWEEN")
            .when(known, "UNKNOWN"),
            "ltp_bias": F.when(C("bid_distance") < C("ask_distance"), "BID_SIDE")
            .when(traded, "ASK_SIDE")
            .when(known, "UNKNOWN"),
        }
    )


def _sum(levels: str, f) -> Column:
    return F.aggregate(levels, F.lit(0.0), lambda acc, v: acc + f(v))


def depth_analysis(quotes: DataFrame) -> DataFrame:
    """Depth totals, weighted prices, imbalance and concentration of the levels."""
    known = (F.size("bid_levels") > 0) & (F.size("ask_levels") > 0)
    df = quotes.withColumns(
        {
            "total_bid_quantity": F.when(known, _sum("bid_levels", lambda v: v["quantity"])),
            "total_ask_quantity": F.when(known, _sum("ask_levels", lambda v: v["quantity"])),
            "_bid_value": _sum("bid_levels", lambda v: v["price"] * v["quantity"]),
            "_ask_value": _sum("ask_levels", lambda v: v["price"] * v["quantity"]),
        }
    )
    bids, asks = C("total_bid_quantity"), C("total_ask_quantity")

    def share(x: Column) -> Column:
        return F.when(known, F.coalesce(ratio(x, bids + asks) * 100, F.lit(50.0)))

    def weighted(value: str, quantity: Column) -> Column:
        return F.when(known, F.coalesce(ratio(C(value), quantity), F.lit(0.0)))

    def concentration(levels: str, quantity: Column) -> Column:
        top = F.get(levels, F.lit(0))["quantity"]
        several = F.coalesce(ratio(top, quantity) * 100, F.lit(0.0))
        return F.when(known, F.when(F.size(levels) > 1, several).otherwise(100.0))

    df = df.withColumns(
        {
            "bid_percentage": share(bids),
            "ask_percentage": share(asks),
            "bid_weighted_price": weighted("_bid_value", bids),
            "ask_weighted_price": weighted("_ask_value", asks),
            "bid_concentration": concentration("bid_levels", bids),
            "ask_concentration": concentration("ask_levels", asks),
            "n_bid_levels": F.when(known, F.size("bid_levels")),
            "n_ask_levels": F.when(known, F.size("ask_levels")),
            "depth_status": F.when(known, "ok").otherwise("insufficient_levels"),
        }
    )
    return df.withColumn(
        "depth_pressure",
        F.when(C("bid_percentage") > 60, "BUY_PRESSURE")
        .when(C("ask_percentage") > 60, "SELL_PRESSURE")
        .when(known, "BALANCED"),
    ).drop("_bid_value", "_ask_value")


def book_support_resistance(quotes: DataFrame) -> DataFrame:
    """Nearest and strongest level of each side, with distances from the last price."""
    known = (F.size("bid_levels") > 0) & (F.size("ask_levels") > 0) & truthy(C("ltp"))

    def held(levels: str) -> Column:
        return F.filter(levels, lambda v: v["quantity"] > 0)

    def prices(levels: str) -> Column:
        return F.transform(held(levels), lambda v: v["price"])

    # largest quantity; equal quantities resolve to the better price of the side
    strong_bid = F.array_max(
        F.transform(held("bid_levels"), lambda v: F.struct(v["quantity"].alias("q"), v["price"].alias("p")))
    )["p"]
    strong_ask = -F.array_max(
        F.transform(held("ask_levels"), lambda v: F.struct(v["quantity"].alias("q"), (-v["price"]).alias("p")))
    )["p"]
    df = quotes.withColumns(
        {
            "immediate_support": F.when(known, F.array_max(prices("bid_levels"))),
            "immediate_resistance": F.when(known, F.array_min(prices("ask_levels"))),
            "strong_support": F.when(known, strong_bid),
            "strong_resistance": F.when(known, strong_ask),
        }
    )
    ltp = C("ltp")
    return df.withColumns(
        {
            "support_distance_pct": ratio(ltp - C("immediate_support"), ltp) * 100,
            "resistance_distance_pct": ratio(C("immediate_resistance") - ltp, ltp) * 100,
            "level_status": F.when(known, "ok").otherwise("insufficient_data"),
        }
    )


def recent_snapshots(
    snapshots: DataFrame, order: tuple[str, ...] = ("ts", "seq"), n: int = HISTORY_ROWS
) -> DataFrame:
    """Latest snapshots per symbol, ranked in hash parts first as the input is a raw table."""
    return latest_n(snapshots, ["symbol"], [C(c).desc() for c in order], n, splits=params.HOT_KEY_SPLITS)


def _positioned(recent: DataFrame) -> DataFrame:
    """Previous snapshot's price; the rank descends with time, so it gives the time order."""
    by_rank = s.Window.partitionBy("symbol").orderBy(C("rn").desc())
    return recent.withColumn("prev_ltp", F.lag("ltp").over(by_rank))


def flow_aggregates(n: int = FLOW_ROWS) -> dict[str, Column]:
    """Counts and volumes of the last ``n`` snapshots; needs ``rn`` and ``prev_ltp``."""
    rn = C("rn")
    inside, moved = rn <= n, (rn <= n - 1) & C("prev_ltp").isNotNull()
    delta = C("ltp") - C("prev_ltp")
    return {
        "total_trades": F.count_if(inside),
        "positive_moves": F.count_if(moved & (delta > 0)),
        "negative_moves": F.count_if(moved & (delta < 0)),
        "neutral_moves": F.count_if(moved & (delta == 0)),
        "flow_value": F.sum(F.when(moved, C("ltp") * C("ltq"))),
        "flow_volume": F.sum(F.when(moved, C("ltq"))),
        "recent_volume": F.sum(F.when(rn <= 10, C("ltq"))),
        "avg_volume": F.avg(F.when(inside, C("ltq"))),
        "last_ltp": F.max(F.when(rn == 1, C("ltp"))),
    }


def add_flow(f: DataFrame, normalise_intensity: bool = False) -> DataFrame:
    """Flow labels. The intensity compares the sum of ten quantities with the mean of
    one; ``normalise_intensity`` compares mean with mean instead."""
    known = C("total_trades") >= 2
    up, down = C("positive_moves"), C("negative_moves")
    recent = C("recent_volume")
    if normalise_intensity:
        recent = recent / F.least(F.lit(10), C("total_trades"))
    return f.withColumns(
        {
            "flow_status": F.when(known, "ok").otherwise("insufficient_history"),
            "flow_direction": F.when(~known, F.lit(None))
            .when(up > down * 1.5, "BUYING")
            .when(down > up * 1.5, "SELLING")
            .otherwise("NEUTRAL"),
            "vwap": F.when(known, F.coalesce(ratio(C("flow_value"), C("flow_volume")), C("last_ltp"))),
            "trade_intensity": F.when(~known, F.lit(None))
            .when(recent > C("avg_volume") * 1.5, "HIGH")
            .when(recent < C("avg_volume") * 0.5, "LOW")
            .otherwise("NORMAL"),
        }
    )


def trend_aggregates(n: int = TREND_ROWS) -> dict[str, Column]:
    """Moves and sizes of the last ``n`` snapshots; needs ``rn`` and ``prev_ltp``."""
    rn = C("rn")
    moved = (rn <= n - 1) & truthy(C("ltp")) & truthy(C("prev_ltp"))
    delta = C("ltp") - C("prev_ltp")

    def mean_size(size: str, newest: int, oldest: int) -> Column:
        return F.avg(F.when(rn.between(newest, oldest) & (C(size) != 0), C(size)))

    return {
        "n_snapshots": F.count("*"),
        "n_changes": F.count_if(moved),
        "positive_ticks": F.count_if(moved & (delta > 0)),
        "negative_ticks": F.count_if(moved & (delta < 0)),
        "bid_ask_ratio": F.coalesce(
            F.max(F.when(rn == 1, ratio(C("bid_size"), C("ask_size")))), F.lit(0.0)
        ),
        "bid_now": mean_size("bid_size", 1, 3),
        "bid_before": mean_size("bid_size", 4, 6),
        "ask_now": mean_size("ask_size", 1, 3),
        "ask_before": mean_size("ask_size", 4, 6),
    }


def add_micro_trend(f: DataFrame) -> DataFrame:
    known = C("n_snapshots") >= 5
    n, up, down = C("n_changes"), C("positive_ticks"), C("negative_ticks")

    def size_trend(side: str) -> Column:
        now, before = C(f"{side}_now"), C(f"{side}_before")
        comparable = C("n_snapshots") >= 6
        return (
            F.when(~known, F.lit(None))
            .when(comparable & (now > before * 1.1), "INCREASING")
            .when(comparable & (now < before * 0.9), "DECREASING")
            .otherwise("STABLE")
        )

    return f.withColumns(
        {
            "tick_status": F.when(known, "ok").otherwise("building_history"),
            "micro_trend": F.when(~known, F.lit(None))
            .when(n < 3, "INSUFFICIENT_DATA")
            .when(up > n * 0.6, "STRONG_UP")
            .when(up > n * 0.4, "WEAK_UP")
            .when(down > n * 0.6, "STRONG_DOWN")
            .when(down > n * 0.4, "WEAK_DOWN")
            .otherwise("SIDEWAYS"),
            "bid_size_trend": size_trend("bid"),
            "ask_size_trend": size_trend("ask"),
            "positive_ticks": F.when(n >= 3, up).otherwise(0),
            "negative_ticks": F.when(n >= 3, down).otherwise(0),
            "tick_count": F.least(C("n_snapshots"), F.lit(TREND_ROWS)),
        }
    )


def snapshot_features(snapshots: DataFrame, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Flow and micro-trend inputs of each symbol from one pass over its recent snapshots."""
    return recent_features(recent_snapshots(snapshots, order))


def recent_features(recent: DataFrame) -> DataFrame:
    """``snapshot_features`` of snapshots that are cut to ``HISTORY_ROWS`` and ranked from the newest (``rn``) already."""
    rows = _positioned(recent)
    merged = {**flow_aggregates(), **trend_aggregates()}
    return rows.groupBy("symbol").agg(*[c.alias(n) for n, c in merged.items()])


def rolling_windows() -> dict[str, Column]:
    """``recent_features`` of the last snapshots up to each row; needs ``prev_ltp`` and the row index ``i``."""
    known, delta = C("prev_ltp").isNotNull(), C("ltp") - C("prev_ltp")
    traded = truthy(C("ltp")) & truthy(C("prev_ltp"))
    # of n snapshots the first has no move
    moves, ticks = s.last_rows(FLOW_ROWS - 1), s.last_rows(TREND_ROWS - 1)

    def rows(n: int) -> Column:
        return F.least(C("i") + 1, F.lit(n))

    def mean_size(size: str, newest: int, oldest: int) -> Column:
        return F.avg(F.when(C(size) != 0, C(size))).over(s.by_time().rowsBetween(1 - oldest, 1 - newest))

    return {
        "total_trades": rows(FLOW_ROWS),
        "positive_moves": F.count_if(known & (delta > 0)).over(moves),
        "negative_moves": F.count_if(known & (delta < 0)).over(moves),
        "neutral_moves": F.count_if(known & (delta == 0)).over(moves),
        "flow_value": F.sum(F.when(known, C("ltp") * C("ltq"))).over(moves),
        "flow_volume": F.sum(F.when(known, C("ltq"))).over(moves),
        "recent_volume": F.sum("ltq").over(s.last_rows(10)),
        "avg_volume": F.avg("ltq").over(s.last_rows(FLOW_ROWS)),
        "last_ltp": C("ltp"),
        "n_snapshots": rows(HISTORY_ROWS),
        "n_changes": F.count_if(traded).over(ticks),
        "positive_ticks": F.count_if(traded & (delta > 0)).over(ticks),
        "negative_ticks": F.count_if(traded & (delta < 0)).over(ticks),
        "bid_ask_ratio": F.coalesce(ratio(C("bid_size"), C("ask_size")), F.lit(0.0)),
        **{f"{side}_{k}": mean_size(f"{side}_size", *part) for side in ("bid", "ask") for k, part in (("now", (1, 3)), ("before", (4, 6)))},
    }


FLOW = (
    "flow_status", "flow_direction", "positive_moves", "negative_moves", "neutral_moves", "vwap",
    "trade_intensity", "recent_volume", "avg_volume", "total_trades",
)
TREND = (
    "tick_status", "micro_trend", "positive_ticks", "negative_ticks", "bid_ask_ratio",
    "bid_size_trend", "ask_size_trend", "tick_count",
)


def order_flow(snapshots: DataFrame, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    return add_flow(snapshot_features(snapshots, order)).select("symbol", *FLOW)


def tick_micro_trend(snapshots: DataFrame, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    return add_micro_trend(snapshot_features(snapshots, order)).select("symbol", *TREND)


def orderbook_signal(f: DataFrame) -> DataFrame:
    """Sentiment, direction, liquidity, entry advice and confidence from the labels."""
    pressure, flow = C("depth_pressure"), C("flow_direction")
    spread, micro = C("spread_class"), C("micro_trend")
    f = f.withColumns(
        {
            "market_sentiment": F.when(pressure == "BUY_PRESSURE", "BULLISH")
            .when(pressure == "SELL_PRESSURE", "BEARISH")
            .otherwise("NEUTRAL"),
            "liquidity_quality": F.when(spread == "TIGHT", "HIGH").when(spread == "WIDE", "LOW").otherwise("NORMAL"),
        }
    )
    sentiment = C("market_sentiment")
    flow_up = (flow == "BUYING") & (sentiment == "BULLISH")
    flow_down = (flow == "SELLING") & (sentiment == "BEARISH")
    micro_up, micro_down = micro.isin("STRONG_UP", "WEAK_UP"), micro.isin("STRONG_DOWN", "WEAK_DOWN")
    f = f.withColumns(
        {
            "short_term_direction": F.when(micro_up, "UP")
            .when(micro_down, "DOWN")
            .when(flow_up, "UP")
            .when(flow_down, "DOWN")
            .otherwise("SIDEWAYS"),
            "key_factors": F.array_compact(
                F.array(
                    F.when(pressure == "BUY_PRESSURE", "Strong buy depth"),
                    F.when(pressure == "SELL_PRESSURE", "Strong sell depth"),
                    F.when(flow == "BUYING", "Buying flow detected"),
                    F.when(flow == "SELLING", "Selling flow detected"),
                    F.when(spread == "TIGHT", "Tight spreads"),
                    F.when(spread == "WIDE", "Wide spreads"),
                    F.when(micro_up | micro_down, F.concat(F.lit("Micro trend: "), micro)),
                )
            ),
        }
    )
    liquid = C("liquidity_quality") != "LOW"
    direction = C("short_term_direction")
    f = f.withColumn(
        "entry_recommendation",
        F.when((sentiment == "BULLISH") & (direction == "UP") & liquid, "BUY")
        .when((sentiment == "BEARISH") & (direction == "DOWN") & liquid, "SELL")
        .otherwise("WAIT"),
    )
    agreed = F.coalesce(flow_up | flow_down, F.lit(False))
    confidence = (
        F.lit(0.5)
        + F.when(agreed, 0.2).otherwise(0.0)
        + F.when(spread == "TIGHT", 0.1).when(spread == "WIDE", -0.1).otherwise(0.0)
        + F.when(C("entry_recommendation") != "WAIT", 0.2).otherwise(0.0)
    )
    return f.withColumn("confidence", F.least(confidence, F.lit(1.0)))


def orderbook_analysis(
    quotes: DataFrame, snapshots: DataFrame, order: tuple[str, ...] = ("ts", "seq")
) -> DataFrame:
    """All order-book analyses of each quoted symbol in one row."""
    return analysis_of(quotes, snapshot_features(snapshots, order))


def analysis_of(quotes: DataFrame, features: DataFrame) -> DataFrame:
    """``orderbook_analysis`` from the features of the snapshots."""
    history = add_micro_trend(add_flow(features))
    return orderbook_signal(quote_analysis(quotes).join(history.select("symbol", *FLOW, *TREND), "symbol", "left"))


def quote_analysis(quotes: DataFrame) -> DataFrame:
    """What a quote tells by itself."""
    return book_support_resistance(depth_analysis(spread_analysis(quotes)))


def analysis_in_place(rows: DataFrame) -> DataFrame:
    """``analysis_of`` quotes that carry the features of their snapshots themselves."""
    return orderbook_signal(quote_analysis(add_micro_trend(add_flow(rows))))
