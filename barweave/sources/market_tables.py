"""Market tables derived from the TPC-H style test parquet.

``lineitem`` is read as trades of a supplier symbol ("S<suppkey>"), ``events`` as
ticks of a user symbol ("U<user_id>"). Everything is a Spark expression over the
given tables, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barweave import params
from barweave.functions.topn import latest_n
from barweave.operators.bars import ohlcv_bars

TEST_SECTORS = {"METALS": ["ring", "bolt", "anvil"], "AUTO": ["gear", "rod", "plate"], "IT": ["gizmo", "hot"]}
SYMBOL_SECTORS = {"IT": ["S1"], "BANKING": ["S2"], "ENERGY": ["S3"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trade per order line: (symbol, ts, trade_seq) is a total order."""
    digits = F.lit("10000000000000").cast("decimal(14,0)")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        (
            F.col("l_orderkey").cast("decimal(19,0)") * digits
            + F.col("l_linenumber").cast("decimal(10,0)") * F.lit("1000000000000").cast("decimal(13,0)")
            + F.col("l_partkey").cast("decimal(19,0)")
        )
        .cast("decimal(38,0)")
        .alias("trade_seq"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("ltp"),
        F.col("l_quantity").cast("bigint").alias("ltq"),
        (F.col("l_linenumber").cast("bigint") * 10).alias("bid_size"),
        (F.col("l_partkey") % 90 + 10).alias("ask_size"),
        F.col("l_linestatus").alias("side"),
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ohlcv_bars(trades(spark, sf_dir), "1 day", order=F.col("trade_seq")).select(
        "symbol", "ts", "open", "high", "low", "close", "volume"
    )


def scaled_bars(bars: DataFrame, trend: bool = False) -> DataFrame:
    """Calmer variants of the noisy daily bars, with the order of prices kept.

    Plain: every price p becomes 1000 + p / 47. With ``trend``: 8000 + p / 470 and a
    drift per day whose sign and size depend on the symbol; volumes swell in the
    last 200 days of every 300.
    """
    num = F.substring("symbol", 2, 20).cast("bigint")
    if trend:
        days = F.datediff(F.to_date("ts"), F.lit("1995-01-01").cast("date"))
        drift = F.when(num % 2 == 0, 1.0).otherwise(-1.0) * (num % 7 + 1) / 4.0
        offset, divisor = 8000.0 + days * drift, 470.0
        swell = 1 + F.greatest(F.lit(0), days % 300 - 30)
        bars = bars.withColumn("volume", F.col("volume") * swell)
    else:
        offset, divisor = F.lit(1000.0), 47.0
    return bars.withColumns({c: offset + F.col(c) / divisor for c in ("open", "high", "low", "close")})


def calm_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_bars(daily_bars(spark, sf_dir))


def trending_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_bars(daily_bars(spark, sf_dir), trend=True)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .where(F.col("value") > 0)
        .select(
            F.concat(F.lit("U"), F.col("user_id")).alias("symbol"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_id").alias("seq"),
            F.col("value").alias("ltp"),
            F.get_json_object("props", "$.k").cast("bigint").alias("ltq"),
            "event_type",
        )
    )


def feed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON feed messages, one per event: a market feed and an index feed in one map."""
    e = table(spark, sf_dir, "events")
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    # clicks carry seconds, the rest milliseconds; both spellings of the level keys occur
    stamp = F.when(F.col("event_type") == "click", F.floor(millis / 1000)).otherwise(millis)
    k = F.get_json_object("props", "$.k")
    value = F.format_string("%.2f", "value")
    long_level = F.format_string(
        '{"bidQ":%s,"bidP":%s,"askQ":%s,"askP":%s}',
        k, value, (k.cast("int") + 5).cast("string"), F.format_string("%.2f", F.col("value") + 0.5),
    )
    short_level = F.format_string(
        '{"bq":%s,"bp":%s,"aq":%s,"ap":%s}',
        (k.cast("int") * 2).cast("string"), F.format_string("%.2f", F.col("value") * 0.913717), k,
        F.format_string("%.2f", F.col("value") + 1.5),
    )
    empty_level = F.lit('{"bidQ":0,"bidP":0.0,"askQ":7,"askP":1.25}')
    levels = F.when(
        F.col("event_type") == "error", F.concat(short_level, F.lit(","), empty_level)
    ).otherwise(F.concat_ws(",", long_level, short_level, empty_level))
    market = F.format_string(
        '{"fullFeed":{"marketFF":{"ltpc":{"ltp":%s,"ltt":%s,"ltq":%s},"marketLevel":{"bidAskQuote":[%s]}}}}',
        value, stamp.cast("string"), k, levels,
    )
    index = F.format_string('{"fullFeed":{"indexFF":{"ltpc":{"ltp":%s}}}}', value)
    user = F.col("user_id").cast("string")
    return e.select(
        F.col("event_id").alias("seq"),
        F.format_string(
            '{"type":"live_feed","feeds":{"U%s":%s,"X%s":%s},"currentTs":%s}',
            user, market, user, index, millis.cast("string"),
        ).alias("value"),
    )


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension of the user symbols: customers outside the BUILDING segment."""
    return (
        table(spark, sf_dir, "customer")
        .where(F.col("c_mktsegment") != "BUILDING")
        .select(
            F.concat(F.lit("U"), F.col("c_custkey")).alias("instrument_key"),
            F.col("c_name").alias("symbol"),
        )
    )


def book_quotes(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    """One quote per supplier symbol: its last five order lines of each status are the levels."""
    rows = latest_n(
        trades(spark, sf_dir), ["symbol", "side"], [F.col("ts").desc(), F.col("trade_seq").desc()], 5,
        rank="lvl", splits=params.HOT_KEY_SPLITS,
    )
    last = (bars if bars is not None else daily_bars(spark, sf_dir)).groupBy("symbol").agg(
        F.max_by("close", "ts").alias("last_close"), F.max("ts").alias("ts")
    )
    num = F.substring("symbol", 2, 20).cast("bigint")
    step = (num % 70 + 1) / 20000.0
    price = F.col("last_close") * (
        1 + F.when(F.col("side") == "F", -1).otherwise(1) * F.col("lvl") * step
    )
    level = F.struct("lvl", price.alias("price"), F.col("ltq").alias("quantity"))
    sides = (
        rows.join(last, "symbol")
        .groupBy("symbol", "last_close", last["ts"])
        .agg(
            # at most five levels a side, so the lists are bounded
            F.array_sort(F.collect_list(F.when(F.col("side") == "F", level))).alias("b"),
            F.array_sort(F.collect_list(F.when(F.col("side") == "O", level))).alias("a"),
            F.max_by("ltq", F.when(F.col("lvl") == 1, F.col("trade_seq"))).alias("ltq"),
        )
    )

    def plain(c):
        return F.transform(c, lambda v: F.struct(v["price"].alias("price"), v["quantity"].alias("quantity")))

    return sides.select(
        "symbol",
        "ts",
        (F.col("last_close") * (1 + (num % 5 - 2) / 10000.0)).alias("ltp"),
        "ltq",
        F.get("b", F.lit(0))["price"].alias("best_bid"),
        F.get("a", F.lit(0))["price"].alias("best_ask"),
        F.get("b", F.lit(0))["quantity"].alias("bid_size"),
        F.get("a", F.lit(0))["quantity"].alias("ask_size"),
        plain(F.col("b")).alias("bid_levels"),
        plain(F.col("a")).alias("ask_levels"),
    )


def component_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many cycles per symbol: component blocks derived from each event."""
    t = ticks(spark, sf_dir)
    side = (
        F.when(F.col("event_type") == "click", "BUY")
        .when(F.col("event_type") == "error", "SELL")
        .otherwise("HOLD")
    )
    strength = F.least(F.lit(1.0), F.col("ltp") / 61.7)
    sign = F.when(side == "BUY", 1.0).when(side == "SELL", -1.0).otherwise(0.0)
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")

    def block(score, confidence, direction, reason, bias=none_d, momentum=none_d):
        return F.struct(
            score.alias("score"), confidence.alias("confidence"), direction.alias("direction"),
            reason.alias("reason"), bias.alias("bias"), momentum.alias("momentum"),
        )

    return t.select(
        "symbol", "ts", "seq",
        block(sign * strength, strength, side, F.lit("path")).alias("trajectory"),
        F.when(F.col("ltq") >= 20, block(none_d, none_d, none_s, none_s, bias=F.col("ltq") / 49.7 - 1.0,
                                         momentum=strength)).alias("quant"),
        block(strength, F.lit(0.0), side, none_s).alias("technical"),
        F.when(F.col("event_type") != "view", block(F.col("ltq") / 101.3, F.col("ltq") / 80.9, F.lit("BUY"),
                                                    F.lit("book"))).alias("orderbook"),
        block(F.lit(0.2), F.lit(0.2), F.lit("HOLD"), none_s).alias("market_regime"),
        F.when(F.col("ltq") % 2 == 0, F.col("ltq") / 49.7 - 1.0).alias("daily_bias"),
        F.struct(
            F.col("ltp").alias("ltp"), F.col("ltp").alias("close"),
            F.when(F.col("ltq") > 10, F.col("ltp") * 0.02).alias("atr"),
            F.col("ltp").alias("best_bid"), (F.col("ltp") + 0.05).alias("best_ask"),
            F.lit(0.0).alias("spread_pct"),
        ).alias("price"),
    )


def rule_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows for the signal rules: labels and scores spread over each tick's fields."""
    t = ticks(spark, sf_dir)
    k, v = F.col("ltq"), F.col("ltp")

    def pick(x, *labels):
        return F.element_at(F.array(*[F.lit(label) for label in labels]), (x % len(labels) + 1).cast("int"))

    return t.select(
        F.concat(pick(F.col("seq"), "HDFC Bank ", "Infosys ", "Cipla ", "Fund "), "symbol").alias("symbol"),
        "ts", "seq",
        (v + 100).alias("close"),
        k.cast("double").alias("adx"),
        (F.col("seq") % 120).alias("n_rows"),
        F.lit("ok").alias("trajectory_status"),
        F.when(F.col("event_type") == "click", "STRONG_BULLISH")
        .when(F.col("event_type") == "view", "BULLISH")
        .when(F.col("event_type") == "error", "STRONG_BEARISH")
        .otherwise("BEARISH").alias("overall_trajectory"),
        (k / 100.0 + 0.2).alias("trend_consistency"),
        (1.0 - k / 400.0).alias("gap_risk_factor"),
        ((k - 50) / 40.0).alias("acceleration"),
        F.when(k % 3 == 0, "DOWN").otherwise("UP").alias("short_direction"),
        pick(k, "BULLISH", "BEARISH", "NEUTRAL").alias("momentum_direction"),
        (k % 10 / 10.0).alias("momentum_abs"),
        pick(k, "OVERSOLD_RECOVERY", "OVERBOUGHT_BREAKDOWN", "NORMAL", "OVERSOLD").alias("rsi_level"),
        pick(F.col("seq"), "BULLISH_CROSSOVER_CONFIRMED", "BEARISH_CROSSOVER_CONFIRMED", "NEUTRAL").alias("macd_cross"),
        pick(F.col("seq"), "INCREASING", "SIDEWAYS").alias("volume_direction"),
        pick(k, "DEATH_CROSS", "BEARISH_ALIGNMENT", "BULLISH_ALIGNMENT").alias("ma_signal"),
        pick(k, "BEARISH", "BEARISH", "BULLISH").alias("ma_alignment"),
        pick(F.col("seq"), "BUY", "WAIT", "SELL").alias("entry_recommendation"),
        (k / 100.0).alias("final_score"),
        (1.0 - k / 100.0).alias("score_momentum"),
        pick(k, "0.4", "0.7", "0.8").cast("double").alias("score_volatility"),
        (k / 110.0).alias("score_mean_reversion"),
        ((v + 100) * (0.95 + k / 300.0)).alias("resistance"),
        ((v + 100) * 0.95).alias("stop_loss"),
        pick(k, "STRONG_BUY", "BUY", "HOLD", "SELL", "STRONG_SELL").alias("recommendation"),
    )
