"""Market feed messages: decoding of the nested form into ticks and quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barweave import schemas
from barweave.functions.scalar import epoch_to_ts, ratio


def parse_feed(messages: DataFrame, column: str = "value") -> DataFrame:
    """Decode JSON feed messages; the other columns are kept."""
    others = [c for c in messages.columns if c != column]
    return messages.select(*others, F.from_json(column, schemas.FEED_MESSAGE).alias("m")).select(
        *others, "m.*"
    )


def explode_feed(messages: DataFrame) -> DataFrame:
    """One row per instrument with a full market feed that carries a last price.

    The instrument fields sit in ``market``; index feeds and first-level feeds are
    dropped. Works on batch and streaming input.
    """
    others = [c for c in messages.columns if c not in ("feeds", "type")]
    # the outer form: from the inner one the optimizer infers a filter on the size of the map, for which every
    # message would be decoded two more times; the filter on the price drops messages without feeds as well
    rows = messages.select(*others, F.explode_outer("feeds").alias("instrument_key", "feed"))
    market = F.col("feed.fullFeed.marketFF")
    return rows.where(market["ltpc"]["ltp"].isNotNull()).select(
        *others, "instrument_key", market.alias("market")
    )


def feed_ticks(exploded: DataFrame) -> DataFrame:
    """Ticks on exchange time; the message time is used where the trade has none."""
    last = F.col("market.ltpc")
    return exploded.select(
        "instrument_key",
        epoch_to_ts(F.coalesce(last["ltt"], F.col("currentTs"))).alias("ts"),
        last["ltp"].alias("ltp"),
        F.coalesce(last["ltq"], F.lit(0)).alias("ltq"),
        F.col("market.marketLevel.bidAskQuote").alias("levels"),
        *[c for c in ("seq",) if c in exploded.columns],  # the order of messages settles equal times
    )


def _either(level: Column, short: str, long: str) -> Column:
    """Short key unless it is missing or zero, then the long key."""
    return F.coalesce(F.when(level[short] != 0, level[short]), level[long])


def best_quote(ticks: DataFrame, levels: str = "levels") -> DataFrame:
    """Best bid and ask of the first level; spread only when both are positive."""
    first = F.try_element_at(levels, F.lit(1))
    bid = F.coalesce(_either(first, "bp", "bidP"), F.lit(0.0))
    ask = F.coalesce(_either(first, "ap", "askP"), F.lit(0.0))
    both = (F.col("best_bid") > 0) & (F.col("best_ask") > 0)
    return (
        ticks.withColumns(
            {
                "best_bid": bid,
                "best_ask": ask,
                "bid_size": F.coalesce(_either(first, "bq", "bidQ"), F.lit(0)),
                "ask_size": F.coalesce(_either(first, "aq", "askQ"), F.lit(0)),
            }
        )
        .withColumn("spread", F.when(both, F.col("best_ask") - F.col("best_bid")).otherwise(0.0))
        .withColumn(
            "spread_pct",
            F.when(both, ratio(F.col("spread"), F.col("best_bid")) * 100).otherwise(0.0),
        )
    )


def top_levels(ticks: DataFrame, levels: str = "levels", n: int = 5) -> DataFrame:
    """First ``n`` priced levels of each side as arrays of {price, quantity}."""

    def side(short_p, long_p, short_q, long_q):
        priced = F.filter(levels, lambda v: F.coalesce(_either(v, short_p, long_p), F.lit(0.0)) != 0)
        return F.slice(
            F.transform(
                priced,
                lambda v: F.struct(
                    _either(v, short_p, long_p).alias("price"),
                    F.coalesce(_either(v, short_q, long_q), F.lit(0)).alias("quantity"),
                ),
            ),
            1,
            n,
        )

    return ticks.withColumns(
        {
            "bid_levels": side("bp", "bidP", "bq", "bidQ"),
            "ask_levels": side("ap", "askP", "aq", "askQ"),
        }
    )


def feed_quotes(exploded: DataFrame) -> DataFrame:
    """Quote snapshots: best quote and top levels of each feed row."""
    return top_levels(best_quote(feed_ticks(exploded)))


def label_symbols(rows: DataFrame, instruments: DataFrame) -> DataFrame:
    """Instrument key to symbol name, the key itself when unknown.

    No broadcast is forced: the planner broadcasts the dimension only while its
    size is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    names = instruments.select("instrument_key", "symbol")
    return rows.join(names, "instrument_key", "left").withColumn(
        "symbol", F.coalesce("symbol", "instrument_key")
    )


def subscribed_only(rows: DataFrame, instruments: DataFrame) -> DataFrame:
    return rows.join(instruments.select("instrument_key"), "instrument_key", "left_semi")
