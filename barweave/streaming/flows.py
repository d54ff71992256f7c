"""Structured Streaming forms of the bar, quote, signal and persistence operators.

State that outlives a batch is kept either by Spark's own aggregation state or as a
small versioned table, one folder per batch, below the shared checkpoint folder.
A repeated batch overwrites its own folders, so a lost executor or a restart from
the checkpoint gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from barweave import params
from barweave.functions import series as s
from barweave.functions.scalar import order_key
from barweave.operators import actionable, bars as b, orderbook, unified
from barweave.operators.serving import latest_quotes
from barweave.plans import cycle
from barweave.session import shared_dir
from barweave.sources.keyed_log import VERSION, KeyedLog, newest_rows
from barweave.sources.monthly_log import MonthlyLog

C = F.col
COMPACT_EVERY = 60  # batches
ALL_VERSIONS = 1 << 62
FRAME_BARS = 200_000  # new bars whose frames, up to a lookback of rows each, are made at a time
SEGMENT_BARS = 4_096  # bars of a symbol that one task rolls its windows over, besides those before them
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Stream of a parquet folder, optionally restricted to matching file names."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_bars(ticks: DataFrame, width: str = "1 minute", *, delay: str) -> DataFrame:
    """Bars of closed windows: a window closes when a tick ``delay`` past its end arrives.

    Later ticks of a closed window are dropped by the watermark; ``run_corrected_bars`` counts
    them and corrects their bars. The tick that closes a window counts in the next one.
    """
    return b.ohlcv_bars(ticks.withWatermark("ts", delay), width)


PART_BAR = (
    "symbol string, ts timestamp, open double, high double, low double, close double, volume bigint, tick_count bigint, "
    "first_tick_time timestamp, last_tick_time timestamp, first_order decimal(38,0), last_order decimal(38,0), end_time timestamp"
)
LATE_LOG = "ticks bigint, late_ticks bigint, late_bars bigint, newest timestamp"


def part_bars(ticks: DataFrame, width: str) -> DataFrame:
    """What some ticks add to their bars, in a form that ``merge_parts`` joins in any cut and order."""
    order = order_key(C("ts"), C("seq"))
    bars = ticks.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("ltp", order).alias("open"), F.max("ltp").alias("high"), F.min("ltp").alias("low"), F.max_by("ltp", order).alias("close"),
        F.sum("ltq").alias("volume"), F.count("*").alias("tick_count"), F.min("ts").alias("first_tick_time"), F.max("ts").alias("last_tick_time"),
        F.min(order).alias("first_order"), F.max(order).alias("last_order"),
    )
    return bars.select(C("w.start").alias("ts"), C("w.end").alias("end_time"), "*").drop("w")


def merge_parts(rows: DataFrame) -> DataFrame:
    """One row per bar; buffers of fixed width keep the aggregation hash-based."""
    return rows.groupBy("symbol", "ts").agg(
        F.min_by("open", "first_order").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "last_order").alias("close"), F.sum("volume").alias("volume"), F.sum("tick_count").alias("tick_count"),
        F.min("first_tick_time").alias("first_tick_time"), F.max("last_tick_time").alias("last_tick_time"),
        F.min("first_order").alias("first_order"), F.max("last_order").alias("last_order"), F.max("end_time").alias("end_time"),
        F.max(VERSION).alias(VERSION),
    )


def run_corrected_bars(
    spark: SparkSession, ticks: DataFrame, width: str = "1 minute", *, delay: str, base: str | None = None,
    trigger: dict | None = None, checkpoint: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Bars that late ticks correct, and per batch how many ticks came late.

    A batch adds the parts of the bars that it touched to a log by month; a reader merges the
    parts of a bar, so a tick may come at any time and costs one row. Nothing is kept in
    memory between batches. Late is a tick of a window that ``stream_bars`` with this ``delay``
    has closed: the window ended at least ``delay`` before the newest tick of earlier batches.
    Ticks without a time belong to no bar and are not counted.
    """
    base = base or shared_dir(spark, "corrected")
    parts, counts = MonthlyLog(spark, f"{base}/parts", PART_BAR, merge_parts), KeyedLog(spark, f"{base}/late", LATE_LOG)

    def handle(batch: DataFrame, batch_id: int) -> None:
        added = part_bars(batch, width).persist()
        parts.write(added, batch_id)
        closed = C("end_time") <= F.lit(counts.read(batch_id).agg(F.max("newest")).first()[0]).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        counts.write(
            added.agg(
                F.coalesce(F.sum("tick_count"), F.lit(0)).alias("ticks"), F.coalesce(F.sum(F.when(closed, C("tick_count"))), F.lit(0)).alias("late_ticks"),
                F.count_if(closed).alias("late_bars"), F.max("last_tick_time").alias("newest"),
            ),
            batch_id,
        )
        added.unpersist()
        if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
            parts.compact(batch_id)
            counts.compact(batch_id, lambda rows: rows)

    run_batches(spark, ticks, handle, "corrected", trigger=trigger, checkpoint=checkpoint)
    bars = parts.read().drop("first_order", "last_order", "end_time", VERSION)
    return bars, counts.read(ALL_VERSIONS).withColumnRenamed(VERSION, "batch")


def stream_dedup(
    ticks: DataFrame, keys: tuple[str, ...] = ("symbol", "ts", "ltp", "ltq"), delay: str = "10 minutes"
) -> DataFrame:
    """Drop repeats of a trade that arrive within ``delay`` of each other."""
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def run_to_table(
    spark: SparkSession, stream: DataFrame, label: str, out: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Process what is available, append to a parquet table and return it."""
    out, checkpoint = out or shared_dir(spark, label), checkpoint or shared_dir(spark, f"{label}-state")
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(spark: SparkSession, stream: DataFrame, handle, label: str, mode: str = "append",
                trigger: dict | None = None, checkpoint: str | None = None):
    """Run ``handle(batch, batch_id)`` per micro-batch; the default trigger drains the source."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint or shared_dir(spark, f"{label}-state"))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    query.awaitTermination()
    return query


def run_latest_quotes(
    spark: SparkSession, quotes: DataFrame, out: str | None = None, checkpoint: str | None = None, trigger: dict | None = None
) -> DataFrame:
    """Last quote per symbol, kept by streaming aggregation in update mode.

    Each batch writes only the symbols it changed to a log by symbol, which is folded to one
    row a symbol every ``COMPACT_EVERY`` batches; the reader takes a symbol's newest row.
    """
    latest = latest_quotes(quotes)
    log = KeyedLog(spark, out or shared_dir(spark, "quotes"), latest.schema)

    def handle(batch: DataFrame, batch_id: int) -> None:
        log.write(batch, batch_id)
        if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
            log.compact(batch_id, newest_rows("symbol"))

    run_batches(spark, latest, handle, "quotes", mode="update", trigger=trigger, checkpoint=checkpoint)
    return log.newest(ALL_VERSIONS, "symbol")


def _versioned(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """State table of the previous batch; None before the first."""
    return spark.read.parquet(f"{path}/batch={batch_id - 1}") if batch_id > 0 else None


def _merge_state(old: DataFrame | None, new: DataFrame) -> DataFrame:
    if old is None:
        return new
    rows = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return rows.groupBy("symbol").agg(F.max_by("committed", "_v").alias("committed"))


def run_persistence(
    spark: SparkSession, decisions: DataFrame, out: str | None = None, state: str | None = None,
    trigger: dict | None = None, checkpoint: str | None = None,
) -> DataFrame:
    """Persistence rule over a stream of raw decisions.

    The committed direction per symbol is a small table carried from batch to batch;
    inside a batch the rule runs as the batch operator, so no keyed Python state is
    needed and a busy symbol still spreads over segments.
    """
    out, state = out or shared_dir(spark, "decisions"), state or shared_dir(spark, "committed")

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        before = _versioned(spark, state, batch_id)
        unified.persistence(batch, state=before).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        after = _merge_state(before, unified.commitments(batch))
        after.write.mode("overwrite").parquet(f"{state}/batch={batch_id}")
        expire(spark, state, batch_id)
        batch.unpersist()

    run_batches(spark, decisions, handle, "persistence", trigger=trigger, checkpoint=checkpoint)
    return spark.read.parquet(out).drop("batch")


BAR_COLUMNS = ("symbol", "ts", "open", "high", "low", "close", "volume")
BAR_LOG = "symbol string, ts timestamp, open double, high double, low double, close double, volume bigint"


def bar_quotes(recent: DataFrame) -> DataFrame:
    """Quotes seeded from the last bar, for symbols whose feed brings no depth."""
    level = "array<struct<price:double,quantity:bigint>>"
    return unified.bootstrap_snapshot(recent).select(
        "symbol", C("last_update").alias("ts"), "ltp", "ltq", "best_bid", "best_ask",
        F.lit(0).cast("bigint").alias("bid_size"), F.lit(0).cast("bigint").alias("ask_size"),
        F.array().cast(level).alias("bid_levels"), F.array().cast(level).alias("ask_levels"),
    )


def bar_snapshots(recent: DataFrame) -> DataFrame:
    """One snapshot per bar, ranked like the bars: the cadence at which a cycle sees prices."""
    zero = F.lit(0).cast("bigint")
    return recent.where(C("rn") <= orderbook.HISTORY_ROWS).select(
        "symbol", "ts", zero.alias("seq"), C("close").alias("ltp"), C("volume").alias("ltq"),
        zero.alias("bid_size"), zero.alias("ask_size"), "rn",
    )


SEPARATOR = "\u0001"


def cycle_frames(before: DataFrame | None, bars: DataFrame, lookback: int, chosen: Column | None = None) -> DataFrame:
    """For every new bar the last ``lookback`` bars of its symbol up to it, keyed by symbol and bar time.

    ``rn`` is 1 for the new bar itself. A bar finds the new bars that it is a frame's row of among its own and the
    next ``lookback - 1`` rows, so a batch makes the rows of its frames and no others, and joins nothing.
    ``chosen`` says of which new bars frames are made (all by default).
    """
    rows = bars.withColumn("_new", F.lit(True) if chosen is None else F.coalesce(chosen, F.lit(False)))
    if before is not None:
        rows = rows.unionByName(before.withColumn("_new", F.lit(False)))
    in_time = Window.partitionBy("symbol").orderBy("ts")
    numbered = rows.where(C("symbol").isNotNull()).withColumn("_i", F.row_number().over(in_time))
    ends = F.collect_list(F.when(C("_new"), F.struct("_i", "ts"))).over(in_time.rowsBetween(Window.currentRow, lookback - 1))
    spread = numbered.withColumn("_ends", ends).withColumn("_end", F.explode("_ends"))
    key = F.concat(C("symbol"), F.lit(SEPARATOR), F.unix_micros("_end.ts"))
    return spread.withColumns({"symbol": key, "rn": C("_end._i") - C("_i") + 1}).select(*BAR_COLUMNS, "rn")


def cycle_decisions(frames: DataFrame, lookback: int) -> DataFrame:
    """Decided rows of each frame, under the symbol and the time of its bar."""
    features = cycle.recent_features(frames, lookback, momentum=False)
    # the quote of a frame is seeded from its last bar only
    book = orderbook.analysis_of(bar_quotes(frames.where("rn = 1")), orderbook.recent_features(bar_snapshots(frames)))
    decided = unified.decide(cycle.component_snapshot(features, book))
    parts = F.split("symbol", SEPARATOR)
    return decided.withColumns({"ts": F.timestamp_micros(parts[1].cast("bigint")), "symbol": parts[0]})


def segments(before: DataFrame | None, bars: DataFrame, lookback: int) -> DataFrame:
    """All bars in time order, cut into segments of ``SEGMENT_BARS`` for each symbol, so that a busy one spreads over tasks.

    A segment begins with the ``lookback - 1`` bars before its own, as far as there are any. ``_kept`` marks the new bars
    of a segment's own; ``symbol`` becomes the segment's key and ``_symbol`` the symbol itself.
    """
    rows = bars.withColumn("_new", F.lit(True))
    if before is not None:
        rows = rows.unionByName(before.withColumn("_new", F.lit(False)))
    in_time = Window.partitionBy("symbol").orderBy("ts")
    numbered = rows.where(C("symbol").isNotNull()).withColumn("_i", F.row_number().over(in_time) - 1)
    own = F.floor(C("_i") / SEGMENT_BARS)
    also = F.when(C("_i") % SEGMENT_BARS > SEGMENT_BARS - lookback, own + 1)
    spread = numbered.withColumn("_segment", F.explode(F.array_compact(F.array(own, also))))
    key = F.concat(C("symbol"), F.lit(SEPARATOR), C("_segment"))
    return spread.withColumns({"_symbol": C("symbol"), "symbol": key, "_kept": C("_new") & (C("_segment") == own)}).select(
        *BAR_COLUMNS, "_symbol", "_kept"
    )


ROLLED = (
    "ts", "close", "high", "low", "volume", "prev_close", "i", "n_rows", "sma_5", "sma_20", "sma_50", "rsi", "atr",
    "signal_confidence", "overall_signal", "reasons", "market_regime", "vol_score", "final_score", "recommendation",
    "trajectory_status", "overall_trajectory", "trend_consistency", "acceleration",
)


def rolling_decisions(before: DataFrame | None, bars: DataFrame, lookback: int) -> DataFrame:
    """``cycle_decisions`` of the frames of all new bars, without a copy of a bar for each frame that it is in."""
    zero, level = F.lit(0).cast("bigint"), "array<struct<price:double,quantity:bigint>>"
    rows = segments(before, bars, lookback)
    # the snapshots are those of ``bar_snapshots``
    snapshots = {"ltp": C("close"), "ltq": C("volume"), "bid_size": zero, "ask_size": zero, "prev_ltp": s.lag("close")}
    rows = rows.withColumns(snapshots | {"i": F.row_number().over(s.by_time()) - 1})
    flow = orderbook.rolling_windows()
    rows = rows.withColumns(flow).drop(*snapshots, "i")
    basics = actionable.basic_signal(cycle.rolling_features(rows, lookback, C("_kept")))
    # and the quote is that of ``bar_quotes``, seeded from the bar itself
    quotes = basics.where(C("close") > 0).select(
        C("_symbol").alias("symbol"), *ROLLED, *flow, C("ts").alias("quote_ts"), C("close").alias("ltp"), F.coalesce("volume", zero).alias("ltq"),
        C("close").alias("best_bid"), C("close").alias("best_ask"), F.array().cast(level).alias("bid_levels"),
        F.array().cast(level).alias("ask_levels"),
    )
    book = orderbook.analysis_in_place(quotes).withColumns({"spread_pct": C("spread_percentage"), "has_bars": F.lit(True)})
    return unified.decide(cycle.component_rows(book))


def write_decisions(before: DataFrame, bars: DataFrame, lookback: int, path: str) -> DataFrame:
    """Decided rows of all new bars as a table: rolled over each symbol, or where a lookback is too short or too long
    for that (``cycle.rolls``) made from frames, about ``FRAME_BARS`` of them at a time.

    A step's frames leave the disk before the next one begins, so a backlog takes no more room than one step. Whatever
    needs the rows reads the table: a broadcast made from them must not compute the models within its timeout. So
    nothing is broadcast by size in here either; the sides share their partitioning and need no other shuffle.
    """
    conf, rolled = bars.sparkSession.conf, cycle.rolls(lookback)
    steps = 1 if rolled else max(1, -(-bars.count() // FRAME_BARS))
    wanted = {SHUFFLE_CLEANUP: "true", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    kept = {name: conf.get(name) for name in wanted}
    for name, value in wanted.items():
        conf.set(name, value)
    try:
        for step in range(steps):
            if rolled:
                decided = rolling_decisions(before, bars, lookback)
            else:
                chosen = F.pmod(F.xxhash64("symbol", "ts"), F.lit(steps)) == step
                decided = cycle_decisions(cycle_frames(before, bars, lookback, chosen), lookback)
            decided.write.mode("append" if step else "overwrite").parquet(path)
    finally:
        for name, value in kept.items():
            conf.set(name, value)
    return bars.sparkSession.read.schema(decided.schema).parquet(path)


def expire(spark: SparkSession, path: str, batch_id: int, keep: int = 3) -> None:
    """Drop the version that ``keep`` newer ones have replaced; a restart repeats the last batch only."""
    if batch_id >= keep:
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch_id - keep}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def run_signal_cycles(
    spark: SparkSession, ticks: DataFrame, width: str = "1 minute", delay: str = "0 seconds",
    lookback: int = params.LOOKBACK, base: str | None = None, trigger: dict | None = None,
    checkpoint: str | None = None,
) -> DataFrame:
    """Ticks to closed bars to one signal per symbol and closed bar.

    A batch only carries bars: each new bar is a cycle of its own, so the signals do not
    depend on how the source is cut into batches, and a backlog loses no cycle. For a live
    feed pass ``trigger={"processingTime": "60 seconds"}``. Bars and commitments are logs
    by symbol: a batch reads what is kept of the symbols that ticked and writes their new
    bars and commitments only; every ``COMPACT_EVERY`` batches the logs are folded to the
    last ``lookback`` bars and the last commitment of each symbol.
    """
    base = base or shared_dir(spark, "cycles")
    recent = KeyedLog(spark, f"{base}/recent", BAR_LOG)
    commits = KeyedLog(spark, f"{base}/committed", "symbol string, committed int")
    out = f"{base}/signals"

    def handle(batch: DataFrame, batch_id: int) -> None:
        bars = batch.select(*BAR_COLUMNS).persist()
        ticking = bars.select("symbol").distinct()
        before = b.recent_bars(recent.read(batch_id).join(ticking, "symbol", "left_semi"), lookback).select(*BAR_COLUMNS)
        committed = commits.newest(batch_id, "symbol").join(ticking, "symbol", "left_semi")
        decided = write_decisions(before, bars, lookback, f"{base}/decided/batch={batch_id}")
        signals = unified.finish(unified.persistence(decided, state=committed))
        signals.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        recent.write(bars, batch_id)
        commits.write(unified.commitments(decided), batch_id)
        if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
            recent.compact(batch_id, lambda rows: b.recent_bars(rows, lookback))
            commits.compact(batch_id, newest_rows("symbol"))
        expire(spark, f"{base}/decided", batch_id, keep=1)
        bars.unpersist()

    run_batches(spark, stream_bars(ticks, width, delay=delay), handle, "signals", trigger=trigger, checkpoint=checkpoint)
    return spark.read.parquet(out).drop("batch")
