"""File sources and sinks: instruments, candle documents, bar tables, signal history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barweave import params, schemas
from barweave.functions.scalar import clean_name
from barweave.functions.topn import latest_n
from barweave.sources.keyed_log import VERSION
from barweave.sources.monthly_log import MONTH, MonthlyLog


def read_instruments(spark: SparkSession, path: str) -> DataFrame:
    """Instrument list document ``{"symbols": [{name, instrument_key}, ...]}``."""
    docs = spark.read.schema(schemas.INSTRUMENTS).json(path, multiLine=True)
    return instruments(docs.select(F.explode("symbols").alias("s")).select("s.name", "s.instrument_key"))


def parse_instruments(docs: DataFrame, column: str = "value") -> DataFrame:
    """The same from a text column holding one document per row."""
    parsed = docs.select(F.from_json(column, schemas.INSTRUMENTS).alias("d"))
    return instruments(
        parsed.select(F.explode("d.symbols").alias("s")).select("s.name", "s.instrument_key")
    )


def instruments(named: DataFrame) -> DataFrame:
    return named.select(
        "instrument_key", F.col("name").alias("symbol"), clean_name(F.col("name")).alias("clean_name")
    )


def parse_candles(
    docs: DataFrame, key: str = "symbol", column: str = "candles", z_is_ist: bool = True
) -> DataFrame:
    """JSON candle arrays ``[ts, open, high, low, close, volume?]`` to bars.

    Malformed candles and candles with a price that is no positive number are skipped.
    A missing volume is 0, a fractional one is truncated, text that is no number
    makes the candle malformed. With ``z_is_ist`` a trailing ``Z`` means +05:30, which is how the
    candle source writes exchange time.
    """
    c = docs.select(key, F.explode(F.from_json(column, schemas.CANDLES)).alias("c"))

    def at(i):
        return F.try_element_at("c", F.lit(i))

    stamp = at(1)
    if z_is_ist:
        stamp = F.when(
            stamp.endswith("Z"), F.concat(F.expr("substring(c[0], 1, length(c[0]) - 1)"), F.lit("+05:30"))
        ).otherwise(stamp)
    out = c.where(F.size("c") >= 5).select(
        F.col(key).alias("symbol"),
        F.try_to_timestamp(stamp).alias("ts"),
        *[
            at(i).try_cast("double").alias(n)
            for i, n in enumerate(("open", "high", "low", "close"), start=2)
        ],
        F.when(F.size("c") > 5, at(6).try_cast("double").try_cast("bigint")).otherwise(F.lit(0)).alias("volume"),
    )
    return valid_bars(out.where(F.col("ts").isNotNull() & F.col("volume").isNotNull()))


def valid_bars(bars: DataFrame) -> DataFrame:
    """Keep bars whose four prices are all positive; a missing volume is 0.

    NaN compares above every number in Spark but is no price.
    """
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    positive = [(p > 0) & ~F.isnan(p) for p in prices]
    return bars.where(positive[0] & positive[1] & positive[2] & positive[3]).withColumn("volume", F.coalesce("volume", F.lit(0)))


def read_bars(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """Time range of a stored bar table; the range also prunes the ``month`` partitions."""
    bars = spark.read.parquet(path)
    if start is not None:
        first = F.date_format(F.lit(start).cast("timestamp"), MONTH)
        bars = bars.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("month") >= first))
    if end is not None:
        last = F.date_format(F.lit(end).cast("timestamp"), MONTH)
        bars = bars.where((F.col("ts") <= F.lit(end).cast("timestamp")) & (F.col("month") <= last))
    return bars.select(*[f.name for f in schemas.BAR.fields])


def write_bars(bars: DataFrame, path: str) -> None:
    """Store bars by month, symbols sorted in each file so that row groups can be skipped.

    Only the months present in ``bars`` are replaced. The rebalance hint leaves file
    sizes to adaptive execution: small months share a task, a busy month is split
    over several, whatever symbol fills it.
    """
    (
        bars.withColumn("month", F.date_format("ts", MONTH))
        .hint("rebalance", "month")
        .sortWithinPartitions("month", "symbol", "ts")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("month")
        .parquet(path)
    )


def upsert_bars(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Later write wins per (symbol, ts)."""
    rows = existing.withColumn("_load", F.lit(0)).unionByName(new.withColumn("_load", F.lit(1)))
    fields = ("open", "high", "low", "close", "volume")
    # max_by on the same ordering picks the same row for every field, and primitive
    # buffers keep the aggregation hash-based.
    return rows.groupBy("symbol", "ts").agg(*[F.max_by(f, "_load").alias(f) for f in fields])


def store_bars(spark: SparkSession, path: str, new: DataFrame) -> int:
    """Upsert into a stored log of bars: the load is added, later loads win when the log is read.

    Nothing that is stored is touched, so a job that fails while writing or committing
    loses no bar. Returns the number of the load; see ``MonthlyLog.compact``.
    """
    return MonthlyLog(spark, path).append(new)


def read_stored_bars(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """Time range of a stored log of bars; months outside the range are pruned."""
    return MonthlyLog(spark, path).read(None, start, end).drop(VERSION)


def append_signal_history(signals: DataFrame, path: str, batch: str) -> None:
    """Add a batch to the history; the cap is applied when reading.

    A batch owns its folder below ``path``, so a repeated job replaces its own rows and
    never adds them twice. Rows are rebalanced by month: a month gets few files however
    many tasks made the signals.
    """
    (
        signals.withColumn("month", F.date_format("updated_at", MONTH))
        .hint("rebalance", "month")
        .write.mode("overwrite")
        .partitionBy("month")
        .parquet(f"{path.rstrip('/')}/batch={batch}")
    )


def capped_history(history: DataFrame, limit: int = params.HISTORY_LIMIT, splits: int = params.HOT_KEY_SPLITS) -> DataFrame:
    """Newest ``limit`` signals of each symbol."""
    order = [F.col("updated_at").desc()]
    if "seq" in history.columns:
        order.append(F.col("seq").desc())
    return latest_n(history, ["symbol"], order, limit, splits=splits)
