"""Exact percentiles of unbounded histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

RANGES = 64


def percentiles(df: DataFrame, key: str, value: str, shares: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """Linear percentiles of ``value`` per key, one column for each name and share in 0..1.

    Equal values are counted before the shuffle. A key is cut into ``ranges`` equal
    parts of its value range; ranks run inside a part and are moved up by the counts of
    the parts below, so no buffer holds a whole key. NULL and NaN values take no part.
    """
    x = F.col(value)
    counts = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(F.col(key).alias("_key"), x.alias("_x")).agg(F.count("*").alias("_n"))
    bounds = counts.groupBy(F.col("_key").alias("_of")).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    width = F.nullif(F.col("_high") / ranges - F.col("_low") / ranges, F.lit(0.0))
    part = F.least(F.lit(ranges - 1), F.floor((F.col("_x") - F.col("_low")) / width)).cast("int")
    parted = counts.join(bounds, F.col("_key").eqNullSafe(F.col("_of"))).select("_key", "_x", "_n", F.coalesce(part, F.lit(0)).alias("_part"))
    below = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_key")
    sizes = parted.groupBy("_key", "_part").agg(F.sum("_n").alias("_size"))  # at most ``ranges`` rows a key
    sizes = sizes.select(
        F.col("_key").alias("_of"), F.col("_part").alias("_at"), F.coalesce(F.sum("_size").over(below), F.lit(0)).alias("_before"),
        F.sum("_size").over(whole).alias("_total"),
    )
    same = F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_at"))
    inside = Window.partitionBy("_key", "_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = parted.withColumn("_upto", F.sum("_n").over(inside)).join(sizes, same)
    ranked = ranked.withColumn("_upto", F.col("_upto") + F.col("_before"))
    picks = []
    for name, share in shares.items():
        spot = (F.col("_total") - 1) * share
        picks += [F.min(F.when(F.col("_upto") > f(spot), F.col("_x"))).alias(f"{name}_{side}") for side, f in (("low", F.floor), ("high", F.ceil))]
    found = ranked.groupBy("_key", "_total").agg(*picks)
    spots = {name: (F.col("_total") - 1) * share for name, share in shares.items()}
    return found.select(
        F.col("_key").alias(key),
        *[(F.col(f"{n}_low") + (s - F.floor(s)) * (F.col(f"{n}_high") - F.col(f"{n}_low"))).alias(n) for n, s in spots.items()],
    )
