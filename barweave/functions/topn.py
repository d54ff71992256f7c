"""Latest-n per key without sending a whole key to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_n(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str = "rn",
    splits: int = 1,
) -> DataFrame:
    """Keep the first ``n`` rows of each key in ``order`` and number them 1..n.

    ``rank <= n`` lets Catalyst add a WindowGroupLimit below the shuffle, so each
    map task ships at most n rows per key. With ``splits`` > 1 the key is ranked
    in that many parts first: use it on raw tables, where the number of map tasks
    grows with the data and one hot key would still meet in a single task. A row
    among the first n of its key is among the first n of its part whatever the
    parts are, so the input partition decides: nothing has to be computed or hashed
    for it, and equal rows of a hot key spread as well.
    """
    if splits > 1:
        part = F.spark_partition_id() % splits
        w = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = (
            df.withColumn("_part", part)
            .withColumn("_r", F.row_number().over(w))
            .where(F.col("_r") <= n)
            .drop("_part", "_r")
        )
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
