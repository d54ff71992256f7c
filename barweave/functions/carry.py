"""Last value before a row, over histories of any length.

A plain ``last(...).over(partitionBy(key).orderBy(ts))`` puts a whole key into one
task. Here the order of a busy key is cut into segments at marks taken from the rows
themselves, so a segment has about ``segment_rows`` rows however they lie in time:

1. A sample of the rows by hash, of which only key and order are read, gives the marks:
   every ``MARKS``-th sampled row of a key. Keys with fewer rows than a segment have none.
2. Each row finds its segment by binary search among its key's marks, and one window runs
   inside (key, segment). This is the only time that the rows are shuffled.
3. Keys with marks reduce every segment to its last value; the short list of segments is
   scanned, and a segment's first rows take what it inherits.

Marks and inherited values have one entry for ``segment_rows`` rows (10**12 rows: 250,000
entries, about 10 MB), which is what is broadcast. Where no key has marks, adaptive
execution finds both empty and leaves the third step out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barweave import params
from barweave.functions.scalar import order_key

MARKS = 64  # sampled rows of a segment
UNTIMED_PARTS = 1024  # rows without a time need no order and are spread


def _known(key: str) -> dict[str, Column]:
    """The key as two columns without nulls, to join by plain equality."""
    return {"_key": F.coalesce(F.col(key).cast("string"), F.lit("")), "_keyless": F.col(key).isNull()}


def segment_marks(rows: DataFrame, key: str, ts: str, seq: str, segment_rows: int) -> DataFrame:
    """_key, _keyless and the sorted order keys (``_marks``) that cut a busy key into segments."""
    every = max(1, segment_rows // MARKS)
    sampled = rows.where(F.pmod(F.xxhash64(key, ts, seq), F.lit(every)) == 0).where(F.col(ts).isNotNull())
    sampled = sampled.select(*[c.alias(n) for n, c in _known(key).items()], order_key(F.col(ts), F.col(seq)).alias("_mark"))
    place = F.row_number().over(Window.partitionBy("_key", "_keyless").orderBy("_mark"))
    chosen = sampled.withColumn("_place", place).where(F.col("_place") % MARKS == 0)
    return chosen.groupBy("_key", "_keyless").agg(F.array_sort(F.collect_list("_mark")).alias("_marks"))


def _marks_before(marks: Column, order: Column) -> Column:
    """Number of sorted marks below ``order``."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(20))])

    def further(place: Column, step: Column) -> Column:
        found = (place + step <= F.size(marks)) & (F.get(marks, place + step - 1) < order)
        return F.when(found, place + step).otherwise(place)

    return F.aggregate(steps, F.lit(0), further)


def carry_last(
    df: DataFrame,
    key: str,
    ts: str,
    seq: str,
    value: str,
    out: str,
    ties: Sequence[str] = (),
    segment_rows: int = params.SEGMENT_ROWS,
) -> DataFrame:
    """Add ``out``: the last non-null ``value`` of the key strictly before the row.

    Rows are ordered by (ts, seq, ties); ``seq`` must be integral and (ts, seq)
    unique per key unless ``ties`` settles the rest. No row is lost: rows without a
    key form one key, and a row without a time has no place in the order, so it
    inherits nothing and passes nothing on.
    """
    order = order_key(F.col(ts), F.col(seq))
    marks = F.broadcast(segment_marks(df, key, ts, seq, segment_rows))
    untimed = -1 - F.pmod(F.xxhash64(seq), F.lit(UNTIMED_PARTS)).cast("int")
    segment = F.when(F.col(ts).isNull(), untimed).when(F.col("_marks").isNull(), 0).otherwise(_marks_before(F.col("_marks"), order))

    known = df.withColumns(_known(key))
    rows = known.join(marks, ["_key", "_keyless"], "left").withColumn("_segment", segment).drop("_marks")
    before = F.last(value, ignorenulls=True).over(
        Window.partitionBy(key, "_segment").orderBy(ts, seq, *ties).rowsBetween(Window.unboundedPreceding, -1)
    )
    found = rows.withColumn(out, F.when(F.col(ts).isNotNull(), before))

    busy = known.where(F.col(ts).isNotNull()).join(marks, ["_key", "_keyless"]).withColumn("_segment", segment)
    last = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), order))
    tails = busy.groupBy("_key", "_keyless", "_segment").agg(last.alias("_tail"))
    earlier = Window.partitionBy("_key", "_keyless").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    inherited = tails.select("_key", "_keyless", "_segment", F.last("_tail", ignorenulls=True).over(earlier).alias("_inherited"))
    return (
        found.join(F.broadcast(inherited), ["_key", "_keyless", "_segment"], "left")
        .withColumn(out, F.coalesce(out, "_inherited"))
        .drop("_key", "_keyless", "_segment", "_inherited")
    )
