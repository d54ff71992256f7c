"""Bars of many symbols as a log of loads, split by month.

A load only adds a folder, so a job that is stopped while it writes or commits leaves every
earlier row where it was, and a load costs its own rows whatever the months hold already.
Rows of a bar that several loads touched are merged when they are read. Months that one
folder holds are read as they lie, without a shuffle; ``compact`` brings the others back to
that form, month by month, and drops replaced folders one compaction later, so that readers
and repeated jobs still find them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from barweave import schemas
from barweave.sources.keyed_log import VERSION, KeyedLog

MONTH = "yyyyMM"
NO_MONTH = "none"  # rows without a time


def month_of(ts: str = "ts") -> F.Column:
    return F.coalesce(F.date_format(ts, MONTH), F.lit(NO_MONTH))


def newest_bar(rows: DataFrame) -> DataFrame:
    """The bar of the latest load; fixed-width buffers keep the aggregation hash-based."""
    fields = [c for c in rows.columns if c not in ("symbol", "ts", VERSION)]
    return rows.groupBy("symbol", "ts").agg(*[F.max_by(c, VERSION).alias(c) for c in fields], F.max(VERSION).alias(VERSION))


class MonthlyLog(KeyedLog):
    """``merge`` turns the rows of a bar from several loads into one, and keeps the columns."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str = schemas.BAR,
                 merge: Callable[[DataFrame], DataFrame] = newest_bar):
        super().__init__(spark, path, schema)
        self.merge = merge

    def _put(self, rows: DataFrame, folder: str) -> None:
        (
            rows.select(*[f.name for f in self.schema.fields], month_of().alias("month"))
            # file sizes are left to adaptive execution: small months share a task, a busy one is split
            .hint("rebalance", "month")
            .sortWithinPartitions("month", "symbol", "ts")
            .write.mode("overwrite").partitionBy("month").parquet(f"{self.path}/{folder}")
        )

    def _months(self, folder: str) -> list[str]:
        fs, path = self._folder(folder)
        found = [re.fullmatch("month=(.+)", s.getPath().getName()) for s in fs.listStatus(path)]
        return [m[1] for m in found if m]

    def _folders(self) -> list[tuple[int, str]]:
        """(number, folder name) of the complete folders; a base follows the version of its number."""
        found = [(n, 0, f"version={n}") for n in self._complete("version")] + [(n, 1, f"base={n}") for n in self._complete("base")]
        return [(n, name) for n, _, name in sorted(found)]

    def live(self, before: int | None = None) -> dict[str, list[str]]:
        """Folders that hold the rows of each month: its newest base and the versions after it."""
        months: dict[str, list[str]] = defaultdict(list)
        for n, name in self._folders():
            if before is None or n < before:
                for month in self._months(name):
                    months[month] = [name] if name.startswith("base") else [*months[month], name]
        return dict(months)

    def next_version(self) -> int:
        """One above the newest complete folder: a load that was stopped is replaced by its repetition."""
        return max((n for n, _ in self._folders()), default=-1) + 1

    def write(self, rows: DataFrame, version: int) -> None:
        """The bars of one load, each of them once; replaces what an earlier try of it left."""
        self._put(rows.withColumn(VERSION, F.lit(version).cast("long")), f"version={version}")

    def append(self, rows: DataFrame) -> int:
        version = self.next_version()
        self.write(rows.dropDuplicates(["symbol", "ts"]), version)
        return version

    def _rows(self, months: dict[str, list[str]]) -> DataFrame:
        """Rows of the given months from the folders named for them."""
        of: dict[str, list[str]] = defaultdict(list)
        for month, names in months.items():
            for name in names:
                of[name].append(month)
        fields = T.StructType([*self.schema.fields, T.StructField("month", T.StringType())])
        parts = [self.spark.read.schema(fields).parquet(f"{self.path}/{name}").where(F.col("month").isin(*some)) for name, some in of.items()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], fields)

    def _merged(self, months: dict[str, list[str]], ranged: Callable[[DataFrame], DataFrame]) -> DataFrame:
        plain = {m: names for m, names in months.items() if len(names) == 1}
        shared = {m: names for m, names in months.items() if len(names) > 1}
        columns = [f.name for f in self.schema.fields]
        rows = ranged(self._rows(plain)).select(*columns)
        return rows.unionByName(self.merge(ranged(self._rows(shared)).select(*columns)).select(*columns)) if shared else rows

    def read(self, before: int | None = None, start=None, end=None) -> DataFrame:
        """Merged rows of a time range; months outside it are not listed in the scan."""

        def ranged(rows: DataFrame) -> DataFrame:
            for bound, after in ((start, True), (end, False)):
                if bound is not None:
                    at = F.lit(bound).cast("timestamp")
                    month = F.date_format(at, MONTH)
                    rows = rows.where(((F.col("ts") >= at) & (F.col("month") >= month)) if after else ((F.col("ts") <= at) & (F.col("month") <= month)))
            return rows

        return self._merged(self.live(before), ranged)

    def compact(self, version: int) -> None:
        """Merges the months that several folders hold, up to ``version``, into one base folder."""
        shared = {m: names for m, names in self.live(version + 1).items() if len(names) > 1}
        if not shared:
            return
        self._put(self._merged(shared, lambda rows: rows), f"base={version}")
        bases: dict[str, list[int]] = defaultdict(list)
        for n in self._complete("base"):
            for month in self._months(f"base={n}"):
                bases[month].append(n)
        for n, name in self._folders():
            for month in self._months(name):
                kept = bases[month][-2] if len(bases[month]) > 1 else -1
                if n < kept or (n == kept and name.startswith("version")):
                    fs, path = self._folder(f"{name}/month={month}")
                    fs.delete(path, True)
