"""State of many keys as a log of versions, each of which holds only what it changed.

A version is a folder of its own, so a repeated batch replaces its rows and a batch with
one busy key writes that key only. Readers take the newest complete base and the versions
after it. ``compact`` writes a new base from them and only then drops what the base before
the last one replaced: whichever step a job is stopped at, nothing is lost, and a batch
that is repeated still finds the versions it was computed from.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

VERSION = "version"


class KeyedLog:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str):
        self.spark, self.path = spark, path.rstrip("/")
        fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.schema = T.StructType([*fields.fields, T.StructField(VERSION, T.LongType())])

    def _folder(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _complete(self, kind: str) -> list[int]:
        """Numbers of the complete folders ``kind=N``, ascending."""
        fs, path = self._folder()
        if not fs.exists(path):
            return []
        found = [re.fullmatch(rf"{kind}=(\d+)", s.getPath().getName()) for s in fs.listStatus(path)]
        numbers = sorted(int(m[1]) for m in found if m)
        return [n for n in numbers if fs.exists(self._folder(f"{kind}={n}/_SUCCESS")[1])]

    def write(self, rows: DataFrame, version: int) -> None:
        """The rows that changed in ``version``; replaces what an earlier try of it left."""
        names = [f.name for f in self.schema.fields[:-1]]
        rows.select(*names, F.lit(version).cast("long").alias(VERSION)).write.mode("overwrite").parquet(f"{self.path}/version={version}")

    def read(self, before: int) -> DataFrame:
        """Rows of all versions below ``before``, with their version."""
        bases = [n for n in self._complete("base") if n < before]
        base = bases[-1] if bases else -1
        folders = [f"base={base}"] * bool(bases) + [f"version={n}" for n in self._complete("version") if base < n < before]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def newest(self, before: int, key: str) -> DataFrame:
        """The newest row of each key, where a version holds one row of a key at most."""
        return newest_rows(key)(self.read(before)).drop(VERSION)

    def compact(self, version: int, kept: Callable[[DataFrame], DataFrame]) -> None:
        """Folds everything up to ``version`` into a base of the rows that ``kept`` leaves."""
        older = self._complete("base")
        names = [f.name for f in self.schema.fields]
        kept(self.read(version + 1)).select(*names).write.mode("overwrite").parquet(f"{self.path}/base={version}")
        done = [n for n in older if n < version]
        if done:
            for kind in ("version", "base"):
                for n in self._complete(kind):
                    if n < done[-1] or (kind == "version" and n == done[-1]):
                        fs, path = self._folder(f"{kind}={n}")
                        fs.delete(path, True)


def newest_rows(key: str) -> Callable[[DataFrame], DataFrame]:
    """For ``compact``: the newest version's row of each key; rows without a key are one key."""

    def kept(rows: DataFrame) -> DataFrame:
        latest = rows.groupBy(F.col(key).alias("_key")).agg(F.max(VERSION).alias("_newest"))
        return rows.join(latest, F.col(key).eqNullSafe(F.col("_key")) & (F.col(VERSION) == F.col("_newest")), "left_semi")

    return kept
