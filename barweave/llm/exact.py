"""Exact dedup with a cuckoo-filter index over live digests.

Documents are keyed by the SHA-256 of their text after lower-casing A-Z. An index holds a cuckoo filter (16-bit
fingerprints, buckets of four) next to the stored keys of the same bucket range; a filter hit is verified against the
stored 32-byte key, a full table is doubled and refilled from the stored keys. When a row with a larger doc_id arrives,
the live entry is deleted and the new one inserted. Each input task runs a small index of its own first, so a text that
fills a third of the rows reaches its index partition as one row per task; no text is ever shuffled.

Defined cases: a null text counts as empty; a null doc_id loses against any other, and such rows stay rows of the
result; repeated rows belong to one group, and of rows with the same largest doc_id all count as the kept document's.
Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm.common import lower_ascii, shuffle_parts, stored, table

LOCAL_KEYS = 100_000  # of a task's own index, which is passed on and emptied beyond it
ENTRY = "digest binary, keep_id long, n long"


class CuckooIndex:
    """Cuckoo filter with its stored keys: digest -> (largest doc_id, rows)."""

    SLOTS, MAX_KICKS = 4, 200

    def __init__(self, buckets: int = 1024):
        self.keys: dict[bytes, tuple[int | None, int]] = {}
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.table: list[list[int]] = [[] for _ in range(buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[-2:], "little") | 1 << 16
        first = int.from_bytes(digest[8:16], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def may_hold(self, digest: bytes) -> bool:
        mark, one, two = self._places(digest)
        return mark in self.table[one] or mark in self.table[two]

    def _add_mark(self, digest: bytes) -> bool:
        mark, one, two = self._places(digest)
        for at in (one, two):
            if len(self.table[at]) < self.SLOTS:
                self.table[at].append(mark)
                return True
        at = two
        for kick in range(self.MAX_KICKS):
            bucket = self.table[at]
            bucket[kick % self.SLOTS], mark = mark, bucket[kick % self.SLOTS]
            at = self._other(at, mark)
            if len(self.table[at]) < self.SLOTS:
                self.table[at].append(mark)
                return True
        return False

    def insert(self, digest: bytes, doc_id: int | None, n: int) -> None:
        self.keys[digest] = (doc_id, n)
        if not self._add_mark(digest):
            self._grow()

    def _grow(self) -> None:
        buckets = 2 * (self.mask + 1)
        while True:
            self._clear(buckets)
            if all(map(self._add_mark, self.keys)):
                return
            buckets *= 2

    def delete(self, digest: bytes) -> bool:
        """Takes a live digest out; false if it is not stored."""
        if not self.may_hold(digest) or digest not in self.keys:
            return False
        del self.keys[digest]
        mark, one, two = self._places(digest)
        self.table[one if mark in self.table[one] else two].remove(mark)
        return True

    def offer(self, digest: bytes, doc_id: int | None, n: int) -> None:
        """Adds n rows with this text; the largest doc_id becomes the live one."""
        live = self.keys.get(digest) if self.may_hold(digest) else None
        if live is None:
            self.insert(digest, doc_id, n)
        elif doc_id is None or (live[0] is not None and doc_id <= live[0]):
            self.keys[digest] = (live[0], live[1] + n)
        else:
            self.delete(digest)
            self.insert(digest, doc_id, live[1] + n)

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        values = list(self.keys.values())
        columns = [list(self.keys), [v[0] for v in values], [v[1] for v in values]]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


SCHEMA = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64())])


def _index(limit: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                index.offer(*row)
            if limit and len(index.keys) > limit:
                yield index.batch(SCHEMA)
                index = CuckooIndex()
        if index.keys:
            yield index.batch(SCHEMA)

    return run


def digest_of() -> Column:
    text = lower_ascii(F.coalesce("text", F.lit("")))
    return F.unhex(F.sha2(text.cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of (doc_id, text)."""
    return docs.select("doc_id", digest_of().alias("digest"))


def build_index(keyed: DataFrame, partitions: int | None = None) -> DataFrame:
    """Live entries (digest, keep_id, n) of (doc_id, digest); one index per hash partition of the digests."""
    entries = keyed.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    local = entries.mapInArrow(_index(LOCAL_KEYS), ENTRY)
    return local.repartition(partitions or shuffle_parts(keyed.sparkSession), "digest").mapInArrow(_index(None), ENTRY)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        for digest, doc_id, n, step in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if step == 1:
                index.delete(digest)
            else:
                index.offer(digest, doc_id, n)
    if index.keys:
        yield index.batch(SCHEMA)


def update_index(live: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Live entries after deleting the digests of `removed` and then offering the (doc_id, digest) rows of `added`."""
    steps = live.withColumn("step", F.lit(0))
    steps = steps.unionByName(removed.select("digest", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("step")))
    steps = steps.unionByName(build_index(added).withColumn("step", F.lit(2)))
    parts = shuffle_parts(live.sparkSession)
    return steps.repartition(parts, "digest").sortWithinPartitions("step").mapInArrow(_replay, ENTRY)


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and digest of every row of (doc_id, text)."""
    keyed = stored(digests(docs), "digests")
    live = build_index(keyed)
    # adaptive execution splits the partition of a digest that many rows share
    return keyed.join(live, "digest").select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )


def largest_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without exact copies: of equal texts one row with the largest doc_id stays."""
    kept = exact_groups(docs.select("doc_id", "text")).where("kept").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("rows"))
    kept = kept.select(F.struct("doc_id", "digest").alias("key"), "rows")
    marked = docs.select(F.struct("*").alias("row"), F.struct("doc_id", digest_of().alias("digest")).alias("key"))
    found = marked.join(kept, "key")
    # only rows that repeat with their doc_id have to be grouped
    once = found.where("rows = 1").select("row.*")
    return once.unionByName(found.where("rows > 1").dropDuplicates(["key"]).select("row.*"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
