"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
# a word is a run of digits, letters a-z and characters beyond ASCII, after lower-casing A-Z
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; nothing else changes."""
    return F.translate(text, UPPER, LOWER)


def quoted(name: str) -> str:
    """A column name as it stands in expressions: names may hold dots, spaces and backquotes."""
    return "`" + name.replace("`", "``") + "`"


ROW = ["row1", "row2"]


def row_keys() -> tuple[Column, Column]:
    """Two hashes of doc_id and text that name a row; equal rows share them."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return F.xxhash64("doc_id", text, F.lit(1)).alias("row1"), F.xxhash64(text, "doc_id", F.lit(2)).alias("row2")


def one_of_equal(joined: DataFrame) -> DataFrame:
    """One of the rows that share (row1, row2); right after a shuffled join by them this needs no other shuffle or sort."""
    copy = F.row_number().over(Window.partitionBy(*ROW).orderBy(*ROW))
    return joined.withColumn("copy_number", copy).where("copy_number = 1").drop("copy_number")


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; a temporary one only where it is unset on a one-machine master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="barweave-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    The shuffle files behind it go as soon as it is written, not when the driver next collects garbage.
    """
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`stored`, and the folder for `discard`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Drops stored tables that nothing reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def whole_texts(docs: DataFrame) -> DataFrame:
    """`docs`, after lowering the rows per Arrow batch if the session leaves them at the default of 10,000.

    Whole texts are large values; a default batch of them takes tens of megabytes on both sides of every task.
    """
    conf = docs.sparkSession.conf
    if conf.get(ARROW_ROWS) == "10000":
        conf.set(ARROW_ROWS, "1000")
    return docs


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, for steps that make large values of each row."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)
    release_memory()


def release_memory() -> None:
    """Gives freed memory back to the machine at the end of a task: workers live on for the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def byte_chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(first column, texts of the second) in runs of rows that have about `limit` bytes of text; a longer text stays whole."""
    for batch in batches:
        texts, first, size = batch.column(1).to_pylist(), 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= limit or i + 1 == len(texts):
                yield batch.column(0).slice(first, i + 1 - first), texts[first : i + 1]
                first, size = i + 1, 0
    release_memory()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[0x00:0x30] = _IS_WORD[0x3A:0x61] = _IS_WORD[0x7B:0x80] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PIECE = 1 << 20
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold_bytes(text: bytes) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _FOLD[np.frombuffer(text, np.uint8)]


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and the byte after the last of each word of lower-cased bytes."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _IS_WORD[raw]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(text: bytes, prefixes: tuple[int, ...] = (0,)) -> list[np.ndarray]:
    """64-bit hashes of the words of a UTF-8 text in order, one array for each of `prefixes`.

    0 hashes whole words, n > 0 only their first n bytes (shorter words whole).
    """
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return [np.zeros(0, np.uint64) for _ in prefixes]
    raw = _FOLD[raw]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _IS_WORD[raw]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    out = [np.empty(len(start), np.uint64) for _ in prefixes]
    first = 0
    while first < len(start):  # long texts go in pieces that end between words
        last = max(first + 1, int(np.searchsorted(start, start[first] + _PIECE)))
        at, part = start[first], raw[start[first] : end[last - 1]]
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        a, whole = start[first:last] - at, end[first:last] - at
        for hashes, prefix in zip(out, prefixes, strict=True):
            b = np.minimum(whole, a + prefix) if prefix else whole
            hashes[first:last] = mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        first = last
    return out
