"""Benchmark decontamination by winnowing.

A window is `WINDOW` consecutive words of a benchmark item, or the whole of a shorter item. Texts that share a span of t
words have to share a fingerprint: with k-grams of k = ceil(t / 2) words, the least k-gram hash (the rightmost of equal
ones) of every t - k + 1 consecutive k-grams is kept, and this choice depends on the span alone. The steps:

1. Every window of the items has one fingerprint; a bitmap of all of them, of bounded size, goes to the tasks.
2. One pass over the documents winnows each text once for every window length that occurs among the items, and keeps the
   fingerprints that the bitmap lets through with the words around them, as far as a window can reach.
3. These meet the items' fingerprints in a join, which takes out what the bitmap let through by chance.
4. Hits are extended to every window that holds them, and the windows' words are compared with the items' windows.
5. Documents with the same windows share one list of items, which is folded in order without being gathered.

A window that many items share is one row for the documents: windows of equal item sets form a class, named by a hash of
the set, so no pairs of documents and items are made before the lists of step 5.

Defined cases: a null or empty text has no words and no hits; texts of any length are read whole. Repeated rows of
documents are judged row by row. Rows with the same item_id are one item with the windows of each; a null item_id counts
as the item ``''``. Items without words have no window. An empty benchmark leaves every document clean, and no documents
give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from barweave.llm.common import byte_chunks, fold_bytes, mix64, shuffle_parts, stored, table, whole_texts, word_hashes, word_spans

WINDOW = 10
BITS_PER_FINGERPRINT = 16
MAX_BITS = 1 << 27  # 16 MB; more fingerprints let more through to the join, which stays exact
CHUNK_BYTES = 8 << 20  # of texts winnowed together
_STEP = np.uint64(0x9E3779B97F4A7C15)
HIT = "struct<t: int, fp: long, first: long, windows: int, context: string>"


def winnow(hashes: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of the fingerprint of every t consecutive words, by the words' hashes in order."""
    k = (t + 1) // 2
    n, width = len(hashes) - t + 1, t - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.full(n + width - 1, np.uint64(t), np.uint64)
    for i in range(k):
        grams = grams * _STEP + hashes[i : i + n + width - 1]
    grams = mix64(grams)
    least, offset = grams[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, width):
        other = grams[i : i + n]
        lower = other <= least
        np.copyto(least, other, where=lower)
        offset[lower] = i
    return offset + np.arange(n), least


def _in_bitmap(bitmap: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
    bit = fingerprints & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, start and end of each word in them, its hash, and the first word of each text (and the end)."""
    joined = b"\n".join(texts)
    raw = fold_bytes(joined)
    start, end = word_spans(raw)
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.concatenate([[0], np.searchsorted(start, ends)])
    return raw, start, end, word_hashes(joined)[0], first


def _hits(texts: list[bytes], lengths: list[int], bitmap: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
    """Number of words and fingerprints that the bitmap lets through, of each text."""
    raw, start, end, hashes, first = _words(texts)
    hits: list[list[dict]] = [[] for _ in texts]
    view = memoryview(raw)
    for t in lengths:
        place, least = winnow(hashes, t)
        at = np.flatnonzero(_in_bitmap(bitmap, least))
        text = np.searchsorted(first, at, "right") - 1
        inside = at + t <= first[text + 1]
        at, text = at[inside], text[inside]
        if not len(at):
            continue
        # consecutive windows with the same fingerprint are one hit
        new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(place[at]) != 0) | (np.diff(text) != 0)])
        run = np.flatnonzero(new)
        windows = np.diff(np.append(run, len(at)))
        for a, n, i in zip(at[run].tolist(), windows.tolist(), text[run].tolist(), strict=True):
            context = b" ".join(view[start[w] : end[w]] for w in range(a, a + n - 1 + t)).decode()
            fp = int(least[a].astype(np.int64))
            hits[i].append({"t": t, "fp": fp, "first": a - int(first[i]), "windows": n, "context": context})
    return np.diff(first), hits


def document_hits(docs: DataFrame, lengths: list[int], bitmap: np.ndarray) -> DataFrame:
    """doc_id, n_words and hits of (doc_id, text)."""
    hit = StructType.fromDDL("hits array<" + HIT + ">")["hits"].dataType
    schema = StructType([docs.schema["doc_id"], StructField("n_words", LongType()), StructField("hits", hit)])
    arrow = pa.list_(pa.struct([("t", pa.int32()), ("fp", pa.int64()), ("first", pa.int64()), ("windows", pa.int32()), ("context", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in byte_chunks(batches, CHUNK_BYTES):
            n_words, hits = _hits(texts, lengths, bitmap)
            yield pa.record_batch([ids, pa.array(n_words, pa.int64()), pa.array(hits, arrow)], names=schema.names)

    return whole_texts(docs).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, schema)


def item_windows(items: DataFrame) -> DataFrame:
    """item, t, fp and win (the words, space-joined) of every window of (item_id, text)."""
    schema = "item string, t int, fp long, win string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in byte_chunks(batches, CHUNK_BYTES // 8):
            raw, start, end, hashes, first = _words(texts)
            view, rows = memoryview(raw), []
            for item, a, b in zip(ids.to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                if a < b:
                    t = min(WINDOW, b - a)
                    least = winnow(hashes[a:b], t)[1].astype(np.int64).tolist()
                    words = [view[start[w] : end[w]] for w in range(a, b)]
                    rows += [(item, t, fp, b" ".join(words[i : i + t]).decode()) for i, fp in enumerate(least)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = (pa.string(), pa.int32(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["item", "t", "fp", "win"])

    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    return whole_texts(items).select(item, F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, schema)


def fingerprint_bitmap(windows: DataFrame) -> np.ndarray:
    """The fingerprints' low bits as a bitmap, `BITS_PER_FINGERPRINT` of them each up to `MAX_BITS` in all."""
    known = windows.select("fp").distinct()
    bits = 1 << 16
    while bits < min(MAX_BITS, BITS_PER_FINGERPRINT * known.count()):
        bits *= 2
    bit = F.col("fp").bitwiseAND(bits - 1)
    mark = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    words = known.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(mark).alias("marks"))
    found = words.toArrow()  # at most MAX_BITS / 64 rows
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[found["at"].to_numpy()] = found["marks"].to_numpy()
    return bitmap.view(np.uint64)


def _pair_hash(*columns: str) -> list:
    return [F.bit_xor(F.xxhash64(*columns, F.lit(seed))) for seed in (1, 2)]


def item_lists(lists: DataFrame) -> DataFrame:
    """set1, set2, n_items and items_sha256 of distinct (set1, set2, item): a running digest over the sorted items."""
    schema = "set1 long, set2 long, n_items long, items_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, digest = None, 0, hashlib.sha256()

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array([x]) for x in (*key, n, digest.hexdigest())], names=["set1", "set2", "n_items", "items_sha256"])

        for batch in batches:
            for *now, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    if n:
                        yield done()
                    key, n, digest = now, 0, hashlib.sha256()
                digest.update((b"," if n else b"") + item.encode())
                n += 1
        if n:
            yield done()

    dealt = lists.repartition(shuffle_parts(lists.sparkSession), "set1", "set2")
    return dealt.sortWithinPartitions("set1", "set2", "item").mapInArrow(run, schema)


def find_contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of (doc_id, text)."""
    windows = stored(item_windows(items), "item-windows")
    lengths = [r.t for r in windows.select("t").distinct().collect()]
    found = document_hits(docs.select("doc_id", "text"), sorted(lengths), fingerprint_bitmap(windows))
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "winnowed")

    hits = found.select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    hits = hits.join(windows.select("fp").distinct(), "fp", "left_semi")
    words, i = F.split("context", " "), F.col("i")
    extended = hits.select("row", "t", "first", words.alias("words"), F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("i"))
    extended = extended.select("row", (F.col("first") + i).alias("first"), (F.col("first") + i + F.col("t")).alias("after"), F.array_join(F.slice("words", i + 1, F.col("t")), " ").alias("win"))

    holders = windows.select("win", "item").distinct()
    classes = holders.groupBy("win").agg(*(h.alias(c) for h, c in zip(_pair_hash("item"), ("class1", "class2"), strict=True)))
    matched = stored(extended.join(classes, "win").select("row", "first", "after", "class1", "class2"), "matched")

    earlier = Window.partitionBy("row").orderBy("first", "after").rowsBetween(Window.unboundedPreceding, -1)
    known = F.greatest("first", F.coalesce(F.max("after").over(earlier), F.lit(0)))
    covered = matched.select("row", F.greatest(F.lit(0), F.col("after") - known).alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))

    held = matched.select("row", "class1", "class2").distinct()
    sets = held.groupBy("row").agg(*(h.alias(c) for h, c in zip(_pair_hash("class1", "class2"), ("set1", "set2"), strict=True)))
    judged = covered.join(sets, "row")
    members = held.join(sets, "row").select("set1", "set2", "class1", "class2").distinct()
    # one window of a class names its items
    named = classes.groupBy("class1", "class2").agg(F.min("win").alias("win")).join(holders, "win")
    lists = item_lists(members.join(named, ["class1", "class2"]).select("set1", "set2", "item").distinct())

    every = found.select("row", "doc_id", "n_words").join(judged, "row", "left").join(lists, ["set1", "set2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return every.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), items AS (
  SELECT item, words, least(len(words), {WINDOW}) AS t, unnest(range(len(words) - least(len(words), {WINDOW}) + 1)) AS i FROM b WHERE len(words) > 0
), windows AS (
  SELECT DISTINCT item, t, array_to_string(words[i + 1 : i + t], ' ') AS win FROM items
), spots AS (
  SELECT row_id, words, t, unnest(range(len(words) - t + 1)) AS i FROM d JOIN (SELECT DISTINCT t FROM windows) ON len(words) >= t
), found AS (
  SELECT row_id, i, s.t, item FROM spots s JOIN windows w ON w.t = s.t AND w.win = array_to_string(words[i + 1 : i + s.t], ' ')
), hit AS (
  SELECT row_id, count(DISTINCT word) AS n_hit FROM (SELECT row_id, unnest(range(i, i + t)) AS word FROM found) GROUP BY row_id
), named AS (
  SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_id, item FROM found) GROUP BY row_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (row_id) LEFT JOIN named USING (row_id)
"""
