"""Phrase collocations from a weighted de Bruijn graph of words.

A text, A-Z in lower case, falls into pieces at punctuation and line ends, a piece into words. Edges of the graph are the
`LONGEST` = 4 words at a place, each from the node of its first three words to the node of its last three; near the end of a
piece, where fewer words are left, these are the piece-end corrections. So every word of the corpus starts one item, an
edge or a shorter end, and the count of a shorter phrase is the flow through its node: the weights of the items that
start with it. The steps:

1. A task numbers its words in a local dictionary, sorts and sums its items, and packs them by language and bucket of their
   first two words. Texts are not shuffled, and a phrase that fills a task is one item.
2. Buckets meet and are merged; flows of two, three and four words are complete there. A bucket of over `GROUP_ITEMS` items
   (a pair of words that a large part of the corpus shares) is first dealt out by whole items, and its flows are added up.
   Only words, and phrases that reach the least count, leave a bucket that was not dealt out.
3. Edges that meet in a node whose whole flow runs through both are compacted to paths by doubling their links.
4. A path's inner phrases have at least the path's weight, which settles which shorter candidates are dropped. What is
   left is scored from its counts.

Defined cases: a null or empty text has no words; a null lang is ``und``, together with rows whose lang is ``und``. Texts
of any length are read whole; one beyond `FLUSH_BYTES` is worked off in parts cut between pieces. Repeated rows count each.
Ties in score and count are ordered by the phrase's bytes. An empty table has no phrases. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barweave.llm.common import fold_bytes, mix64, release_memory, shuffle_parts, small_batches, stored, table, whole_texts

LONGEST = 4
LEAST_COUNT = 30
PER_LANG = 2000
FLUSH_BYTES = 12 << 20  # of texts whose items a task sums before it passes them on
CHUNK_BYTES = 4 << 20
SLICE = 1 << 18  # items whose 64-bit hashes are in memory at once
GROUP_ITEMS = 2_000_000
_KIND = np.zeros(256, np.uint8)  # 0 in words, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_PIECE_END = re.compile(rb"[.,;:!?\x0A-\x0D]")
_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]

BLOB = "lang string, bucket int, share int, n_items long, size long, blob binary"
BLOB_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
COUNT = "lang string, words int, phrase string, f long"


def words_of(text: bytes) -> tuple[pa.BinaryArray, np.ndarray]:
    """The words in order and how many words, up to `LONGEST`, are left in the piece from each."""
    raw = fold_bytes(text)
    kind = _KIND[raw]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = kind == 0
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    piece = np.cumsum(kind == 2, dtype=np.int32)[start]
    left = np.ones(len(start), np.uint8)
    for i in range(1, LONGEST):
        left[:-i] += piece[i:] == piece[:-i]
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    data = raw[inside[1:-1] == 1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), left


class Items:
    """Distinct items: columns of word numbers (0: none), the words, and weights; sorted by the columns."""

    def __init__(self, columns: list[np.ndarray], words: pa.BinaryArray, weights: np.ndarray | None = None):
        bits = np.uint64(max(1, len(words).bit_length()))
        high, low = (columns[i].astype(np.uint64) << bits | columns[i + 1].astype(np.uint64) for i in (0, 2))
        order = np.lexsort((low, high))
        new = np.ones(len(high), bool)
        for n, half in enumerate((high, low)):
            half = half[order]
            differs = half[1:] != half[:-1]
            new[1:] = new[1:] | differs if n else differs
        del high, low, half
        at = np.flatnonzero(new)
        chosen = order[at]
        self.columns = [c[chosen] for c in columns]
        self.weights = np.diff(np.append(at, len(order))) if weights is None else np.add.reduceat(weights[order], at) if len(at) else weights
        self.words = words


def pack(columns: list[np.ndarray], words: pa.BinaryArray, weights: np.ndarray) -> tuple[int, int, bytes]:
    """Number of items, size before compression and compressed bytes of items with the words that they use."""
    marked = np.zeros(len(words) + 1, bool)
    for column in columns:
        marked[column] = True
    used = np.flatnonzero(marked[1:]) + 1
    number = np.zeros(len(words) + 1, np.uint32)
    number[used] = np.arange(1, len(used) + 1)
    own = words.take(pa.array(used - 1))
    lengths = np.diff(np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1]) if len(own) else np.zeros(0, np.int32)
    text = b"".join(own.to_pylist())
    small = np.uint16 if len(used) < 1 << 16 else np.uint32
    head = np.array([len(weights), len(used), len(text)], np.int64)
    raw = b"".join([head.tobytes(), weights.astype(np.int64).tobytes(), lengths.astype(np.int32).tobytes(), *(number[c].astype(small).tobytes() for c in columns), text])
    return len(weights), len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def unpack(size: int, blob: bytes) -> tuple[list[np.ndarray], pa.BinaryArray, np.ndarray]:
    raw = pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True)
    n, n_words, n_text = np.frombuffer(raw, np.int64, 3).tolist()
    weights = np.frombuffer(raw, np.int64, n, 24)
    at = 24 + 8 * n
    offsets = np.zeros(n_words + 1, np.int32)
    np.cumsum(np.frombuffer(raw, np.int32, n_words, at), out=offsets[1:])
    at += 4 * n_words
    kind = np.dtype(np.uint16 if n_words < 1 << 16 else np.uint32)
    columns = []
    for _ in range(LONGEST):
        columns.append(np.frombuffer(raw, kind, n, at).astype(np.int32))
        at += kind.itemsize * n
    words = pa.BinaryArray.from_buffers(pa.binary(), n_words, [None, pa.py_buffer(offsets), pa.py_buffer(raw[at : at + n_text])])
    return columns, words, weights


def _part_of(words: pa.BinaryArray, columns: list[np.ndarray], parts: int, shift: int = 0) -> np.ndarray:
    """A hash of each item by the text of its words in the given columns, modulo `parts`; the same in every task."""
    digest = xxhash.xxh3_64_intdigest
    each = np.zeros(len(words) + 1, np.uint64)
    each[1:] = np.fromiter(map(digest, words.to_pylist()), np.uint64, len(words))
    found = np.empty(len(columns[0]), np.uint16 if parts <= 1 << 16 else np.uint32)
    for first in range(0, len(found), SLICE):
        sums = np.zeros(len(found[first : first + SLICE]), np.uint64)
        for odd, column in zip(_ODD, columns, strict=False):
            sums += each[column[first : first + SLICE]] * odd
        found[first : first + SLICE] = (mix64(sums) >> np.uint64(shift)) % np.uint64(parts)
    return found


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Texts of one language, joined between pieces, of about `CHUNK_BYTES`; a long text is cut at ends of pieces."""
    for batch in small_batches(batches):
        by_lang = defaultdict(list)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_lang[lang].append(text)
        for lang, texts in by_lang.items():
            joined, first = b"\n".join(texts), 0
            while first < len(joined):
                cut = _PIECE_END.search(joined, first + min(CHUNK_BYTES, FLUSH_BYTES))
                last = cut.end() if cut else len(joined)
                yield lang, joined[first:last]
                first = last


def _local_items(buckets: int):
    def flush(lang: str, chunks: list[tuple[pa.BinaryArray, np.ndarray]]) -> Iterator[tuple]:
        left = np.concatenate([n for _, n in chunks])
        words = pa.concat_arrays([c for c, _ in chunks])
        chunks.clear()
        words = words.dictionary_encode()
        number, words = words.indices.to_numpy() + np.int32(1), words.dictionary
        columns = [number]
        for i in range(1, LONGEST):
            later = np.zeros_like(number)
            later[:-i] = number[i:]
            later[left <= i] = 0
            columns.append(later)
        del left, number
        bucket = _part_of(words, columns[:2], buckets)
        order = np.argsort(bucket, kind="stable")
        if len(order) < 1 << 32:
            order = order.astype(np.uint32)
        ends = np.cumsum(np.bincount(bucket, minlength=buckets))
        del bucket
        # a bucket's items are sorted and summed by themselves: keys and their order are never in memory for all
        first = 0
        for number, last in enumerate(ends.tolist()):
            if last > first:
                mine = order[first:last]
                items = Items([c[mine] for c in columns], words)
                yield lang, number, 0, *pack(items.columns, words, items.weights)
                first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = defaultdict(list), 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, chunks in kept.items():
                yield _batch(flush(lang, chunks))
            kept.clear()
            release_memory()

        for lang, text in _chunks(batches):
            words, left = words_of(text)
            if len(words):
                kept[lang].append((words, left))
                size += len(text)
            if size >= FLUSH_BYTES:
                yield from out()
                size = 0
        yield from out()

    return run


def _batch(rows: Iterator[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    names = [part.split()[0] for part in BLOB.split(", ")]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, BLOB_TYPES, strict=True)], names=names)


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs of large buckets, split by a hash of whole items into as many shares as the last column says."""
    for batch in batches:
        for lang, bucket, _, _, size, blob, shares in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            columns, words, weights = unpack(size, blob)
            share = _part_of(words, columns, shares, 20)
            rows = []
            for k in np.unique(share).tolist():
                mine = share == k
                rows.append((lang, bucket, 1 + k, *pack([c[mine] for c in columns], words, weights[mine])))
            yield _batch(iter(rows))


def _merged(least: int):
    """Counts of a group's phrases; share 0 is a whole bucket, in which rare phrases are known to be rare."""

    def run(group: pa.Table) -> pa.Table:
        lang, whole = group["lang"][0].as_py(), group["share"][0].as_py() == 0
        n, at, known = sum(group["n_items"].to_pylist()), 0, 0
        columns, weights, words = [np.empty(n, np.int32) for _ in range(LONGEST)], np.empty(n, np.int64), []
        for size, blob in zip(group["size"], group["blob"], strict=True):  # one unpacked at a time
            own, w, counted = unpack(size.as_py(), blob.as_py())
            part = slice(at, at + len(counted))
            for column, c in zip(columns, own, strict=True):
                column[part] = np.where(c > 0, c + np.int32(known), 0)
            weights[part] = counted
            words.append(w)
            at, known = part.stop, known + len(w)
        words = pa.concat_arrays(words).dictionary_encode()
        lookup = np.concatenate([np.zeros(1, np.int32), words.indices.to_numpy() + np.int32(1)])
        for i, column in enumerate(columns):
            columns[i] = lookup[column]
        items = Items(columns, words.dictionary, weights)
        del columns, column, weights, words, lookup, own, w, counted, c
        total = int(items.weights.sum())
        names, counts, sizes = [pa.array([""], pa.string())], [np.array([total])], [np.zeros(1, np.int32)]
        changed = np.zeros(len(items.weights), bool)
        changed[0] = True
        for k in range(1, LONGEST + 1):
            column = items.columns[k - 1]
            changed[1:] |= column[1:] != column[:-1]
            at = np.flatnonzero(changed)
            flow = np.add.reduceat(items.weights, at)
            keep = column[at] > 0
            if whole and k > 1:
                keep &= flow >= least
            at, flow = at[keep], flow[keep]
            row = [items.words.take(pa.array(c[at] - 1)) for c in items.columns[:k]]
            # columns of words are joined as such: a share has many phrases, which as Python objects take several times as much
            names.append(pc.binary_join_element_wise(*row, b" ").cast(pa.string()))
            counts.append(flow)
            sizes.append(np.full(len(at), k, np.int32))
        names, counts, sizes = pa.concat_arrays(names), np.concatenate(counts), np.concatenate(sizes)
        del items, row
        release_memory()
        return pa.table([pa.array([lang] * len(names), pa.string()), pa.array(sizes), names, pa.array(counts)], names=["lang", "words", "phrase", "f"])

    return run


def graph(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(lang, words, phrase, f): edges (4 words), nodes (3) and shorter phrases counted at least `least` times.

    words = 0 has the number of all words of a language.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    texts = whole_texts(docs).select(lang, F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    buckets = shuffle_parts(docs.sparkSession)
    blobs = stored(texts.mapInArrow(_local_items(buckets), BLOB), "items")
    shares = F.ceil(F.sum("n_items") / F.lit(GROUP_ITEMS)).cast("int").alias("shares")
    # as a written table its size is known to the planner, which need not shuffle the blobs to join a few rows
    large = stored(blobs.groupBy("lang", "bucket").agg(shares).where("shares > 1"), "large-buckets")
    dealt = blobs.join(large, ["lang", "bucket"]).select(*blobs.columns, "shares").mapInArrow(_deal, BLOB)
    groups = blobs.join(large, ["lang", "bucket"], "left_anti").select(*blobs.columns).unionByName(dealt)
    counts = groups.groupBy("lang", "bucket", "share").applyInArrow(_merged(least), COUNT)
    counts = counts.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return stored(counts.where((F.col("words") == 0) | (F.col("f") >= least)), "graph")


def _some_words(phrase: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def paths(counts: DataFrame) -> DataFrame:
    """(lang, phrase, f): the graph's edges, compacted where the whole flow of a node runs through two of them.

    Every edge is on one path, and has its weight.
    """
    edges = counts.where(F.col("words") == LONGEST)
    node = LONGEST - 1
    ends = edges.select("lang", "f", _some_words(F.col("phrase"), 2, node).alias("node"), F.col("phrase").alias("before"))
    starts = edges.select("lang", "f", _some_words(F.col("phrase"), 1, node).alias("node"), F.col("phrase").alias("after"))
    nodes = counts.where(F.col("words") == node).select("lang", "f", F.col("phrase").alias("node"))
    links = ends.join(nodes, ["lang", "f", "node"]).join(starts, ["lang", "f", "node"]).select("lang", "before", "after")
    # each linked edge looks up to the one `steps` before it; doubling ends when all look at the head of their path
    up = stored(links.select("lang", F.col("after").alias("edge"), F.col("before").alias("head"), F.lit(1).alias("steps")), "links")
    while True:
        far = up.select("lang", F.col("edge").alias("head"), F.col("head").alias("further"), F.col("steps").alias("more"))
        joined = up.join(far, ["lang", "head"], "left")
        head, steps = F.coalesce("further", "head").alias("head"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")
        up = stored(joined.select("lang", "edge", head, steps, F.col("further").isNotNull().alias("moved")), "links")
        if not up.where("moved").head(1):
            break
    up = up.select("lang", "edge", "head", "steps")
    tails = up.groupBy("lang", "head").agg(F.array_sort(F.collect_list(F.struct("steps", _some_words(F.col("edge"), LONGEST, 1).alias("word")))).alias("tail"))
    heads = edges.join(up.select("lang", F.col("edge").alias("phrase")), ["lang", "phrase"], "left_anti")
    heads = heads.join(tails.withColumnRenamed("head", "phrase"), ["lang", "phrase"], "left")
    return heads.select("lang", F.concat_ws(" ", "phrase", F.col("tail.word")).alias("phrase"), "f")


def _phrases_inside(longer: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(lang, phrase, longest): the largest count among the given phrases that hold a phrase of one of `sizes` words."""
    inside = []
    for n in sizes:
        at = F.explode(F.expr(f"sequence(1, size(split(phrase, ' ')) - {n - 1})")).alias("at")
        inside.append(longer.select("lang", "phrase", "f", at).select("lang", _some_words(F.col("phrase"), F.col("at"), n).alias("phrase"), "f"))
    both = inside[0] if len(inside) == 1 else inside[0].unionByName(inside[1])
    return both.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def mine(docs: DataFrame, least: int = LEAST_COUNT, per_lang: int = PER_LANG) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first `per_lang` collocations of every language."""
    counts = graph(docs, least)
    candidates = counts.where("words > 1")
    around = _phrases_inside(paths(counts), (2, 3)).unionByName(_phrases_inside(counts.where("words = 3").select("lang", "phrase", "f"), (2,)))
    around = around.groupBy("lang", "phrase").agg(F.max("longest").alias("longest"))
    wide = "cast({} as decimal(20, 0))"
    covered = F.expr(f"{wide.format('longest')} * 100 >= {wide.format('f')} * 80")
    kept = candidates.join(around, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))

    parts = counts.where(F.col("words").between(1, LONGEST - 1))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumns({"head": _some_words(F.col("phrase"), 1, F.col("k")), "tail": _some_words(F.col("phrase"), F.col("k") + 1, F.col("words") - F.col("k"))})
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr(f"({wide.format('a')} * 2000000) div ({wide.format('l')} + {wide.format('r')})")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = worst.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_lang)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), spots AS (
  SELECT lang, k, unnest(list_transform(range(len(w) - k + 1), lambda i: array_to_string(w[i + 1 : i + k], ' '))) AS phrase
  FROM worded, (VALUES (1), (2), (3), (4)) AS t(k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM spots GROUP BY lang, k, phrase HAVING count(*) >= {LEAST_COUNT}
), c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inside AS (
  SELECT lang, array_to_string(w[i + 1 : i + n], ' ') AS phrase, max(f) AS longest
  FROM (SELECT *, unnest(range(k - n + 1)) AS i FROM c, (VALUES (2), (3)) AS t(n) WHERE n < k) GROUP BY ALL
), kept AS (
  SELECT c.lang, c.k AS size, c.w, c.phrase, c.f AS a FROM c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase
  WHERE i.longest IS NULL OR 100 * i.longest::HUGEINT < 80 * c.f::HUGEINT
), cuts AS (
  SELECT *, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : size], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)
), scored AS (
  SELECT x.lang, x.phrase, x.a, x.k, h.f AS l, t.f AS r, (2000000::HUGEINT * x.a // (h.f + t.f))::BIGINT AS score
  FROM cuts x JOIN f h ON h.lang = x.lang AND h.phrase = x.head JOIN f t ON t.lang = x.lang AND t.phrase = x.tail
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {PER_LANG}
"""
