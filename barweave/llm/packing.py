"""Best-fit packing planned on the histogram of piece lengths.

Documents are tokenized and cut into pieces of at most `CAPACITY` tokens. Only the count of each piece length reaches
the driver (at most `CAPACITY` numbers). Best-fit decreasing runs over these counts: sequences with the same free space
are kept as runs of consecutive ids, and a run is served as a whole. The plan is a table of slot runs per length; a
piece takes the slot of its rank within its length. Ranks are counted per (length, hash part) and moved up by the
counts of the earlier parts, so no task orders all pieces of a frequent length.

Defined cases: a null or empty text is one piece, the end token; texts of any length are read whole. Repeated rows are
packed each; ties of the rank are broken by doc_id, piece and checksum. Empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

import itertools
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barweave.llm.common import small_batches, stored, table, whole_texts

CAPACITY = 4096
END_ID = 1
RANK_PARTS = 64
PART_ROWS = 100_000  # pieces of one length that a task orders, about
CACHED_WORDS = 500_000
CHUNK_CHARS = 2_000_000
JOINED_WORDS = 4096
WORD_END = "</w>"  # fixed value: how the vocabulary file marks the last token of a word
# fixed value: the pattern by which the vocabulary file splits a normalized text
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
# the same words for texts of ASCII and Latin letters, which the standard library finds faster
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^\t-\r {LATIN}0-9]+"
# and for lower-case texts of ASCII alone; no two branches but those of the quote start alike
ASCII_PATTERN = r"[a-z]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\t-\r a-z0-9]+"
BROADCAST_RUNS = 200_000
PIECE = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)


class WordTokenizer:
    """Whole texts through a tokenizer file; words that repeat are looked up instead of tokenized again.

    A word taken alone gives the ids it gives in its text, because the file normalizes characters one by one and splits
    texts into these words. Texts that hold a special token's marks or a sigma whose lower case depends on its place go
    through the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.find_any = regex.compile(WORD_PATTERN).findall
        self.find_latin = re.compile(LATIN_PATTERN).findall
        self.find_ascii = re.compile(ASCII_PATTERN).findall
        self.beyond_latin = re.compile(rf"[^\x00-\x1b\x20-\x7f{LATIN}]").search
        self.words: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def _find_words(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text).lower()
        if self.beyond_latin(text):
            return self.find_any(text)
        return self.find_ascii(text) if text.isascii() else self.find_latin(text)

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of each word: many words go as one text, whose ids are split behind each token that ends a word."""
        for first in range(0, len(words), JOINED_WORDS):
            part = words[first : first + JOINED_WORDS]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
            if len(ends) != len(part) or ends[-1] != ids.nbytes:  # a character that the file splits otherwise
                yield from self._direct(part)
                continue
            packed, bounds = ids.tobytes(), [0, *ends.tolist()]
            yield from (packed[a:b] for a, b in itertools.pairwise(bounds))

    def _learn(self, words: set[str]) -> None:
        """Remembers the ids of words; printable ASCII is the same in the file's byte mapping, so such words are merged at once."""
        merge = self.tokenizer.model.tokenize
        plain = [w for w in words if w.isascii() and w.isprintable()]
        for word in plain:
            ids = [token.id for token in merge(word)]
            self.words[word] = struct.pack(f"<{len(ids)}I", *ids)
        others = list(words.difference(plain))
        self.words.update(zip(others, self._encode_words(others), strict=True))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Packed little-endian unsigned 32-bit ids of each text."""
        done = 0
        while done < len(texts):
            size, first = 0, done
            while done < len(texts) and (done == first or size + len(texts[done]) <= CHUNK_CHARS):
                size += len(texts[done])
                done += 1
            yield from self._chunk(texts[first:done])

    def _chunk(self, texts: list[str]) -> Iterator[bytes]:
        split = [None if "<|" in t or "Σ" in t else self._find_words(t) for t in texts]
        ids = [None if words is None else list(map(self.words.get, words)) for words in split]
        unseen = [[] if found is None else [k for k, x in enumerate(found) if x is None] for found in ids]
        missing = {words[k] for words, at in zip(split, unseen, strict=True) for k in at}
        if len(self.words) + len(missing) > CACHED_WORDS:  # those of this chunk stay
            self.words = {w: x for words, found in zip(split, ids, strict=True) if words for w, x in zip(words, found, strict=True) if x is not None}
        self._learn(missing)
        for text, words, found, at in zip(texts, split, ids, unseen, strict=True):
            if found is None:
                yield self._direct([text])[0]
                continue
            for k in at:
                found[k] = self.words[words[k]]
            yield b"".join(found)


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = word_tokenizer(path).encode, 4 * capacity
        for batch in small_batches(batches):
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                ids += END_ID.to_bytes(4, "little")
                for i, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc_id, i, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, PIECE, strict=True)], schema=PIECE)

    return whole_texts(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slot runs (length, first rank, pieces, first sequence, pieces per sequence, offset) of best-fit decreasing.

    Ranks from `first rank` on go in order: `pieces per sequence` to each of the consecutive sequences, from `offset`
    on. The work and the plan depend on the number of lengths, not of pieces.
    """
    open_runs: dict[int, list[tuple[int, int]]] = {}  # free space -> runs (first sequence, how many)
    free: list[int] = []  # ascending free spaces in use
    plan, sequences = [], 0

    def put(space: int, first: int, n: int) -> None:
        if not space or not n:
            return
        if space not in open_runs:
            open_runs[space] = []
            free.insert(int(np.searchsorted(free, space)), space)
        open_runs[space].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = int(np.searchsorted(free, length))
            if at < len(free):  # the tightest space that holds the length
                space = free[at]
                first, n = open_runs[space].pop()
                if not open_runs[space]:
                    del open_runs[space]
                    free.pop(at)
            else:
                space, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            each = space // length  # once opened, a sequence stays the tightest until it is full for this length
            full, rest = min(n, left // each), left % each
            if full:
                plan.append((length, rank, full * each, first, each, capacity - space))
                put(space - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:
                plan.append((length, rank, rest, first + full, rest, capacity - space))
                put(space - rest * length, first + full, 1)
                rank, left, full = rank + rest, left - rest, full + 1
            put(space, first + full, n - full)
    return plan


PLAN_SCHEMA = "length long, first_rank long, pieces long, first_sequence long, each long, offset0 long"


def with_ranks(cut: DataFrame, parts: int = RANK_PARTS) -> DataFrame:
    """Adds `rank`, from 0 within each length."""
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    sizes = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))  # at most capacity x parts rows
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("place", F.row_number().over(inside) - 1)
    return ranked.join(sizes, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place")).drop("part", "place", "before")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces; `cut` is read more than once and should be stored."""
    spark = cut.sparkSession
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = best_fit_plan(counts, capacity)
    plan = spark.createDataFrame(runs, PLAN_SCHEMA)
    slot = F.col("rank") - F.col("first_rank")
    if len(runs) <= BROADCAST_RUNS:
        plan = F.broadcast(plan)
    fits = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("pieces"))
    parts = max(RANK_PARTS, -(-max(counts.values(), default=0) // PART_ROWS))
    return with_ranks(cut, parts).join(plan, "length").where(fits).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.floor(slot / F.col("each"))).alias("sequence_id"),
        (F.col("offset0") + (slot % F.col("each")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(stored(pieces(docs, path, capacity), "pieces"), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
