"""Removal of byte strings of `LENGTH` that occur more than once, by sorting sampled suffixes.

Only suffixes at anchors are sorted. An anchor is a position whose `GRAM`-byte hash is the least of some window of
`window` positions. The least position among the first `window` of a string depends on that string alone, so texts that
share a string of LENGTH bytes have an anchor at the same place of it, and behind this anchor agree for at least `right`
bytes: the anchor's key. The steps:

1. Anchors of every text, with their key and a hash of their context (the bytes that strings around them may take).
2. Keys seen once are done. Contexts seen more than once repeat as a whole and are decided by their count.
3. Other contexts fetch their bytes, one of each kind, and meet by key. What stands right of the anchors and, reversed,
   what stands left is put in order by deep-shallow sorting. A string that starts d bytes left of an anchor repeats if
   another context agrees with it for d bytes to the left and LENGTH - d to the right, i.e. falls in the same run of
   both orders. Keys with more than `HOT_CONTEXTS` kinds of context count their strings one by one instead, which
   combines before it shuffles.

Counts and joins combine or split hot keys; no task holds more than a bounded part of a key.

Other lengths than `LENGTH` go through `Reach`. `over_words` besides finds repeated passages of more than so many words,
however few bytes they have, from the start of the first word to the end of the last. They take the same steps with words
for bytes (`Passages`): anchors are words by the hash of the `GRAM` bytes from their start, and what is sorted is a row of
8-byte hashes, one for each word with the bytes between it and the word nearer to the anchor. The pipeline removes them as
well; op3 removes strings of 400 bytes only and reports the passages in columns of their own.

Defined cases: a null or empty text has no bytes and loses none; texts of any length are read whole. A repeated row
counts as another place, so equal rows lose everything they repeat. Empty tables give empty results; other columns are
ignored. Where a cut splits a character, `cleaned_text` leaves out its broken bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barweave.llm.common import (
    ROW, discard, fold_bytes, mix64, one_of_equal, quoted, row_keys, shuffle_parts, small_batches, stored, stored_at, table, word_spans,
)
from barweave.llm.suffix_sort import deep_shallow_sort

LENGTH = 400
OVER_WORDS = 50
GRAM = 32
HOT_CONTEXTS = 20_000
SORTED_TOGETHER = 10_000
HASHED_TOGETHER = 500  # contexts whose words are hashed at once
PIECE = 1 << 20  # positions hashed at once
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@dataclass(frozen=True)
class Places:
    """The anchors of a text: their positions and keys, and the range of each context, also in bytes."""

    at: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    last: np.ndarray
    low: np.ndarray
    high: np.ndarray


@dataclass(frozen=True)
class Reach:
    """What follows from the length of the strings, and how they lie in a text."""

    length: int = LENGTH
    unit = 1  # bytes of a position in what is sorted

    def __post_init__(self) -> None:
        if self.length < 2 * GRAM:
            raise ValueError(f"strings need at least {2 * GRAM} bytes")

    @property
    def window(self) -> int:
        return self.length // 2

    @property
    def left(self) -> int:
        """The most bytes from the start of a string to its anchor."""
        return self.window - 1

    @property
    def right(self) -> int:
        """The least from there to its end."""
        return self.length - self.left

    def places(self, text: bytes) -> Places:
        at, keys = anchors(text, self)
        first, last = np.maximum(at - self.left, 0), np.minimum(at + self.length, len(text))
        return Places(at, keys, first, last, first, last)

    def cuts(self, text: bytes) -> Callable[[int], tuple[bytes, bytes]]:
        """The bytes before and after an anchor, as far as a string around it can reach."""
        return lambda p: (text[max(0, p - self.left) : p], text[p : p + self.length])

    def sortable(self, sides: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
        """The same of many anchors, with `unit` bytes for a position."""
        return sides


REACH = Reach()
FEWEST = GRAM // 2 + 1  # words that have GRAM bytes at least, with one byte between them


@dataclass(frozen=True)
class Passages(Reach):
    """Strings of so many words, from the start of the first to the end of the last; positions are words."""

    unit = 8

    def __post_init__(self) -> None:
        if self.length < FEWEST:
            raise ValueError(f"passages need at least {FEWEST} words")

    @property
    def window(self) -> int:
        return self.length - FEWEST + 1

    def places(self, text: bytes) -> Places:
        start, end = word_spans(fold_bytes(text))
        if len(start) < self.length:
            return Places(*(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64, np.int64)))
        words = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
        at = start[: len(start) - FEWEST + 1]
        short = _short_hashes([words[at + 8 * i] for i in range(GRAM // 8)])
        at = _least_of_windows(short, self.window)
        view, digest = memoryview(text), xxhash.xxh3_64_intdigest
        ends = zip(start[at].tolist(), end[at + self.right - 1].tolist(), strict=True)
        keys = np.fromiter((digest(view[a:b]) for a, b in ends), np.uint64, len(at))
        first, last = np.maximum(at - self.left, 0), np.minimum(at + self.length, len(start))
        return Places(at, keys, first, last, start[first], end[last - 1])

    def cuts(self, text: bytes) -> Callable[[int], tuple[bytes, bytes]]:
        start, end = word_spans(fold_bytes(text))
        return lambda p: (text[start[max(0, p - self.left)] : start[p]], text[start[p] : end[min(p + self.length, len(end)) - 1]])

    def sortable(self, sides: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
        """A word left of the anchor takes what follows it, the others what stands before them: sides agree in whole words."""
        if len(sides) > HASHED_TOGETHER:
            return [x for i in range(0, len(sides), HASHED_TOGETHER) for x in self.sortable(sides[i : i + HASHED_TOGETHER])]
        if not sides:
            return []
        text = b"\n".join([before + after for before, after in sides])
        start, end = word_spans(fold_bytes(text))
        left, right = (np.array([len(side[i]) for side in sides]) for i in (0, 1))
        base = np.cumsum(left + right + 1) - left - right - 1
        word = np.searchsorted(start, base + left)  # of each anchor
        first, last = np.searchsorted(start, base), np.append(np.searchsorted(start, base[1:]), len(start))
        before = np.zeros(len(start) + 1, np.int64)  # words left of their anchor lie in [first, word)
        np.add.at(before, first, 1)
        np.add.at(before, word, -1)
        is_left = np.cumsum(before[:-1]) > 0
        low, high = np.append(0, end[:-1]), np.append(start[1:], len(text))
        low[word] = start[word]
        low, high = np.where(is_left, start, low), np.where(is_left, high, end)
        hashes = _hashes_of(text, low, high)
        return [(hashes[a:p].tobytes(), hashes[p:b].tobytes()) for a, p, b in zip(first.tolist(), word.tolist(), last.tolist(), strict=True)]


def _hashes_of(text: bytes, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges that are not empty; those of up to 8 bytes are told apart by bytes and length."""
    words = np.ndarray((len(text) + 1,), "<u8", text + bytes(8), strides=(1,))
    size = high - low
    h = mix64(words[low] & _MASKS[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _ODD[0])
    longer = np.flatnonzero(size > 8)
    for i in range(1, GRAM // 8):
        at, rest = low[longer] + 8 * i, size[longer] - 8 * i
        h[longer] = mix64(h[longer] + (words[at] & _MASKS[np.minimum(rest, 8)]) * _ODD[i])
        longer = longer[rest > 8]
    for i in longer.tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[low[i] : high[i]])
    return h


def _extreme(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over every window of `width` values."""
    step = 1
    while 2 * step <= width:
        values = pick(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def _short_hashes(words: list[np.ndarray]) -> np.ndarray:
    """32 bits of a hash of the `GRAM` bytes of each position, given as 64-bit numbers in order."""
    h = words[0] * _ODD[0]
    for word, odd in zip(words[1:], _ODD[1:], strict=True):
        h += word * odd
    return (mix64(h) >> np.uint64(32)).astype(np.uint32)


def _least_of_windows(short: np.ndarray, window: int) -> np.ndarray:
    """Where the least hash of some window lies, all places of equal ones."""
    none = np.zeros(window - 1, np.uint32)
    least = np.concatenate([none, _extreme(short, window, np.minimum), none])
    return np.flatnonzero(_extreme(least, window, np.maximum) == short)


def anchors(text: bytes, reach: Reach = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors that a string can lie around, and hashes of the `right` bytes from each."""
    window, right = reach.window, reach.right
    last = len(text) - GRAM  # of the positions
    if len(text) < reach.length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = []
    for first in range(0, last + 1, PIECE):
        low, high = max(0, first - window + 1), min(last + 1, first + PIECE + window - 1)
        part = text[low : high + GRAM - 1]
        words = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,))
        n = high - low
        chosen = _least_of_windows(_short_hashes([words[8 * i : 8 * i + n] for i in range(GRAM // 8)]), window)
        chosen = chosen[(chosen + low >= first) & (chosen + low < first + PIECE)]
        at.append(chosen + low)
    where, view, digest = np.concatenate(at), memoryview(text), xxhash.xxh3_64_intdigest
    where = where[where + right <= len(text)]
    return where, np.fromiter((digest(view[p : p + right]) for p in where.tolist()), np.uint64, len(where))


ANCHOR = "row1 long, row2 long, pos long, key long, ctx long, n long, ranges array<struct<first: long, last: long>>"


def contexts_of(text: bytes, reach: Reach = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row (first anchor, key, hash, anchors) per distinct context of a text, its number of ranges, and all ranges in order.

    The ranges are those that can hold a string; a line that a text repeats over and over is one context with one merged
    range.
    """
    places = reach.places(text)
    view, digest = memoryview(text), xxhash.xxh3_64_intdigest
    # the distance to the left end tells cut-off contexts apart
    spots = zip(places.low.tolist(), places.high.tolist(), np.minimum(places.at, reach.left).tolist(), strict=True)
    hashes = np.fromiter((digest(view[a:b], seed) for a, b, seed in spots), np.uint64, len(places.at)).view(np.int64)
    keys, whole = places.keys.view(np.int64), places.last - places.first >= reach.length
    ordered = np.sort(hashes)
    if not (ordered[1:] == ordered[:-1]).any():
        rows, ranges = np.ones((len(hashes), 4), np.int64), np.empty((np.count_nonzero(whole), 2), np.int64)
        rows[:, 0], rows[:, 1], rows[:, 2] = places.at, keys, hashes
        ranges[:, 0], ranges[:, 1] = places.first[whole], places.last[whole]
        return rows, whole.astype(np.int64), ranges
    found: dict[tuple[int, int], list[int]] = {}
    columns = (places.at, keys, hashes, places.first, places.last, whole)
    for p, key, ctx, first, last, holds in zip(*(c.tolist() for c in columns), strict=True):
        entry = found.setdefault((key, ctx), [p, 0])
        entry[1] += 1
        if len(entry) > 2 and first < entry[-1]:
            entry[-1] = last
        elif holds:
            entry += first, last
    rows = np.array([(entry[0], *name, entry[1]) for name, entry in found.items()], np.int64).reshape(-1, 4)
    sizes = np.array([len(entry) // 2 - 1 for entry in found.values()], np.int64)
    return rows, sizes, np.array([x for entry in found.values() for x in entry[2:]], np.int64).reshape(-1, 2)


def _anchor_batch(parts: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    counts = [len(rows) for _, _, rows, _, _ in parts]
    numbers, sizes, flat = (np.concatenate([part[i] for part in parts]) for i in (2, 3, 4))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    ranges = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["first", "last"]))
    names = [pa.array(np.repeat(np.array([part[i] for part in parts], np.int64), counts)) for i in (0, 1)]
    columns = [*names, *(pa.array(numbers[:, i]) for i in range(4)), ranges]
    return pa.record_batch(columns, names=["row1", "row2", "pos", "key", "ctx", "n", "ranges"])


def anchor_table(texts: DataFrame, reach: Reach = REACH) -> DataFrame:
    """A row per distinct context of each (row1, row2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            for row1, row2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                parts.append((row1, row2, *contexts_of(text.as_py(), reach)))
                held += 1 + len(parts[-1][2])
                if held >= SORTED_TOGETHER:
                    yield _anchor_batch(parts)
                    parts, held = [], 0
        if parts:
            yield _anchor_batch(parts)

    return texts.select(*ROW, "text").mapInArrow(run, ANCHOR)


SPAN = "row1 long, row2 long, first long, last long"


def _runs(order: np.ndarray, agree: np.ndarray, least: int) -> np.ndarray:
    """For each string the number of its run of neighbours that agree for at least `least` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(agree < least)
    return out


def _most_agreeing(order: np.ndarray, agree: np.ndarray) -> np.ndarray:
    """For each string the most bytes that any other agrees with it: one of its neighbours."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(np.append(0, agree[1:]), np.append(agree[1:], 0))
    return out


def repeated_range(lefts: list[bytes], rights: list[bytes], reach: Reach = REACH) -> tuple[np.ndarray, np.ndarray]:
    """For each context the least and the largest d whose string has a partner; -1 without any.

    A string starts d positions left of its anchor; `lefts` are reversed.
    """
    right_order, right_agree = deep_shallow_sort(rights)
    left_order, left_agree = deep_shallow_sort(lefts)
    # the d for which both neighbours allow a partner
    low = reach.length - _most_agreeing(right_order, right_agree) // reach.unit
    high = np.minimum(_most_agreeing(left_order, left_agree) // reach.unit, reach.left)
    least, most = np.full(len(lefts), -1), np.full(len(lefts), -1)
    for d in range(reach.left + 1):
        whole = np.flatnonzero((low <= d) & (d <= high))
        if len(whole) < 2:
            continue
        left_run = _runs(left_order, left_agree, d * reach.unit)
        right_run = _runs(right_order, right_agree, (reach.length - d) * reach.unit)
        pair = left_run[whole] * len(lefts) + right_run[whole]
        sort = np.argsort(pair)
        same = pair[sort][1:] == pair[sort][:-1]
        found = whole[sort[np.append(same, False) | np.append(False, same)]]
        least[found] = np.where(least[found] < 0, d, least[found])
        most[found] = d
    return least, most


def _sort_contexts(batches: Iterator[pa.RecordBatch], reach: Reach = REACH) -> Iterator[pa.RecordBatch]:
    """Spans of the contexts that occur once, from (row1, row2, pos, key, once, before, after) in the order of keys."""
    held: list[tuple] = []

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        sides = reach.sortable([r[5:] for r in rows])
        least, most = repeated_range([before[::-1] for before, _ in sides], [after for _, after in sides], reach)
        found = [(r[0], r[1], r[2] - m, r[2] - s + reach.length) for r, s, m in zip(rows, least.tolist(), most.tolist(), strict=True) if r[4] and m >= 0]
        columns = list(zip(*found, strict=True)) or [()] * 4
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["row1", "row2", "first", "last"])

    for batch in small_batches(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(held) >= SORTED_TOGETHER and row[3] != held[-1][3]:
                yield solve(held)
                held = []
            held.append(row)
    if held:
        yield solve(held)


def _string_hashes(batches: Iterator[pa.RecordBatch], reach: Reach = REACH) -> Iterator[pa.RecordBatch]:
    """A row per string around an anchor: key, d, two hashes of the string, and whether its context occurs once."""
    for batch in small_batches(batches, 100):
        rows, columns = [], [c.to_pylist() for c in batch.columns]
        sides = reach.sortable(list(zip(*columns[5:], strict=True)))
        for row1, row2, pos, key, once, (before, after) in zip(*columns[:5], sides, strict=True):
            text, unit = before + after, reach.unit
            for d in range(min(reach.left, len(before) // unit) + 1):
                if len(after) >= (reach.length - d) * unit:
                    string = text[len(before) - d * unit : len(before) + (reach.length - d) * unit]
                    rows.append((row1, row2, pos, key, once, d, *struct.unpack("<qq", xxhash.xxh3_128_digest(string))))
        columns = list(zip(*rows, strict=True)) or [()] * 8
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64())
        names = ["row1", "row2", "pos", "key", "once", "d", "h1", "h2"]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def count_strings(contexts: DataFrame, reach: Reach = REACH) -> DataFrame:
    """The spans of `_sort_contexts` by counting every string; counts combine in the tasks before they meet."""
    strings = contexts.mapInArrow(partial(_string_hashes, reach=reach), "row1 long, row2 long, pos long, key long, once boolean, d int, h1 long, h2 long")
    name = ["key", "d", "h1", "h2"]
    often = strings.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(name)
    found = strings.where("once").join(often, name, "left_semi").groupBy(*ROW, "pos").agg(F.min("d").alias("least"), F.max("d").alias("most"))
    return found.select(*ROW, (F.col("pos") - F.col("most")).alias("first"), (F.col("pos") - F.col("least") + reach.length).alias("last"))


def fetch_contexts(rows: DataFrame, wanted: DataFrame, reach: Reach = REACH) -> DataFrame:
    """The bytes before and after the wanted anchors of (row1, row2, doc_id, text); equal rows send theirs once."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
    names = ["row1", "row2", "pos", "key", "once", "before", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out = []
            for row1, row2, text, anchors_of in zip(*(batch.column(n).to_pylist() for n in (*ROW, "text", "wanted")), strict=True):
                cut = reach.cuts(text)
                out += [(row1, row2, w["pos"], w["key"], w["once"], *cut(w["pos"])) for w in anchors_of]
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    wanted = wanted.groupBy(ROW).agg(F.collect_list(F.struct("pos", "key", "once")).alias("wanted"))  # bounded by one text
    # all columns of the rows are read, so that this join and the last one share one shuffle of the texts
    return one_of_equal(rows.join(wanted, ROW)).mapInArrow(run, "row1 long, row2 long, pos long, key long, once boolean, before binary, after binary")


def repeated_spans(rows: DataFrame, hot_contexts: int = HOT_CONTEXTS, reach: Reach = REACH) -> tuple[DataFrame, str]:
    """(row1, row2, first, last) of ranges that repeated strings cover, in positions, and the stored table that this reads.

    Ranges of a row may overlap.
    """
    found, every_anchor = stored_at(anchor_table(rows, reach), "anchors")
    often = found.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    shared, folder = stored_at(found.join(often, "key", "left_semi"), "shared-anchors")
    discard(rows.sparkSession, every_anchor)
    kinds = shared.groupBy("key", "ctx").agg(F.sum("n").alias("n"), F.min(F.struct(*ROW, "pos")).alias("one"))
    per_key = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("singles"))
    whole = shared.join(kinds.where("n > 1").select("key", "ctx"), ["key", "ctx"], "left_semi")
    decided = whole.select(*ROW, F.inline("ranges"))
    open_keys = per_key.where("kinds > 1 and singles > 0").select("key", (F.col("kinds") > hot_contexts).alias("hot"))
    wanted = kinds.join(open_keys, "key").select("one.*", "key", (F.col("n") == 1).alias("once"), "hot")
    cold, hot = (fetch_contexts(rows, wanted.where(which), reach) for which in ("not hot", "hot"))
    cold = cold.repartition(shuffle_parts(rows.sparkSession), "key").sortWithinPartitions("key")
    return decided.unionByName(cold.mapInArrow(partial(_sort_contexts, reach=reach), SPAN)).unionByName(count_strings(hot, reach)), folder


def stored_spans(rows: DataFrame, hot_contexts: int, reach: Reach) -> DataFrame:
    """`repeated_spans` as a small stored table; what it was made of goes."""
    spans, folder = repeated_spans(rows, hot_contexts, reach)
    spans = stored(spans, "spans")
    discard(rows.sparkSession, folder)
    return spans


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching ranges, in order."""
    out: list[tuple[int, int]] = []
    for first, last in sorted((s["first"], s["last"]) for s in spans or []):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _remove(batches: Iterator[pa.RecordBatch], cut_passages: bool) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        sizes, removed, passages, kept = [], [], [], []
        for text, spans, words in zip(*(batch.column(n).to_pylist() for n in ("text", "spans", "words")), strict=True):
            if words:
                start, end = word_spans(fold_bytes(text))
                words = [{"first": int(start[w["first"]]), "last": int(end[w["last"] - 1])} for w in words]
            runs, at, parts = merged([*(spans or []), *(words or [])] if cut_passages else spans), 0, []
            for first, last in runs:
                parts.append(text[at:first])
                at = last
            sizes.append(len(text))
            removed.append([{"first": a, "last": b} for a, b in runs])
            passages.append([{"first": a, "last": b} for a, b in merged(words)])
            kept.append(b"".join([*parts, text[at:]]))
        columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, SPANS), pa.array(passages, SPANS), pa.array(kept, pa.binary()), batch.column("other")]
        yield pa.record_batch(columns, names=["doc_id", "n_bytes", "spans", "passages", "kept", "other"])


def remove_repeats(
    docs: DataFrame, hot_contexts: int = HOT_CONTEXTS, length: int = LENGTH, over_words: int | None = None, cut_passages: bool = True
) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges), passages (byte ranges), kept (the other bytes) and other of each row of `docs`.

    Removed are repeated strings of `length` bytes. If `over_words` is given, the passages are the repeated ones of more than
    so many words; they are removed as well, unless `cut_passages` is off. `other` is a struct of the columns besides doc_id
    and text.
    """
    rest = [F.col(quoted(c)).alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    other = F.struct(*rest) if rest else F.lit(None).cast("boolean")
    rows = docs.select(*row_keys(), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), other.alias("other"))
    in_words = F.lit(False)
    if over_words is None:
        spans, _ = repeated_spans(rows, hot_contexts, Reach(length))
    else:  # one after the other, so that their files never lie on the disks together
        words = stored_spans(rows, hot_contexts, Passages(over_words + 1)).withColumn("in_words", F.lit(True))
        spans = stored_spans(rows, hot_contexts, Reach(length)) if cut_passages else repeated_spans(rows, hot_contexts, Reach(length))[0]
        spans, in_words = spans.withColumn("in_words", F.lit(False)).unionByName(words), F.col("in_words")
    span = F.struct("first", "last")  # both lists are bounded by one text
    spans = spans.groupBy(ROW).agg(F.collect_set(F.when(~in_words, span)).alias("spans"), F.collect_set(F.when(in_words, span)).alias("words"))
    schema = "doc_id long, n_bytes long, spans array<struct<first: long, last: long>>, passages array<struct<first: long, last: long>>, kept binary"
    return rows.join(spans, ROW, "left").mapInArrow(partial(_remove, cut_passages=cut_passages), T.StructType.fromDDL(schema).add(rows.schema["other"]))


def cleaned_documents(docs: DataFrame, over_words: int | None = None) -> DataFrame:
    """The rows of `docs` with what is left of their texts; bytes of characters that a cut splits go as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [t.decode("utf-8", "ignore") for t in batch.column("kept").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("other")], names=["doc_id", "text", "other"])

    cut = remove_repeats(docs, over_words=over_words).select("doc_id", "kept", "other")
    plain = cut.mapInArrow(run, T.StructType.fromDDL("doc_id long, text string").add(cut.schema["other"]))
    names = {"doc_id": "doc_id", "text": "text"}
    return plain.select(*(F.col(names[c]) if c in names else F.col("other").getField(c).alias(c) for c in docs.columns))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes are removed; repeated passages of more than `OVER_WORDS` words, removed or not, are reported beside them."""
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), over_words=OVER_WORDS, cut_passages=False)
    passage_bytes = F.aggregate("passages", F.lit(0).cast("long"), lambda sum_, run: sum_ + run["last"] - run["first"])
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), F.size("passages").cast("long").alias("n_passages"), passage_bytes.alias("n_passage_bytes"),
    )
