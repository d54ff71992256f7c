"""Join of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. One pass makes 64-bit fingerprints of shingles, a class per distinct set (its fingerprint) and `HASHES` MinHash
   values of 16 bits. Copies and texts that differ only outside words are one class from here on.
2. Classes that agree in a whole band of MinHash values are candidates. Only stars (class, smallest class of its
   bucket) are kept of a bucket, and their components are the groups in which pairs are judged. A pair of similarity
   0.8 shares no band with a probability of 7e-5.
3. Groups are cut into chunks; each pair of chunks is one unit of work that holds at most 2 x `CHUNK` classes. MinHash
   values are compared `STEP` at a time and a pair is dropped as soon as the posterior probability (uniform prior) of
   reaching the threshold falls below `TOLERANCE`; the rest is verified exactly on the shingle sets.
4. A unit gives each class its number of links and one root it is linked to, never the pairs themselves. Components of
   the roots are the classes of near duplicates.

Defined cases: a text of fewer than five words has one shingle of them all; a null text or one without words has none,
links to nothing and is its own class. Equal rows link to each other. A class with a null doc_id takes the smallest
other id. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm.common import ROW, mix64, one_of_equal, row_keys, shuffle_parts, small_batches, stored, table, whole_texts, word_hashes
from barweave.llm.components import components

SHINGLE = 5
THRESHOLD = (4, 5)  # as a fraction, so that similarities are compared exactly
BANDS, BAND_ROWS = 24, 5
HASHES = BANDS * BAND_ROWS
STEP = 24
TOLERANCE = 1e-6
CHUNK = 4096
ROWS_AT_ONCE = 256
COLUMNS_AT_ONCE = 4096
DENSE = 0.02  # share of pairs left from which a product of matrices is cheaper than merging sets
_SEEDS = np.random.default_rng(11).integers(0, 1 << 63, (2, HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Ascending distinct fingerprints."""
    words = word_hashes(text)[0]
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mix64(out + words[i : i + n])
    return np.unique(out)


def minhashes(found: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max)
    for first in range(0, len(found), 4096):
        np.minimum(least, (found[first : first + 4096, None] * _SEEDS[0] + _SEEDS[1]).min(axis=0), out=least)
    return ((least >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.uint16)


def band_keys(values: np.ndarray) -> np.ndarray:
    """A bucket per band of rows of MinHash values."""
    bands = values.reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
    keys = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
    for i in range(BAND_ROWS):
        keys = mix64(keys * np.uint64(0x10001) + bands[:, :, i])
    return keys.view(np.int64)


@lru_cache(maxsize=8)
def least_matches(threshold: tuple[int, int] = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """After each step, the matches below which P(similarity >= threshold | matches) is under the tolerance.

    With a uniform prior the posterior is a beta distribution, whose tail is a binomial sum.
    """
    t = threshold[0] / threshold[1]
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return tuple(out)


SKETCH = "row1 long, row2 long, doc_id long, size int, cls long, sig binary, bands array<long>"


def with_row_keys(docs: DataFrame) -> DataFrame:
    return whole_texts(docs).select(*row_keys(), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def sketches(rows: DataFrame) -> DataFrame:
    """A row per document with its set's size and fingerprint, MinHash values and buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(text.as_py()) for text in batch.column(3)]
            values = np.array([minhashes(s) for s in found], np.uint16).reshape(-1, HASHES)
            names = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in found], np.uint64).view(np.int64)
            bands = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(values).ravel()), BANDS).cast(pa.list_(pa.int64()))
            columns = [*(batch.column(i) for i in range(3)), pa.array([len(s) for s in found], pa.int32()), pa.array(names)]
            columns += [pa.array([v.tobytes() for v in values], pa.binary()), bands]
            yield pa.record_batch(columns, names=["row1", "row2", "doc_id", "size", "cls", "sig", "bands"])

    return rows.select(*ROW, "doc_id", "text").mapInArrow(run, SKETCH)


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(node, label): classes that may have a partner, and their group."""
    buckets = classes.select("cls", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("cls").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "b")
    stars = buckets.join(shared, "bucket").groupBy(F.col("cls").alias("a")).agg(F.min("b").alias("b"), F.collect_set("b").alias("heads"))
    stars = stored(stars, "stars")
    # a class needs an edge to the least of its heads only; the heads of a class are then linked to each other
    bridges = stars.select(F.explode(F.array_remove("heads", F.col("b"))).alias("a"), "b").distinct()
    return components(stars.select("a", "b").unionByName(bridges))


def likely_pairs(left: np.ndarray, right: np.ndarray, may: np.ndarray) -> np.ndarray:
    """The pairs of `may` (rows of MinHash values on both sides) that stay likely to reach the threshold."""
    i, j = np.nonzero(may)
    matches = np.zeros(len(i), np.int32)
    for step, least in enumerate(least_matches()):
        at = slice(step * STEP, (step + 1) * STEP)
        for first in range(0, len(i), 1 << 18):
            part = slice(first, first + (1 << 18))
            matches[part] += (left[i[part], at] == right[j[part], at]).sum(axis=1, dtype=np.int32)
        stay = matches >= least
        i, j, matches = i[stay], j[stay], matches[stay]
    out = np.zeros(may.shape, bool)
    out[i, j] = True
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Common shingles of the marked pairs, 0 elsewhere."""
    out = np.zeros(pairs.shape, np.int64)
    if pairs.mean() < DENSE:
        for i, j in zip(*np.nonzero(pairs), strict=True):
            out[i, j] = len(np.intersect1d(left[i], right[j], assume_unique=True))
        return out
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))  # columns that both sides have

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(sets)
        column = np.minimum(np.searchsorted(common, flat), max(len(common) - 1, 0))
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        hit = common[column] == flat if len(common) else np.zeros(len(flat), bool)
        return row[hit], column[hit]

    (row_l, col_l), (row_r, col_r) = places(left), places(right)
    for first in range(0, len(common), COLUMNS_AT_ONCE):
        width = min(COLUMNS_AT_ONCE, len(common) - first)
        a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        for matrix, row, col in ((a, row_l, col_l), (b, row_r, col_r)):
            inside = (col >= first) & (col < first + width)
            matrix[row[inside], col[inside] - first] = 1
        out += np.rint(a @ b.T).astype(np.int64)
    return np.where(pairs, out, 0)


def judge_unit(cls: np.ndarray, side: np.ndarray, docs: np.ndarray, values: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Per class of a unit: linked documents of other classes, and the smallest class it is linked to by a path."""
    size = np.array([len(s) for s in sets])
    num, den = THRESHOLD
    links, root = np.zeros(len(cls), np.int64), np.arange(len(cls))
    mixed = side.min() != side.max()  # two chunks: only pairs across; one chunk: pairs inside
    left_all = np.flatnonzero(side == 0) if mixed else np.arange(len(cls))
    right_all = np.flatnonzero(side == 1) if mixed else left_all
    for first in range(0, len(left_all), ROWS_AT_ONCE):
        left = left_all[first : first + ROWS_AT_ONCE]
        for start in range(0 if mixed else first, len(right_all), 4 * ROWS_AT_ONCE):
            right = right_all[start : start + 4 * ROWS_AT_ONCE]
            may = (size[left][:, None] * den >= size[right][None, :] * num) & (size[right][None, :] * den >= size[left][:, None] * num)
            if not mixed:
                may &= left[:, None] < right[None, :]
            pairs = likely_pairs(values[left], values[right], may)
            if not pairs.any():
                continue
            both = overlaps([sets[i] for i in left], [sets[i] for i in right], pairs)
            linked = pairs & (both * (num + den) >= num * (size[left][:, None] + size[right][None, :]))
            links[left] += linked @ docs[right]
            links[right] += linked.T @ docs[left]
            i, j = np.nonzero(linked)
            _unite(root, left[i], right[j])
    while not np.array_equal(root, root[root]):
        root = root[root]
    least = cls.copy()
    np.minimum.at(least, root, cls)
    return links, least[root]


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a[k] and b[k]; roots always point to smaller places."""
    while len(a):
        while not np.array_equal(root, root[root]):
            root[:] = root[root]
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, links, root) for each class of each unit, from rows in the order of units."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[3])
        cls = np.array([r[3] for r in rows])
        values = np.frombuffer(b"".join(r[6] for r in rows), np.uint16).reshape(-1, HASHES)
        sets = [np.frombuffer(r[7], np.uint64) for r in rows]
        links, root = judge_unit(cls, np.array([r[4] for r in rows]), np.array([r[5] for r in rows]), values, sets)
        return pa.record_batch([pa.array(cls), pa.array(links), pa.array(root)], names=["cls", "links", "root"])

    held: list[tuple] = []
    for batch in small_batches(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:3] != held[-1][:3]:
                yield solve(held)
                held = []
            held.append(row)
    if held:
        yield solve(held)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        columns = [batch.column(n) for n in ("label", "chunks", "cls", "docs", "sig")]
        columns.append(pa.array([shingles(t.as_py()).tobytes() for t in batch.column("text")], pa.binary()))
        yield pa.record_batch(columns, names=["label", "chunks", "cls", "docs", "sig", "shingles"])


def class_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The shingle set of each class of `wanted`, whose (row1, row2) name a text; equal rows bring it once."""
    read = one_of_equal(rows.join(wanted, ROW)).select("label", "chunks", "cls", "docs", "sig", "text")
    return read.mapInArrow(_sets, "label long, chunks int, cls long, docs long, sig binary, shingles binary")


def judged_links(rows: DataFrame, classes: DataFrame, groups: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(cls, links, root) of the classes in `groups`, a row for each unit a class is in."""
    sizes = groups.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    wanted = groups.join(sizes, "label").withColumnRenamed("node", "cls").join(classes.select("cls", "one.*", "docs", "sig"), "cls")
    sets = class_sets(rows, wanted)
    own = F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")
    units = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    units = units.select("label", low.alias("low"), high.alias("high"), "cls", (F.col("own") > F.col("other")).cast("int").alias("side"), "docs", "sig", "shingles")
    unit = ["label", "low", "high"]
    dealt = units.repartition(shuffle_parts(rows.sparkSession), *unit).sortWithinPartitions(*unit)
    return dealt.mapInArrow(_judge, "cls long, links long, root long")


def near_duplicates(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, class_id, n_links, group, row1, row2 for every row of (doc_id, text).

    class_id is the smallest doc_id of all documents linked by a path, n_links the number of other documents with a
    similarity of at least the threshold, copies included. `group` numbers the same classes (null for texts without
    words) and stays apart where doc_ids repeat; row1 and row2 are the keys of `with_row_keys`.
    """
    rows = with_row_keys(docs)
    found = stored(sketches(rows), "sketches")
    worded = found.where("size > 0").groupBy("cls")
    classes = worded.agg(
        F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_id"), F.min(F.struct(*ROW)).alias("one"), F.max(F.struct("sig", "bands")).alias("values")
    )
    classes = stored(classes.select("cls", "docs", "first_id", "one", "values.*"), "classes")
    judged = stored(judged_links(rows, classes, candidate_groups(classes), chunk), "links")
    label = components(judged.select(F.col("cls").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("cls"), "label")
    links = judged.groupBy("cls").agg(F.sum("links").alias("links"))
    per_class = classes.select("cls", "docs", "first_id").join(links, "cls", "left").join(label, "cls", "left")
    per_class = per_class.withColumn("label", F.coalesce("label", "cls"))
    first = per_class.groupBy("label").agg(F.min("first_id").alias("class_id"))
    per_class = per_class.join(first, "label").select("cls", "class_id", F.col("label").alias("group"), (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links"))
    linked = found.where("size > 0").select(*ROW, "doc_id", "cls").join(per_class, "cls").drop("cls")
    nothing = F.lit(None).cast("long").alias("group"), F.lit(0).cast("long").alias("n_links")
    return linked.unionByName(found.where("size = 0").select(*ROW, "doc_id", F.col("doc_id").alias("class_id"), *nothing))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near duplicates: of each class the row with the smallest doc_id stays."""
    judged = near_duplicates(docs)
    first = judged.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", *ROW)).alias("one")).select("one.row1", "one.row2")
    kept = first.unionByName(judged.where("group is null").select(ROW)).distinct()
    keys = row_keys()
    marked = docs.select(F.struct("*").alias("row"), *keys)
    return marked.join(kept, ROW, "left_semi").select("row.*")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")
