"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and their first 4 to 8 bytes, hashed into `SLOTS`; a text has a term or not. The machine
adds linear weights and the inner products of factor vectors of all pairs of terms, so an insult next to the mention of
a group can weigh more than both alone. It is fitted in one task from at most `MAX_LABELLED` labelled rows (the
smallest hashes of doc_id, a documented bound), never from held-out ones; terms that say nothing on the label and are
rare are left out. The fitted machine has a fixed size bound and goes to the tasks, which score every whole text.

Defined cases: a null or empty text has no terms and scores the bias; rows without a usable label are not learned from;
with no labelled rows, or none of one kind, every score is the share of toxic rows plus a small prior. Repeated rows
score alike; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm.common import mix64, small_batches, table, whole_texts, word_hashes

SLOTS = 1 << 18
PREFIXES = (0, 4, 5, 6, 7, 8)
MAX_LABELLED = 16_000
MAX_TERMS = 20_000  # slots the machine keeps: all of its size
FACTORS = 8
EPOCHS = 12
BATCH = 128
RATE = 0.1
DECAY = 1e-5
CUTOFF = 0.7
POSITIVE_WEIGHT = 4.0  # toxic rows are few; a miss costs more than a false alarm


def terms(text: bytes) -> np.ndarray:
    """The distinct slots of a text, ascending."""
    hashes = np.stack(word_hashes(text, PREFIXES))
    kinds = np.arange(len(PREFIXES), dtype=np.uint64)[:, None] << np.uint64(40)  # a word and a prefix are never one term
    return np.unique((mix64(hashes ^ kinds) & np.uint64(SLOTS - 1)).astype(np.uint32))


@dataclass
class Machine:
    bias: float
    slots: np.ndarray  # ascending slots with weights
    weights: np.ndarray
    factors: np.ndarray  # a row per slot

    def __post_init__(self) -> None:
        self.place = np.full(SLOTS, -1, np.int32)
        self.place[self.slots] = np.arange(len(self.slots))

    def score(self, text: bytes) -> float:
        at = self.place[terms(text)]
        at = at[at >= 0]
        v = self.factors[at]
        total = v.sum(axis=0)
        raw = self.bias + self.weights[at].sum() + 0.5 * float((total * total).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def choose_terms(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Slots in at least four rows that tell the classes apart or are frequent, `MAX_TERMS` at most."""
    positive = np.zeros(SLOTS)
    negative = np.zeros(SLOTS)
    for slots, label in zip(rows, labels, strict=True):
        (positive if label else negative)[slots] += 1
    seen = positive + negative
    p, n = labels.sum() + 1, (1 - labels).sum() + 1
    evidence = np.abs(np.log((positive + 0.5) / p) - np.log((negative + 0.5) / n)) * np.sqrt(np.minimum(seen, np.maximum(positive, negative)))
    frequent = np.sort(seen)[-MAX_TERMS // 20]
    keep = np.flatnonzero((seen >= 4) & ((evidence >= 6) | (seen >= max(frequent, 4))))
    return np.sort(keep[np.argsort(-evidence[keep], kind="stable")[:MAX_TERMS]])


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad over mini-batches; the same rows give the same machine."""
    rate = (labels.sum() + 0.5) / (len(labels) + 10)
    bias = float(np.log(rate / (1 - rate)))
    if not len(rows) or labels.min() == labels.max():
        return Machine(bias, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    slots = choose_terms(rows, labels)
    place = np.full(SLOTS, -1, np.int32)
    place[slots] = np.arange(len(slots))
    rows = [p[p >= 0] for p in (place[r] for r in rows)]
    random = np.random.default_rng(seed)
    w, v = np.zeros(len(slots)), random.normal(0, 0.01, (len(slots), FACTORS))
    gw, gv, gb = np.full(len(slots), 1e-3), np.full(v.shape, 1e-3), 1e-3
    for _ in range(EPOCHS):
        order = random.permutation(len(rows))
        for first in range(0, len(order), BATCH):
            batch = order[first : first + BATCH]
            at = np.concatenate([rows[i] for i in batch])
            row = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            vx = v[at]
            total = np.stack([np.bincount(row, vx[:, k], len(batch)) for k in range(FACTORS)], axis=1)
            squares = np.bincount(row, (vx * vx).sum(axis=1), len(batch))
            raw = bias + np.bincount(row, w[at], len(batch)) + 0.5 * ((total * total).sum(axis=1) - squares)
            truth = labels[batch]
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - truth) * np.where(truth > 0, POSITIVE_WEIGHT, 1.0) / len(batch)
            used, back = np.unique(at, return_inverse=True)
            step = np.bincount(back, error[row], len(used)) + DECAY * w[used]
            gw[used] += step * step
            w[used] -= RATE * step / np.sqrt(gw[used])
            slope = error[row, None] * (total[row] - vx)
            for k in range(FACTORS):
                step = np.bincount(back, slope[:, k], len(used)) + DECAY * v[used, k]
                gv[used, k] += step * step
                v[used, k] -= 0.2 * RATE * step / np.sqrt(gv[used, k])
            gb += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(gb)
    return Machine(bias, slots, w, v)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Machine:
    """A machine from (doc_id, text) and (doc_id, toxic).

    At most `most` rows meet in one task, as term slots; only the fitted machine reaches the driver.
    """
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most `most` pairs of numbers; without the hint all texts would be shuffled to meet them
    labelled = whole_texts(docs).select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            packed = [terms((t or "").encode()).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], names=["doc_id", "toxic", "slots"])

    hashed = labelled.withColumn("toxic", F.col("toxic").cast("int")).mapInArrow(run, "doc_id long, toxic int, slots binary")
    # a doc_id may repeat in documents; the bound holds for the rows
    sample = hashed.orderBy("doc_id", F.xxhash64("slots")).limit(most).select("toxic", "slots")
    row = sample.coalesce(1).mapInArrow(_fit_sample, "machine binary").first()
    return pickle.loads(row.machine) if row else fit([], np.zeros(0))  # an empty plan may have no partition at all


def _fit_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pickled machine of all rows (toxic, slots) of the one partition."""
    labels, flat, sizes = [], [], []
    for batch in batches:
        labels += batch.column(0).to_pylist()
        for slots in batch.column(1):
            flat.append(np.frombuffer(slots.as_py(), np.uint32))
            sizes.append(len(flat[-1]))
        flat = [np.concatenate(flat)]  # one block of memory instead of many small ones
    whole = flat[0] if flat else np.zeros(0, np.uint32)
    rows = np.split(whole, np.cumsum(sizes)[:-1]) if sizes else []
    machine = pickle.dumps(fit(rows, np.array(labels, np.float64)))
    yield pa.record_batch([pa.array([machine], pa.binary())], names=["machine"])


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of (doc_id, text)."""
    # at most MAX_TERMS rows of weights
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(machine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = pickle.loads(sent.value).score
        for batch in small_batches(batches):
            scores = [score((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], schema=SCORED)

    return whole_texts(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def clean_documents(docs: DataFrame, machine: Machine, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of `docs` that score under the cutoff, filtered batch by batch without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(machine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = pickle.loads(sent.value).score
        for batch in small_batches(batches):
            texts = pc.struct_field(batch.column(0), "text").to_pylist()
            yield batch.filter(pa.array([score((t or "").encode()) < cutoff for t in texts], pa.bool_()))

    # rows go as one struct: its fields may have any names
    rows = whole_texts(docs).select(F.struct("*").alias("row"))
    return rows.mapInArrow(run, rows.schema).select("row.*")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
