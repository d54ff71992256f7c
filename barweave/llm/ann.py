"""Nearest neighbours by inner product from randomly rotated one-bit codes.

Each vector is scaled to length one, rotated by a fixed random rotation and kept as one sign bit per dimension, with two
correction scalars: its length and the inner product of the rotated vector with its code. The inner product with a
rotated query is estimated from the bits, and the known spread of this estimate gives a bound of its error. Vectors
whose upper bound reaches the K-th largest lower bound are reranked on the original vectors in double precision.

Queries and vectors meet in a grid of blocks: a query block is sent to each vector block and the other way round, a
cell keeps its best K for each query, and a ranking by query ends it. A cell has a fixed size; no side is broadcast.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component, or have a null id, take no
part. Vectors meet those of the same dimension only. Rows that share the query's id are not its neighbours; a query id
that repeats is searched once, by its smallest vector; repeated candidates are listed each. Ties go to the smaller
vec_id. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barweave.llm.common import stored, table

NEIGHBOURS = 20
EVERY = 20  # the query set: ids divisible by this
VECTOR_BLOCK = 8192
QUERY_BLOCK = 4096
QUERY_STEP = 256  # queries estimated at once inside a cell
ERROR_WIDTH = 2.2  # of the estimate, in standard deviations of a random direction
INDEX = "vec_id long, dim int, code binary, norm double, fit double, vector binary"


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths, and inner products of the rotated unit vectors with their codes."""
    scale = np.abs(vectors).max(axis=1)  # very large components must not overflow
    norm = scale * np.linalg.norm(vectors / scale[:, None], axis=1)
    turned = (vectors / scale[:, None]) @ rotation(vectors.shape[1]).T
    turned /= np.linalg.norm(turned, axis=1)[:, None]
    return np.packbits(turned > 0, axis=1), norm, np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


def build_index(vectors: DataFrame) -> DataFrame:
    """Codes, correction scalars and originals of every usable row of (vec_id, embedding)."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = vectors.select("vec_id", x.alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    usable = usable.where(finite & F.exists("embedding", lambda c: c != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = np.array(batch.column(0)), batch.column(1)
            sizes = np.array(lists.value_lengths())
            flat, ends = np.array(lists.flatten()), np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                rows = flat[(ends[own] - dim)[:, None] + np.arange(dim)]
                codes, norm, fit = encode(rows)
                columns = [ids[own], np.full(len(own), dim, np.int32), [c.tobytes() for c in codes], norm, fit, [r.tobytes() for r in rows]]
                types = (pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["vec_id", "dim", "code", "norm", "fit", "vector"])

    return usable.mapInArrow(run, INDEX)


def estimate(queries: np.ndarray, codes: np.ndarray, norm: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of queries with coded vectors and the bounds of their errors."""
    dim = queries.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    lengths = np.linalg.norm(queries, axis=1)
    unit = ((queries / lengths[:, None]) @ rotation(dim).T).astype(np.float32)
    scale = lengths[:, None] * norm[None, :]
    spread = np.sqrt(np.maximum(1 - fit * fit, 0)) / fit * ERROR_WIDTH / np.sqrt(max(dim - 1, 1))
    return (unit @ signs.T) / fit[None, :] * scale, spread[None, :] * scale


def _unpack(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _dot(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Sums in the order of the components, as a plain loop adds them."""
    return np.cumsum(rows * query, axis=1)[:, -1]


RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search_cell(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    if not len(queries) or not len(vectors):
        return RESULT.empty_table()
    dim = queries.column("dim")[0].as_py()
    q_ids, q = np.array(queries.column("vec_id")), _unpack(queries.column("vector"), np.float64, dim)
    v_ids, v = np.array(vectors.column("vec_id")), _unpack(vectors.column("vector"), np.float64, dim)
    codes = _unpack(vectors.column("code"), np.uint8, (dim + 7) // 8)
    norm, fit = np.array(vectors.column("norm")), np.array(vectors.column("fit"))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for first in range(0, len(q), QUERY_STEP):
        guess, error = estimate(q[first : first + QUERY_STEP], codes, norm, fit)
        own = q_ids[first : first + QUERY_STEP, None] == v_ids[None, :]
        low = np.where(own, -np.inf, guess - error)
        kth = np.partition(low, max(len(v) - k, 0), axis=1)[:, max(len(v) - k, 0)]
        worth = (guess + error >= kth[:, None]) & ~own
        for i in range(len(guess)):
            at, query = np.flatnonzero(worth[i]), q[first + i]
            near = v[at] @ query
            if len(at) > k:  # all that may still be among the k best after rounding
                least = np.partition(near, len(near) - k)[len(near) - k]
                at = at[near >= least - 1e-12 * np.linalg.norm(query) * norm.max()]
            score = _dot(v[at], query)
            order = np.lexsort((v_ids[at], -score))[:k]
            out.append((np.full(len(order), q_ids[first + i]), v_ids[at][order], score[order]))
    return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=RESULT)


def search(index: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of `index` to each row of `queries`, itself rows of an index.

    `index` is read more than once and should be stored.
    """
    queries = queries.groupBy("vec_id", "dim").agg(F.min("vector").alias("vector"))
    vector_blocks = max(1, -(-index.count() // VECTOR_BLOCK))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    of_query = F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")
    of_vector = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(vector_blocks)).cast("int")
    left = queries.select("*", of_query.alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(vector_blocks - 1))).alias("vb"))
    right = index.select("*", of_vector.alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    cell = ["dim", "qb", "vb"]
    found = left.groupBy(cell).cogroup(right.groupBy(cell)).applyInArrow(lambda a, b: _search_cell(a, b, k), "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stored(build_index(table(spark, sf_dir, "embeddings")), "codes")
    return search(index, index.where(F.col("vec_id") % EVERY == 0))


ORACLE = f"""
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.x) = len(v.x) WHERE q.vec_id % {EVERY} = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {NEIGHBOURS}
"""
