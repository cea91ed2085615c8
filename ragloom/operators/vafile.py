"""Exact top-k between two large sides by a vector-approximation file.

Every vector is written as one byte per dimension (``Codes``: 256 steps between the
least and greatest value of the dimension) next to the exact length of what the bytes
miss, its residual. For a query q and a vector v with decoded forms q', v' and residuals
r, s the triangle inequality bounds the distance by |q' - v'| -+ (r + s) (l2), and the
inner product by q'v' -+ (|q'| s + |v'| r + r s).

1. Codes of both sides are hashed into blocks and every (query block, code block) pair is
   one task: only ids, bytes and residuals are replicated, never full vectors or text.
   A pair is kept if its lower bound is within the k-th best upper bound of its block;
   ``blocks.scan`` finds those pairs tile by tile.
2. The k-th best upper bound over all blocks cuts the survivors again.
3. Only survivors meet the full vectors, by equi-joins on the ids, and are scored exactly.

Of equal vectors only the k smallest ids can be in a result, so further copies are left
out before step 1 (a partial top-k per content); a vector that fills a third of the table
gives no quadratic survivors. Vectors that are null have no part in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import QUERIES, Tiles, _unit, dealt, grid, scan, two_sides, written
from .knn import METRICS, _exact, _matrix

#: Bytes of codes in one block of either side, and numbers held at once in a task.
BLOCK_BYTES, CELLS = 8 << 20, 4 << 20
STEPS = 255
_DISTANCES = [T.StructField("_dist", T.DoubleType()), T.StructField("_key", T.DoubleType())]


class Codes:
    """One byte per dimension between the limits ``low`` and ``high``."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low = low
        self.step = np.where(high > low, (high - low) / STEPS, 1.0)

    def encode(self, m: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((m - self.low) / self.step), 0, STEPS).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.low + codes * self.step


def limits(vectors: DataFrame, metric: str) -> Codes | None:
    """Least and greatest value of every dimension, from one row per task."""
    def run(batches):
        low = high = None
        for b in batches:
            m = _matrix(b.column("_vv"))
            if len(m):
                m = _unit(m) if metric == "cosine" else m
                a, z = m.min(axis=0), m.max(axis=0)
                low, high = (a, z) if low is None else (np.minimum(low, a), np.maximum(high, z))
        if low is not None:
            yield pa.RecordBatch.from_pydict(
                {"dim": np.arange(len(low), dtype=np.int32), "low": low, "high": high})

    got = (vectors.select("_vv").mapInArrow(run, "dim int, low double, high double")
           .groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"))
           .orderBy("dim").collect())
    return Codes(np.array([r["low"] for r in got]), np.array([r["high"] for r in got])) if got else None


def encoded(rows: DataFrame, id_col: str, vec_col: str, codes: Codes, metric: str) -> DataFrame:
    """(id, _code binary, _miss double): bytes and residual of every vector."""
    def run(batches):
        for b in batches:
            m = _matrix(b.column(vec_col))
            if not len(m):
                continue
            m = _unit(m) if metric == "cosine" else m
            if m.shape[1] != len(codes.low):
                raise ValueError("all vectors must have the same length")
            c = codes.encode(m)
            miss = np.sqrt(np.square(m - codes.decode(c)).sum(axis=1)) * (1 + 1e-12)
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), pa.array([x.tobytes() for x in c], pa.binary()), pa.array(miss)],
                names=[id_col, "_code", "_miss"])

    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType),
                           T.StructField("_code", T.BinaryType()),
                           T.StructField("_miss", T.DoubleType())])
    return rows.select(id_col, vec_col).mapInArrow(run, schema)


def bounds(q: np.ndarray, qmiss: np.ndarray, v: np.ndarray, vmiss: np.ndarray,
           metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all distances between decoded rows, with rounding room."""
    dot = q @ v.T
    qn, vn = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
    if metric == "l2":
        centre = np.sqrt(np.maximum(qn[:, None] ** 2 + vn[None, :] ** 2 - 2 * dot, 0))
        room = 1e-7 * (qn[:, None] + vn[None, :] + 1e-30)   # sqrt doubles lost digits
        miss = qmiss[:, None] + vmiss[None, :] + room
        return np.square(np.maximum(centre - miss, 0)), np.square(centre + miss)
    miss = (qn[:, None] * vmiss[None, :] + qmiss[:, None] * vn[None, :]
            + qmiss[:, None] * vmiss[None, :] + 1e-12 * (1 + qn[:, None] * vn[None, :]))
    return 1 - dot - miss, 1 - dot + miss


def _pair_bounds(q, qmiss, v, vmiss, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """``bounds`` of the pairs ``q[i]``, ``v[i]``."""
    qn, vn = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
    if metric == "l2":
        centre = np.sqrt(np.square(q - v).sum(axis=1))
        miss = qmiss + vmiss + 1e-7 * (qn + vn + 1e-30)
        return np.square(np.maximum(centre - miss, 0)), np.square(centre + miss)
    dot = (q * v).sum(axis=1)
    miss = qn * vmiss + qmiss * vn + qmiss * vmiss + 1e-12 * (1 + qn * vn)
    return 1 - dot - miss, 1 - dot + miss


def _survivors(codes: Codes, k: int, metric: str, half: float, digits: int, schema: pa.Schema):
    def side(t):
        raw = np.frombuffer(b"".join(t.column("_code").to_pylist()), np.uint8)
        return codes.decode(raw.reshape(t.num_rows, -1)), t.column("_miss").to_numpy()

    def run(batches):
        sides = two_sides(batches)
        table = next(sides, None)
        if table is None:
            return
        v, vmiss = side(table)
        vid = table.column("_vid").combine_chunks()
        tiles = Tiles(v, metric == "l2", miss=vmiss)
        for batch in sides:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                q, qmiss = side(part)
                r, c = scan(tiles, q, k, metric == "l2", digits, miss=qmiss)
                low, high = np.empty(len(r)), np.empty(len(r))
                for s in range(0, len(r), CELLS // 64):
                    i = slice(s, s + CELLS // 64)
                    low[i], high[i] = _pair_bounds(q[r[i]], qmiss[r[i]], v[c[i]], vmiss[c[i]], metric)
                order = np.lexsort((high, r))
                first = np.searchsorted(r[order], np.arange(len(q)))
                kth = np.full(len(q), np.inf)
                full = first + k - 1 < np.append(first[1:], len(r))
                kth[full] = high[order[first[full] + k - 1]]
                keep = low - half <= kth[r] + half
                yield pa.RecordBatch.from_arrays(
                    [part.column("_qid").take(pa.array(r[keep])), vid.take(pa.array(c[keep])),
                     pa.array(low[keep]), pa.array(high[keep])], schema=schema)

    return run


def knn_codes(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2",
              query_id: str = "question_id", query_vec: str = "embedding",
              vector_id: str = "chunk_id", vector_vec: str = "embedding",
              rank_digits: int = 9, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, vector_id, rank INT, distance DOUBLE): the same rows as ``knn``, with
    neither side on the driver or broadcast. Query ids and vector ids must be unique."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if query_id == vector_id:
        raise ValueError("query_id and vector_id must have different names")
    q = written(queries.select(F.col(query_id).alias("_qid"), F.col(query_vec).cast("array<double>").alias("_qv"))
                 .where(F.col("_qv").isNotNull()), "va-queries")
    v = written(vectors.select(F.col(vector_id).alias("_vid"), F.col(vector_vec).cast("array<double>").alias("_vv"))
                 .where(F.col("_vv").isNotNull()), "va-vectors")
    pairs = T.StructType([T.StructField("_qid", q.schema["_qid"].dataType),
                          T.StructField("_vid", v.schema["_vid"].dataType),
                          T.StructField("_low", T.DoubleType()), T.StructField("_high", T.DoubleType())])
    codes = limits(v, metric) if k > 0 else None
    if codes is None:
        scored = q.sparkSession.createDataFrame([], T.StructType(
            [*pairs.fields[:2], *_DISTANCES]))
    else:
        scored = _scored(q, v, codes, k, metric, rank_digits, block_bytes, pairs,
                         to_arrow_schema(pairs))
    w = Window.partitionBy("_qid").orderBy("_key", "_vid")
    return (scored.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
            .select(F.col("_qid").alias(query_id), F.col("_vid").alias(vector_id), "rank",
                    F.col("_dist").alias("distance")))


def _scored(q, v, codes, k, metric, rank_digits, block_bytes, pairs, arrow_pairs) -> DataFrame:
    dim = len(codes.low)
    # copies of one content: only the k smallest ids can be among a query's k best
    copy = Window.partitionBy(F.xxhash64("_vv"), F.hash("_vv"), "_vv").orderBy("_vid")
    cq = encoded(q, "_qid", "_qv", codes, metric)
    cv = encoded(v.withColumn("_copy", F.row_number().over(copy)).where(F.col("_copy") <= k),
                 "_vid", "_vv", codes, metric)
    cq, cv = written(cq, "va-codes"), written(cv, "va-codes")
    a, b = grid(cq.count(), cv.count(), dim + 40, cq.sparkSession.sparkContext.defaultParallelism,
                block_bytes)
    both = dealt(cq.withColumn("_row", F.xxhash64("_qid")), cv.withColumn("_row", F.xxhash64("_vid")), a, b)
    half = 0.5 * 10.0 ** -rank_digits
    near = written(both.mapInArrow(_survivors(codes, k, metric, half, rank_digits, arrow_pairs), pairs),
                   "va-pairs")
    best = Window.partitionBy("_qid").orderBy("_high")
    cut = (near.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k)
           .groupBy("_qid").agg(F.max("_high").alias("_kth")))
    near = (near.join(cut, "_qid").where(F.col("_low") - half <= F.col("_kth") + half)
            .select("_qid", "_vid"))

    def score(batches):
        for b in batches:
            if b.num_rows:
                d = _exact(_matrix(b.column("_qv")), _matrix(b.column("_vv")), metric)
                yield pa.RecordBatch.from_arrays(
                    [b.column("_qid"), b.column("_vid"), pa.array(d),
                     pa.array(np.round(d, rank_digits))], names=["_qid", "_vid", "_dist", "_key"])

    return near.join(v, "_vid").join(q, "_qid").select("_qid", "_vid", "_qv", "_vv").mapInArrow(
        score, T.StructType([*pairs.fields[:2], *_DISTANCES]))
