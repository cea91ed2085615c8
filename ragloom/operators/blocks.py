"""Exact top-k of many queries: both sides in blocks, every pair of blocks one task.

Distinct query vectors are hashed into ``a`` blocks, vectors into ``b``; a task holds one
block of vectors (at most about ``BLOCK_BYTES`` as float32) and streams one block of queries
past it, so its memory does not depend on the tables. Ids and distances alone leave it, at
most k a query; payload and vectors are fetched by row number after the merge.

Inside a task ``scan`` multiplies tiles in float32. A pair is scored again in float64 unless
its product, with the rounding error of float32, is beyond the k-th best found so far, so
the result is that of comparing all pairs in float64.

Each pair of blocks moves both of them, so with many blocks far more bytes move than both
sides have. They move in rounds of query blocks of at most ``ROUND`` times the rows of both
sides; a round's best are written and its shuffle files removed before the next begins.

Of equal vectors only the k smallest ids can be in a result; further copies are left out
first, and equal queries are searched once. Vectors with null, NaN or infinite entries have
no distance to anything and are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .knn import _exact, _first_k_per_row, _matrix, topk_block

#: Bytes of one block as float32; queries and vectors of one tile.
BLOCK_BYTES, QUERIES, TILE = 32 << 20, 512, 2048
#: Pairs worth a task of their own.
PAIRS = 1 << 22
#: Times the rows of both sides that move in one round of query blocks.
ROUND = 6
_PAIRS = 1 << 20       # numbers re-scored at once
_HUGE = 1e15           # beyond it products leave float32
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write(df: DataFrame, path: str) -> None:
    """Write ``df`` and remove the shuffle files this took, which else stay until the driver
    happens to collect its garbage."""
    conf = df.sparkSession.conf
    was = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if was is None else conf.set(_CLEANUP, was)


def grid(n_q: int, n_v: int, row_bytes: int, slots: int, block_bytes: int) -> tuple[int, int]:
    """Blocks of queries and of vectors: each fits ``block_bytes`` and, with pairs enough, there
    are four times as many pairs of blocks as task slots."""
    a, b = (max(1, math.ceil(n * row_bytes / block_bytes)) for n in (n_q, n_v))
    want = min(4 * slots, n_q * n_v // PAIRS)
    if a * b < want:
        grow = math.sqrt(want / (a * b))
        a, b = max(a, min(n_q, math.ceil(a * grow))), max(b, min(n_v, math.ceil(b * grow)))
    return a, b


def rounds(n_q: int, n_v: int, a: int, b: int) -> int:
    """Rounds of query blocks, none of which moves more than ``ROUND`` times the rows of both
    sides (a round has one query block at least)."""
    each = int(ROUND * (n_q + n_v) // max(1, n_v + b * math.ceil(n_q / a)))
    return math.ceil(a / max(1, each))


def dealt(left: DataFrame, right: DataFrame, a: int, b: int) -> DataFrame:
    """``right`` (side 0) before ``left`` (side 1) in each of a x b partitions; both have a
    long ``_row``, which is hashed."""
    def block(n):
        return F.pmod(F.xxhash64("_row"), F.lit(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    one = left.select("*", block(a).alias("_i"), every(b).alias("_j"), F.lit(1).alias("_side"))
    two = right.select("*", block(b).alias("_j"), every(a).alias("_i"), F.lit(0).alias("_side"))
    both = one.unionByName(two, allowMissingColumns=True)
    part = F.col("_i") * F.lit(b) + F.col("_j")
    return both.repartitionById(a * b, part).sortWithinPartitions("_side")


def two_sides(batches):
    """(vectors as a table, then batches of queries) of one partition of ``dealt``."""
    held, told = [], False
    for batch in batches:
        side = batch.column("_side").to_numpy()
        n = int(np.searchsorted(side, 1))
        if n:
            held.append(batch.slice(0, n))
        if n < len(side):
            if not told:
                told = True
                yield pa.Table.from_batches(held) if held else None
                held = []
            yield batch.slice(n)


def _room(qn: np.ndarray, vmax: float, dim: int, digits: int) -> np.ndarray:
    """Rounding error of a float32 product of tile and query, and of the compared digits."""
    return 2 * (dim + 16) * np.finfo(np.float32).eps * (qn + vmax) ** 2 + 10.0 ** -digits


class Tiles:
    """Vectors of one block, ready for products: sorted by ``cell`` (if there are cells, a
    tile is of one cell) or by length, so that a long vector widens the bounds of one tile."""

    def __init__(self, V: np.ndarray, l2: bool, cell: np.ndarray | None = None, miss: np.ndarray | None = None):
        self.centre = V.mean(axis=0) if l2 and len(V) else np.zeros(V.shape[1])
        Vc = V - self.centre
        vn = np.sqrt((Vc * Vc).sum(axis=1))
        self.order = np.lexsort((vn,) if cell is None else (vn, cell))
        Vc, vn = Vc[self.order], vn[self.order]
        self.m = np.empty((len(V), V.shape[1] + 1), np.float32)
        self.m[:, :-1] = Vc
        self.m[:, -1] = -0.5 * vn * vn if l2 else 0.0
        # a tile holds no vectors much longer than its others
        usual = max(float(np.median(vn)) if len(vn) else 0.0, 1e-300)
        size = np.log2(np.maximum(vn / usual, 1)).astype(np.int64) // 2
        new = np.diff(size) != 0
        if cell is not None:
            new |= np.diff(cell[self.order]) != 0
        edges = [0, *(np.flatnonzero(new) + 1), len(V)]
        self.spans = []
        for lo, hi in zip(edges, edges[1:]):
            for at in range(lo, hi, TILE):
                end = min(hi, at + TILE)
                self.spans.append((at, end, float(vn[end - 1]),
                                   0.0 if miss is None else float(miss[self.order[at:end]].max()),
                                   0 if cell is None else int(cell[self.order[at]])))


def scan(tiles: Tiles, Q: np.ndarray, k: int, l2: bool, digits: int, admitted: np.ndarray | None = None,
         bound: np.ndarray | None = None, miss: np.ndarray | None = None):
    """(query rows, vector rows) that can be among the k best of at most ``QUERIES`` queries.

    ``admitted`` (query x cell) says which cells a query sees, ``bound`` a distance it need
    not go beyond; ``miss`` are the residuals of queries known by their codes only."""
    Qc = Q - tiles.centre
    qsq = (Qc * Qc).sum(axis=1)
    qn = np.sqrt(qsq)
    q32 = np.ones((len(Q), Q.shape[1] + 1), np.float32)
    q32[:, :-1] = Qc
    # the true product of the k-th best is at least ``least``
    least = np.full(len(Q), -np.inf)
    if bound is not None:
        least = np.where(np.isfinite(bound), (qsq - bound) / 2 - 10.0 ** -digits, -np.inf)
    every = np.arange(len(Q))
    held, n, limit = [], 0, 4 * k * len(Q)

    def cut(held):
        r, c, low, high = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((-low, r))
        first = np.searchsorted(r[order], np.arange(len(Q)))
        at = first + k - 1
        full = at < np.append(first[1:], len(r))
        least[full] = np.maximum(least[full], low[order[at[full]]])
        keep = high >= least[r]
        return r[keep], c[keep], low[keep], high[keep]

    for lo, hi, vmax, vmiss, cell in tiles.spans:
        rows = every if admitted is None else np.flatnonzero(admitted[:, cell])
        if not len(rows):
            continue
        S = (q32 if len(rows) == len(Q) else q32[rows]) @ tiles.m[lo:hi].T
        e = _room(qn[rows], vmax, Q.shape[1], digits)
        if miss is not None and l2:
            m = miss[rows] + vmiss
        elif miss is not None:
            e = e + qn[rows] * vmiss + miss[rows] * (vmax + vmiss)

        def lower(s, i):
            if miss is None or not l2:
                return s - e[i]
            far = np.sqrt(np.maximum(qsq[rows[i]] - 2 * (s - e[i]), 0)) + m[i]
            return (qsq[rows[i]] - far * far) / 2

        def upper(s, i):
            if miss is None or not l2:
                return s + e[i]
            near = np.maximum(np.sqrt(np.maximum(qsq[rows[i]] - 2 * (s + e[i]), 0)) - m[i], 0)
            return (qsq[rows[i]] - near * near) / 2

        fresh = np.flatnonzero(np.isneginf(least[rows]))
        if len(fresh) and hi - lo >= k:
            kth = np.partition(S[fresh], hi - lo - k, axis=1)[:, hi - lo - k].astype(np.float64)
            least[rows[fresh]] = lower(kth, fresh)
        floor = least[rows]
        if miss is not None and l2:
            far = np.sqrt(np.maximum(qsq[rows] - 2 * floor, 0)) + m
            floor = (qsq[rows] - far * far) / 2
        f = np.flatnonzero(S >= (floor - e).astype(np.float32)[:, None])
        if not len(f):
            continue
        i = f // (hi - lo)
        s = S.ravel()[f].astype(np.float64)
        held.append((rows[i], f - i * (hi - lo) + lo, lower(s, i), upper(s, i)))
        n += len(f)
        if n > limit:
            held = [cut(held)]
            n = len(held[0][0])
            limit = max(4 * k * len(Q), 2 * n)
    if not held:
        none = np.zeros(0, np.int64)
        return none, none
    r, c, _, _ = cut(held)
    return r, tiles.order[c]


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1))[:, None]
    return np.where(n > 0, m / np.where(n > 0, n, 1.0), 0.0)


def _places(ids) -> np.ndarray:
    """Place of every id in ascending order, nulls first."""
    order = pc.sort_indices(ids, null_placement="at_start").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place


def _kernel(k: int, metric: str, digits: int, cells, schema: pa.Schema):
    l2 = metric == "l2"

    def run(batches):
        sides = two_sides(batches)
        table = next(sides, None)
        if table is None:
            return
        V = _matrix(table.column("_vec"))
        good = np.isfinite(V).all(axis=1)
        if not good.all():
            table, V = table.filter(pa.array(good)), V[good]
        if not len(V):
            return
        vrow, vid = table.column("_row").combine_chunks(), table.column("_vid").combine_chunks()
        place = _places(vid)
        cell = table.column("_cell").to_numpy() if cells else None
        del table
        huge = np.abs(V).max(initial=0) > _HUGE
        tiles = None if huge else Tiles(V if metric != "cosine" else _unit(V), l2, cell)
        for batch in sides:
            found = Q = _matrix(batch.column("_vec"))
            if Q.shape[1] != V.shape[1]:
                raise ValueError("all vectors must have the same length")
            near = batch.column("_bound").to_numpy(zero_copy_only=False) if cells else None
            for at in range(0, len(Q), QUERIES):
                q = Q[at:at + QUERIES]
                ok = np.flatnonzero(np.isfinite(q).all(axis=1))
                if not len(ok):
                    continue
                q = q[ok]
                if huge or np.abs(q).max() > _HUGE:
                    r, c, d, key = topk_block(q, V, place, k, metric, digits)
                else:
                    limit = near[at:at + QUERIES][ok] if cells else None
                    seen = cells(q, limit) if cells else None
                    r, c = scan(tiles, q if metric != "cosine" else _unit(q), k, l2, digits, seen, limit)
                    d = np.empty(len(r))
                    part = max(1, _PAIRS // max(1, V.shape[1]))
                    for s in range(0, len(r), part):
                        d[s:s + part] = _exact(q[r[s:s + part]], V[c[s:s + part]], metric)
                    key = np.round(d, digits)
                    keep = _first_k_per_row(r, [key, place[c]], k)
                    r, c, d, key = r[keep], c[keep], d[keep], key[keep]
                if len(r):
                    found = pa.array(c)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("_row").take(pa.array(ok[r] + at)), vrow.take(found), vid.take(found),
                         pa.array(d), pa.array(key)], schema=schema)

    return run


def _same_type(a: DataFrame, b: DataFrame, name: str) -> str:
    kinds = {df.schema[name].dataType.simpleString() for df in (a, b)}
    return "array<float>" if kinds == {"array<float>"} else "array<double>"


class Sides:
    """Both sides written once: ``v`` (_row, _vid, _vec, payload) with ``few`` of its copies
    left, ``q`` (_qid, _rep) and ``asked``, the distinct query vectors (_row, _vec)."""

    def __init__(self, queries, vectors, k, query_id, query_vec, vector_id, vector_vec, payload=()):
        pair = [queries.select(F.col(query_vec).alias("_vec")), vectors.select(F.col(vector_vec).alias("_vec"))]
        kind = _same_type(*pair, "_vec")
        row = F.monotonically_increasing_id().alias("_row")
        self.v = written(vectors.select(row, F.col(vector_id).alias("_vid"), F.col(vector_vec).cast(kind).alias("_vec"),
                                        *[F.col(c) for c in payload]), "block-vectors")
        q = written(queries.select(row, F.col(query_id).alias("_qid"), F.col(query_vec).cast(kind).alias("_vec")),
                    "block-queries").where(F.col("_vec").isNotNull())
        self.asked = written(q.groupBy("_vec").agg(F.min("_row").alias("_row")).select("_row", "_vec"),
                             "block-asked")
        self.q = q.join(self.asked.withColumnRenamed("_row", "_rep"), "_vec").select("_qid", "_rep")
        copy = Window.partitionBy(F.xxhash64("_vec"), F.hash("_vec"), "_vec").orderBy("_vid")
        self.few = written(self.v.where(F.col("_vec").isNotNull())
                           .withColumn("_copy", F.row_number().over(copy)).where(F.col("_copy") <= max(k, 1))
                           .select("_row", "_vid", "_vec"), "block-few")

    def width(self) -> int:
        first = self.few.select(F.size("_vec")).first()
        return first[0] if first else 0

    def search(self, k, metric, rank_digits=9, block_bytes=BLOCK_BYTES, cells=None, few=None, asked=None):
        """(_rep, _row, _vid, _dist, _key): the k best rows of ``few`` for every ``asked`` vector,
        written round by round."""
        from pyspark.sql.pandas.types import to_arrow_schema

        few = self.few if few is None else few
        asked = self.asked if asked is None else asked
        spark = few.sparkSession
        n_q, n_v = asked.count(), few.count()
        a, b = grid(n_q, n_v, 4 * self.width(), spark.sparkContext.defaultParallelism, block_bytes)
        n = rounds(n_q, n_v, a, b)
        schema = T.StructType([T.StructField("_rep", T.LongType()), T.StructField("_row", T.LongType()),
                               T.StructField("_vid", few.schema["_vid"].dataType),
                               T.StructField("_dist", T.DoubleType()), T.StructField("_key", T.DoubleType())])
        kernel = _kernel(k, metric, rank_digits, cells, to_arrow_schema(schema))
        best = Window.partitionBy("_rep").orderBy("_key", "_vid")
        path = scratch_path(spark, "block-found")
        for i in range(n):
            some = asked if n == 1 else asked.where(F.pmod(F.xxhash64("_row", F.lit(n)), F.lit(n)) == i)
            local = dealt(some, few, math.ceil(a / n), b).mapInArrow(kernel, schema)
            _write(local.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r"),
                   f"{path}/{i}")
        return spark.read.schema(schema).parquet(*[f"{path}/{i}" for i in range(n)])

    def result(self, found, k, query_id, vector_id, with_vectors=False, payload=()):
        """The output of ``knn`` for all queries."""
        best = Window.partitionBy("_qid").orderBy("_key", "_vid")
        out = (found.join(self.q, "_rep").withColumn("rank", F.row_number().over(best).cast("int"))
               .where(F.col("rank") <= k))
        if payload or with_vectors:
            ride = [F.col("_vec").cast("array<float>").alias("cand_vec")] if with_vectors else []
            out = out.join(self.v.select("_row", *payload, *ride), "_row")
        return out.select(F.col("_qid").alias(query_id), F.col("_vid").alias(vector_id), "rank",
                          F.col("_dist").alias("distance"), *payload, *(["cand_vec"] if with_vectors else []))


def knn_blocks(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2",
               query_id: str = "question_id", query_vec: str = "embedding",
               vector_id: str = "chunk_id", vector_vec: str = "embedding", with_vectors: bool = False,
               payload: tuple[str, ...] = (), rank_digits: int = 9, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``knn`` with neither side on the driver or broadcast."""
    sides = Sides(queries, vectors, k, query_id, query_vec, vector_id, vector_vec, payload)
    found = sides.search(k, metric, rank_digits, block_bytes)
    return sides.result(found, k, query_id, vector_id, with_vectors, payload)
