"""R1 knn_similarity / O5 top_k: exact k nearest vectors for a whole table of queries.

Plan (no cross join, no all-pairs rows):

* broadcast form: the query matrix (size checked against
  ``max_broadcast_bytes``) is shipped once to every task; each task scans its
  slice of the vector table with ``mapInArrow`` and keeps only its local
  top-k per query (a map-side pre-aggregation, <= k rows per query per task);
  a ``row_number`` window on the query id then picks the global top-k
  (Spark plans it as WindowGroupLimit, so the partial limit also runs before
  the shuffle).
* block form (query set over the broadcast limit or of more than
  ``MAX_BROADCAST_QUERIES`` rows): ``blocks.knn_blocks``, where blocks of both
  sides meet pair by pair; payload is fetched by row after the merge.

Distances (float64 from the stored floats): ``l2`` squared Euclidean (the
vector store's default), ``cosine`` 1 - cos, ``ip`` 1 - dot. Ordering is by
distance rounded to ``rank_digits`` decimals, then by vector id, so ties are
deterministic and equal to the SQL twin. Candidates are preselected with a
matrix product and re-scored exactly per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = ("l2", "cosine", "ip")
DEFAULT_MAX_BROADCAST_BYTES = 256 << 20
BROADCAST_CONF = "ragloom.knn.maxBroadcastBytes"   # session setting, bytes
MAX_BROADCAST_QUERIES = 4096   # beyond it the lists that a scan task keeps grow too long
_CELLS = 4 << 20       # distances held at once inside a task
_PAIRS = 1 << 20       # numbers re-scored at once
_MAX_DIM = 4096        # widest common embedding; bounds the query block by its row count


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


def _exact(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Per-pair exact distance of rows ``q[i]`` and ``v[i]``."""
    if metric == "l2":
        d = q - v
        return (d * d).sum(axis=1)
    dot = (q * v).sum(axis=1)
    if metric == "ip":
        return 1.0 - dot
    den = _norms(q) * _norms(v)
    with np.errstate(divide="ignore", invalid="ignore"):
        sim = np.where(den > 0, dot / np.where(den > 0, den, 1.0), 0.0)
    return np.maximum(1.0 - sim, 0.0)


def _approx(qb: np.ndarray, v: np.ndarray, vsq: np.ndarray, vn: np.ndarray,
            metric: str) -> np.ndarray:
    g = qb @ v.T
    if metric == "l2":
        return (qb * qb).sum(axis=1)[:, None] + vsq[None, :] - 2.0 * g
    if metric == "ip":
        return 1.0 - g
    den = _norms(qb)[:, None] * vn[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1.0 - np.where(den > 0, g / np.where(den > 0, den, 1.0), 0.0)


def _slack(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Bound of the rounding error of ``_approx`` for every pair."""
    qn, vn = _norms(q)[:, None], _norms(v)[None, :]
    scale = {"l2": (qn + vn) ** 2, "ip": 1.0 + qn * vn}.get(metric, np.full((1, 1), 4.0))
    return 8 * np.finfo(float).eps * (q.shape[1] + 8) * scale


def _first_k_per_row(rows: np.ndarray, keys: list[np.ndarray], k: int) -> np.ndarray:
    """Indices of the first ``k`` entries per row after sorting by (row, *keys)."""
    order = np.lexsort(tuple(reversed(keys)) + (rows,))
    r = rows[order]
    start = np.searchsorted(r, r, side="left")
    pos = np.arange(len(r)) - start
    return order[pos < k]


def topk_block(Q: np.ndarray, V: np.ndarray, vids: np.ndarray, k: int, metric: str,
               rank_digits: int = 9):
    """Local top-k of every query row of ``Q`` among the rows of ``V``.

    Returns flat arrays (query_row, vector_row, distance, key). A pair is re-scored
    exactly unless the matrix product, less its rounding error, is above the k-th best
    with it; both sides are centred first, so vectors far from the origin keep their
    digits. Queries go in blocks and their pairs in slices, each cut to k at once, so
    equal vectors take no more memory than others.
    """
    nq, nv = Q.shape[0], V.shape[0]
    if nq == 0 or nv == 0 or k <= 0:
        e = np.zeros(0, dtype=np.int64)
        return e, e, np.zeros(0), np.zeros(0)
    kk = min(k, nv)
    ids = _sortable(vids)
    centre = V.mean(axis=0) if metric == "l2" else 0.0
    Vc, step = V - centre, max(1, _CELLS // nv)
    vsq = (Vc * Vc).sum(axis=1)
    vn = np.sqrt(vsq)
    found = []
    for s in range(0, nq, step):
        qb = Q[s:s + step] - centre
        D = _approx(qb, Vc, vsq, vn, metric)
        err = _slack(qb, Vc, metric) + 0.5 * 10.0 ** -rank_digits
        kth = np.partition(D + err, kk - 1, axis=1)[:, kk - 1]
        r, c = np.nonzero(D - err <= kth[:, None])
        r += s
        dist = np.empty(len(r))
        part = max(1, _PAIRS // max(1, V.shape[1]))
        for at in range(0, len(r), part):
            i = slice(at, at + part)
            dist[i] = _exact(Q[r[i]], V[c[i]], metric)
        key = np.round(dist, rank_digits)
        keep = _first_k_per_row(r, [key, ids[c]], k)
        found.append((r[keep], c[keep], dist[keep], key[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def empty_frame(schema: T.StructType):
    """No rows, with columns Arrow can turn into the types of ``schema``."""
    import pandas as pd

    return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in schema.fields})


def _sortable(ids: np.ndarray) -> np.ndarray:
    if ids.dtype.kind in "iuf":
        return ids
    return np.unique(ids, return_inverse=True)[1]


def _matrix(col: pa.Array | pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros((0, dim or 0))
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    d = len(flat) // n
    if d * n != len(flat):
        raise ValueError("all vectors must have the same length")
    return flat.reshape(n, d)


def _field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2",
        query_id: str = "question_id", query_vec: str = "embedding",
        vector_id: str = "chunk_id", vector_vec: str = "embedding",
        with_vectors: bool = False, payload: tuple[str, ...] = (), rank_digits: int = 9,
        max_broadcast_bytes: int | None = None,
        force_blocks: bool = False, fan_in: int = 256) -> DataFrame:
    """Top-k nearest ``vectors`` rows for every ``queries`` row.

    Output: ``query_id, vector_id, rank INT (1-based), distance DOUBLE``, the
    ``payload`` columns of the vector table (e.g. the chunk text, carried
    through the same scan instead of a join back to the big table) and, with
    ``with_vectors``, the candidate vector as ``cand_vec``. Filters on
    ``vectors`` (P13) must be applied before the call; they reach the scan.
    Query ids must be unique (rows sharing an id would merge their lists);
    vector ids break distance ties.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if query_id == vector_id:
        raise ValueError("query_id and vector_id must have different names")
    spark = queries.sparkSession
    if max_broadcast_bytes is None:
        max_broadcast_bytes = int(spark.conf.get(BROADCAST_CONF, str(DEFAULT_MAX_BROADCAST_BYTES)))
    payload = tuple(payload)
    q = queries.select(F.col(query_id).alias("_qid"), F.col(query_vec).alias("_qv"))
    # no isNotNull filter here: a filter on a UDF-made vector column would make
    # Spark evaluate the UDF twice; the kernels skip NULL vectors instead
    v = vectors.select(F.col(vector_id).alias("_vid"), F.col(vector_vec).alias("_vv"),
                       *[F.col(c) for c in payload])
    fields = [T.StructField("_qid", q.schema["_qid"].dataType),
              T.StructField("_vid", v.schema["_vid"].dataType),
              T.StructField("_dist", T.DoubleType()), T.StructField("_key", T.DoubleType())]
    fields += [T.StructField(c, v.schema[c].dataType) for c in payload]
    if with_vectors:
        fields.append(T.StructField("cand_vec", T.ArrayType(T.FloatType())))
    schema = T.StructType(fields)

    # size check before anything is shipped: rows x dim x 8 bytes. The count
    # does not evaluate the vector column; the dimension needs one pass only
    # when the row count alone cannot prove the bound.
    n_q = q.count()
    force_blocks = force_blocks or n_q > MAX_BROADCAST_QUERIES
    if force_blocks or n_q * _MAX_DIM * 8 <= max_broadcast_bytes:
        dim = 0
    else:
        dim = int(q.agg(F.max(F.size("_qv"))).first()[0] or 0)
    Q = None
    if not force_blocks and n_q * max(dim, 1) * 8 <= max_broadcast_bytes:
        tbl = q.toArrow()
        tbl = tbl.filter(tbl.column("_qv").is_valid())
        qids = tbl.column("_qid").to_numpy(zero_copy_only=False)
        Q = _matrix(tbl.column("_qv"), dim)
        if Q.nbytes > max_broadcast_bytes:       # wider than assumed: take the block form
            dim, Q = Q.shape[1], None
    if Q is None:
        from .blocks import knn_blocks

        return knn_blocks(queries, vectors, k, metric, query_id, query_vec, vector_id, vector_vec,
                          with_vectors, payload, rank_digits)
    bc = spark.sparkContext.broadcast((qids, Q))
    local = v.mapInArrow(_scan_kernel(bc, k, metric, with_vectors, payload, rank_digits,
                                      schema), schema)
    local = _tree_level(local, k, fan_in)
    w = Window.partitionBy("_qid").orderBy("_key", "_vid")
    out = (local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
           .select(F.col("_qid").alias(query_id), F.col("_vid").alias(vector_id),
                   F.col("rank").cast("int").alias("rank"), F.col("_dist").alias("distance"),
                   *payload, *(["cand_vec"] if with_vectors else [])))
    return out


def _tree_level(local: DataFrame, k: int, fan_in: int) -> DataFrame:
    """Every scan task emits <= k rows per query, so a single merge would hold
    k x (number of tasks) rows per query. An intermediate top-k over
    (query, task_id // fan_in) first bounds every group by k x fan_in rows
    whatever the size of the vector table (one group when there are at most
    ``fan_in`` tasks). No partition count is needed up front."""
    w = Window.partitionBy("_qid", "_grp").orderBy("_key", "_vid")
    return (local.withColumn("_grp", F.floor(F.spark_partition_id() / F.lit(fan_in)))
            .withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
            .drop("_grp", "_r"))


def _scan_kernel(bc, k, metric, with_vectors, payload, rank_digits, schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(schema)

    def kernel(batches):
        qids, Q = bc.value
        acc = []  # running local top-k: (qrow, vid, dist, key, vec, payload arrays)
        worst = np.full(len(Q), np.inf)      # key of the k-th best so far
        for b in batches:
            if b.column("_vv").null_count:
                b = b.filter(b.column("_vv").is_valid())
            if b.num_rows == 0:
                continue
            V = _matrix(b.column("_vv"))
            vids = b.column("_vid").to_numpy(zero_copy_only=False)
            r, c, d, key = topk_block(Q, V, vids, k, metric, rank_digits)
            near = key <= worst[r]           # others would be cut by the next merge
            r, c, d, key = r[near], c[near], d[near], key[near]
            take = pa.array(c, pa.int64())
            acc.append((r, vids[c], d, key, V[c] if with_vectors else None,
                        [b.column(p).take(take) for p in payload]))
            if len(acc) > (1 if payload or with_vectors else 8):
                acc = [_merge_acc(acc, k, with_vectors)]
                count = np.bincount(acc[0][0], minlength=len(Q))
                last = np.full(len(Q), -np.inf)
                np.maximum.at(last, acc[0][0], acc[0][3])
                worst = np.where(count >= k, last, np.inf)
        if not acc:
            return
        r, vid, d, key, vec, pay = _merge_acc(acc, k, with_vectors)
        cols = [pa.array(qids[r]), pa.array(vid), pa.array(d, pa.float64()),
                pa.array(key, pa.float64()), *pay]
        if with_vectors:
            cols.append(_list_array(vec))
        yield pa.RecordBatch.from_arrays(cols, schema=arrow_schema)
    return kernel


def _merge_acc(acc, k, with_vectors):
    r = np.concatenate([a[0] for a in acc])
    vid = np.concatenate([a[1] for a in acc])
    d = np.concatenate([a[2] for a in acc])
    key = np.concatenate([a[3] for a in acc])
    vec = np.concatenate([a[4] for a in acc]) if with_vectors else None
    keep = _first_k_per_row(r, [key, _sortable(vid)], k)
    take = pa.array(keep, pa.int64())
    pay = [pa.concat_arrays([a[5][i] for a in acc]).take(take) for i in range(len(acc[0][5]))]
    return r[keep], vid[keep], d[keep], key[keep], (vec[keep] if with_vectors else None), pay


def _list_array(m: np.ndarray) -> pa.Array:
    n, d = m.shape
    offsets = np.arange(0, (n + 1) * d, d, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.reshape(-1).astype(np.float32)))
