"""The vector-approximation search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.operators.knn import knn
from ragloom.operators.vafile import Codes, bounds, knn_codes, _unit


def brute(q, v, k, metric):
    out = set()
    for i, a in q.items():
        def dist(b):
            if metric == "l2":
                return float(((a - b) ** 2).sum())
            dot = float((a * b).sum())
            if metric == "ip":
                return 1 - dot
            den = float(np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))
            return max(0.0, 1 - (dot / den if den else 0.0))
        best = sorted((round(dist(b), 9), j) for j, b in v.items())[:k]
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_equals_brute_force(spark, metric):
    rng = np.random.default_rng(4)
    base = np.round(rng.normal(size=(90, 6)), 3)
    base[:6] = 0                                    # zero vectors
    base[10:40] = base[10]                          # copies
    base[40] = 50                                   # widens the steps of all codes
    v = {i: x for i, x in enumerate(base)}
    q = {i: base[i] if i % 2 else np.round(rng.normal(size=6) * 3, 3) for i in range(25)}
    qdf = spark.createDataFrame([(i, x.tolist()) for i, x in q.items()] + [(99, None)],
                                "question_id int, embedding array<double>")
    vdf = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()] + [(-1, None)],
                                "chunk_id int, embedding array<double>")
    for block in (32 << 20, 600):
        got = knn_codes(qdf, vdf, 7, metric, block_bytes=block)
        assert {(r.question_id, r.chunk_id, r.rank) for r in got.collect()} == brute(q, v, 7, metric)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for scale in (1e-3, 1.0, 1e4):
        q, v = rng.normal(size=(40, 9)) * scale, rng.normal(size=(50, 9)) * scale + scale
        for metric in ("l2", "ip", "cosine"):
            a, b = (_unit(q), _unit(v)) if metric == "cosine" else (q, v)
            codes = Codes(b.min(axis=0), b.max(axis=0))
            qc, vc = codes.decode(codes.encode(a)), codes.decode(codes.encode(b))
            low, high = bounds(qc, np.linalg.norm(a - qc, axis=1), vc,
                               np.linalg.norm(b - vc, axis=1), "l2" if metric == "l2" else "ip")
            true = (np.square(a[:, None] - b[None]).sum(axis=2) if metric == "l2" else 1 - a @ b.T)
            assert (low <= true).all() and (true <= high).all()
            # tight where both sides lie within the limits of the codes
            miss = np.linalg.norm(b - vc, axis=1)
            low, high = bounds(vc, miss, vc, miss, "l2" if metric == "l2" else "ip")
            if metric == "l2":
                true = np.square(b[:, None] - b[None]).sum(axis=2)
                assert np.median(high - low) < 0.05 * np.median(true)


def test_same_as_the_scan_and_plan_without_replicated_vectors(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    args = dict(query_id="query_id", vector_id="vec_id")
    a = knn(q, e, 10, **args).select("query_id", "vec_id", "rank")
    got = knn_codes(q, e, 10, block_bytes=8 << 10, **args).select("query_id", "vec_id", "rank")
    assert a.exceptAll(got).count() == 0 and got.count() == a.count()
    none = knn_codes(q, e.limit(0), 10, **args)
    assert none.count() == 0 and knn_codes(q.limit(0), e, 10, **args).count() == 0
    assert knn_codes(q, e, 0, **args).count() == 0
