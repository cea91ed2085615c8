"""Search forms beyond the broadcast limit, far vectors, ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.operators.ivf import knn_ivf
from ragloom.operators.knn import knn, topk_block


def brute(Q, V, ids, k, digits=9):
    out = []
    for i, q in enumerate(Q):
        d = np.round(((q - V) ** 2).sum(1), digits)
        for j in np.lexsort((ids, d))[:k]:
            out.append((i, int(ids[j])))
    return out


@pytest.mark.parametrize("centre,spread", [(0, 1), (1e5, 0.01), (1e6, 0.01)])
def test_far_vectors_and_ties_keep_every_neighbour(centre, spread):
    rng = np.random.default_rng(0)
    V = centre + spread * rng.normal(size=(400, 64))
    V[:130] = V[0]                                   # a third of the vectors identical
    Q = np.concatenate([V[:40], centre + spread * rng.normal(size=(40, 64))])
    ids = rng.permutation(400)
    r, c, _, _ = topk_block(Q, V, ids, 10, "l2")
    got = sorted(zip(r.tolist(), ids[c].tolist()))
    assert got == sorted(brute(Q, V, ids, 10))


def tables(spark, n=60, nq=7):
    rng = np.random.default_rng(1)
    V, Q = rng.normal(size=(n, 8)), rng.normal(size=(nq, 8))
    v = spark.createDataFrame([(i, f"text {i}", x.tolist()) for i, x in enumerate(V)],
                              "chunk_id int, content string, embedding array<double>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(Q)],
                              "question_id int, embedding array<double>")
    return q, v, sorted(brute(Q, V, np.arange(n), 5))


@pytest.mark.parametrize("with_vectors,payload", [(False, ()), (True, ("content",))])
def test_block_form_with_empty_blocks(spark, with_vectors, payload):
    q, v, want = tables(spark)
    got = knn(q, v, 5, with_vectors=with_vectors, payload=payload, force_blocks=True,
              max_broadcast_bytes=8 * 8 * 2)         # about two rows a block: some are empty
    rows = got.collect()
    assert sorted((r.question_id, r.chunk_id) for r in rows) == want
    assert not payload or all(r.content == f"text {r.chunk_id}" and len(r.cand_vec) == 8 for r in rows)


def test_ivf_with_unprobed_cells(spark):
    q, v, want = tables(spark)
    few = knn_ivf(q.limit(1), v, 5, 8, 1, with_vectors=True, payload=("content",)).collect()
    assert few and all(r.content == f"text {r.chunk_id}" for r in few)
    every = knn_ivf(q, v, 5, 8, 8, with_vectors=True, payload=("content",))
    assert sorted((r.question_id, r.chunk_id) for r in every.collect()) == want


@pytest.mark.parametrize("probe", [1, 3])
def test_exact_cell_pruning(spark, probe):
    q, v, want = tables(spark)
    got = knn_ivf(q, v, 5, 8, probe, with_vectors=True, payload=("content",), exact=True).collect()
    assert sorted((r.question_id, r.chunk_id) for r in got) == want
    assert all(r.content == f"text {r.chunk_id}" for r in got)
    few = v.limit(3)                                  # fewer vectors than k
    assert knn_ivf(q, few, 5, 2, 1, exact=True).count() == 7 * 3
