"""Whitening against a dense eigensolver and exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.llm import whitening

SF = "/root/testdata/sf0.01"


def scaled(vecs):
    return [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vecs]


def test_whiten_equals_dense(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(5)
    rows = df.collect()
    x = scaled([r.embedding for r in rows])
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums)] for v in x])
    e, vecs = np.linalg.eigh(centred.T @ centred / n)
    e, vecs = e[::-1], vecs[:, ::-1]
    got = {}
    for r in whitening.whiten(df).collect():
        got[r.vec_id, r.component] = r
    assert len(got) == 8 * n
    sign = {}
    for row, v, c in zip(rows, x, centred):
        for k in range(8):
            r = got[row.vec_id, k + 1]
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(v, sums))
            want = c @ vecs[:, k] / math.sqrt(e[k])
            s = sign.setdefault(k, 1 if r.whitened * want > 0 else -1)
            assert r.whitened == pytest.approx(s * want, abs=1e-9)
            assert r.explained == pytest.approx(e[k] / e.sum(), rel=1e-10)
            assert 0 <= r.identity_error < 1e-9


@pytest.mark.parametrize("d,n,kind", [(64, 500, "plain"), (8, 20, "plain"), (5, 3, "plain"),
                                      (64, 900, "graded"), (30, 400, "equal"), (40, 300, "half"),
                                      (1, 9, "plain"), (2, 9, "plain"), (20, 200, "rank2")])
def test_solver(d, n, kind):
    rng = np.random.default_rng(d + n)
    x = rng.normal(size=(n, d))
    if kind == "graded":
        x *= np.logspace(0, -8, d)
    if kind == "half":
        x[:, d // 2:] = 0
    if kind == "rank2":
        x = x[:, :1] @ np.ones((1, d)) + x[:, 1:2] @ rng.normal(size=(1, d))
    x -= x.mean(axis=0)
    if kind == "equal":
        x = np.linalg.qr(x)[0]
    r = np.zeros((d, d))
    q = np.linalg.qr(x, mode="r")
    r[:len(q)] = q
    vecs, values, shares = whitening.whitening(r, n, 8)
    want = np.linalg.svd(x, compute_uv=False) ** 2
    assert len(values) == {"rank2": 2}.get(kind, min(8, d, n - 1))
    assert np.allclose(values, want[:len(values)] / n, rtol=1e-12)
    assert np.allclose(shares, want[:len(values)] / want.sum(), rtol=1e-12)
    w = x @ vecs / np.sqrt(values)
    assert np.abs(w.T @ w / n - np.eye(len(values))).max() < 1e-11
    cov = x.T @ x / n
    assert np.abs(cov @ vecs - vecs * values).max() < 1e-12 * values[0]


def test_qd_small_values_are_accurate():
    a, b = np.array([1.0, 1e-5, 1e-9, 1e-14]), np.array([1e-2, 1e-7, 1e-12])
    got = whitening.squared_singular_values(a, b)
    exact = np.prod([Fraction(v) for v in a]) ** 2
    product = np.prod([Fraction(v) for v in got.tolist()])
    assert abs(float(product / exact) - 1) < 1e-12


ODD = "vec_id long, embedding array<float>, _v int, _id string, n int"


def test_whiten_odd(spark):
    rows = [(1, [0.5, 1.0]), (2, [0.25, -1.0]), (2, [0.25, -1.0]), (None, [3.0, 0.0]), (3, None),
            (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []),
            (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], ODD)
    got = whitening.whiten(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [
        (0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2)]
    assert {r.n for r in got} == {4}
    for part in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id = 2"), df.where("vec_id = 3")):
        assert whitening.whiten(part).count() == 0
    big = df.where("vec_id in (1, 2)").withColumn(
        "embedding", F.transform("embedding", lambda c: (c * 1e30).cast("float")))
    assert {r.deviation for r in whitening.whiten(big).collect()} == {None}
