"""Block form of the exact search: bounded blocks, repeated ids, cells, codes."""

import numpy as np
from pyspark.sql import functions as F

from ragloom.operators import blocks as B
from ragloom.operators import ivf, knn as K, vafile


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_repeated_ids_and_copies_equal_the_broadcast_form(spark):
    rng = np.random.default_rng(5)
    V = np.round(rng.normal(size=(60, 8)), 3)
    V[20:45] = V[20]                                  # more copies than k
    v = spark.createDataFrame([(i // 2, f"t{i}", x.tolist()) for i, x in enumerate(V)]
                              + [(None, "null", V[3].tolist())],
                              "chunk_id int, content string, embedding array<double>").where("chunk_id is not null")
    q = spark.createDataFrame([(i, V[20 + i % 3].tolist()) for i in range(9)] + [(50, None)],
                              "question_id int, embedding array<double>")
    for metric in K.METRICS:
        a, b = (K.knn(q, v, 4, metric, with_vectors=True, payload=("content",), force_blocks=f) for f in (False, True))
        assert rows(a, "question_id", "chunk_id", "rank") == rows(b, "question_id", "chunk_id", "rank")
        got = b.collect()
        assert all(np.allclose(V[int(r.content[1:])], r.cand_vec) for r in got)
        assert all(int(r.content[1:]) // 2 == r.chunk_id for r in got)


def test_many_queries_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(K, "MAX_BROADCAST_QUERIES", 5)
    v = spark.range(40).select(F.col("id").alias("chunk_id"),
                               F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    q = v.withColumnRenamed("chunk_id", "question_id")
    called = []
    real = B.knn_blocks
    monkeypatch.setattr(B, "knn_blocks", lambda *a: called.append(1) or real(*a))
    got = K.knn(q, v, 1)
    assert called and all(r.question_id == r.chunk_id for r in got.collect())


def test_grid_bounds_blocks_and_keeps_slots_busy():
    for n in (100_000, 600_000, 6_000_000):
        a, b = B.grid(n, n, 256, 12, B.BLOCK_BYTES)
        assert a * b >= 48 and n / a * 256 <= 1.01 * B.BLOCK_BYTES and n / b * 256 <= 1.01 * B.BLOCK_BYTES
    assert B.grid(3, 5, 256, 12, B.BLOCK_BYTES) == (1, 1)


def test_scan_of_long_and_short_vectors():
    rng = np.random.default_rng(2)
    V = rng.normal(size=(5000, 6))
    V[7] *= 1e4
    for metric in K.METRICS:
        W = B._unit(V) if metric == "cosine" else V
        Q = W[:300]
        r, c = B.scan(B.Tiles(W, metric == "l2"), Q, 5, metric == "l2", 9)
        d = np.round(K._exact(Q[r], W[c], metric), 9)
        keep = K._first_k_per_row(r, [d, c], 5)
        R, C, _, _ = K.topk_block(Q, W, np.arange(len(W)), 5, metric)
        assert sorted(zip(r[keep], c[keep])) == sorted(zip(R, C))
        assert len(r) < 20 * len(Q) or metric == "ip"


def test_queries_are_moved_once_a_block_not_once_a_cell(spark, monkeypatch):
    moved = []
    real = B.dealt
    monkeypatch.setattr(B, "dealt", lambda l, r, a, b: moved.append((a, b)) or real(l, r, a, b))
    rng = np.random.default_rng(1)
    V = rng.normal(size=(200, 8))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(V)], "chunk_id int, embedding array<double>")
    q = v.withColumnRenamed("chunk_id", "question_id")
    got = ivf.knn_ivf(q, v, 5, 14, 3, exact=True)
    want = K.knn(q, v, 5)
    assert rows(got, "question_id", "chunk_id", "rank") == rows(want, "question_id", "chunk_id", "rank")
    assert moved == [(1, 1), (1, 1)]


def test_code_blocks_are_small_enough_for_the_slots(spark, monkeypatch):
    moved = []
    real = vafile.dealt
    monkeypatch.setattr(vafile, "dealt", lambda l, r, a, b: moved.append((a, b)) or real(l, r, a, b))
    monkeypatch.setattr(B, "PAIRS", 1 << 8)
    v = spark.range(300).select(F.col("id").alias("chunk_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    q = v.withColumnRenamed("chunk_id", "question_id")
    got = vafile.knn_codes(q, v, 3)
    want = K.knn(q, v, 3)
    assert rows(got, "question_id", "chunk_id", "rank") == rows(want, "question_id", "chunk_id", "rank")
    assert min(moved[0]) > 1


def test_blocks_move_in_rounds(spark, monkeypatch):
    moved = []
    real = B.dealt
    monkeypatch.setattr(B, "dealt", lambda l, r, a, b: moved.append(a * r.count() + b * l.count()) or real(l, r, a, b))
    rng = np.random.default_rng(4)
    V = rng.normal(size=(400, 8))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(V)], "chunk_id int, embedding array<double>")
    q = v.where("chunk_id < 300").withColumnRenamed("chunk_id", "question_id")
    got = B.knn_blocks(q, v, 3, block_bytes=640)          # 20 rows a block: 15 x 20 pairs of blocks
    assert len(moved) > 2 and max(moved) <= 1.5 * B.ROUND * 700
    assert rows(got, "question_id", "chunk_id", "rank") == rows(K.knn(q, v, 3), "question_id", "chunk_id", "rank")


def test_written_leaves_no_shuffle_files(spark):
    from pathlib import Path

    def files():
        return {f for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
                for f in Path(d).rglob("shuffle_*")}

    was, conf = files(), spark.conf.get(B._CLEANUP, None)
    df = B.written(spark.range(5000).repartition(3, "id").withColumn("x", F.col("id") % 7), "kept")
    assert df.count() == 5000 and not {f for f in files() - was if f.stat().st_size > 1000}
    assert spark.conf.get(B._CLEANUP, None) == conf
