"""The id index: no id lost, none twice, few ids read."""

import random

import numpy as np
from pyspark.sql import functions as F

from ragloom.sinks import tables as SK
from ragloom.sinks.idindex import IdIndex, filter_bits, may_hold


def test_filter():
    rng = np.random.default_rng(0)
    h = rng.integers(-2**63, 2**63 - 1, size=(2, 30_000), dtype=np.int64)
    data = filter_bits(h[0, :5000], h[1, :5000])
    hit = may_hold(data, h[0], h[1])
    assert hit[:5000].all() and hit[5000:].mean() < 0.001
    assert may_hold(filter_bits(h[0, :1], h[1, :1]), h[0, :1], h[1, :1]).all()


def ids(spark, numbers, tag="x"):
    return spark.createDataFrame([(f"c{n}", f"{tag} {n}") for n in numbers], "chunk_id string, text string")


def test_appends_equal_sets(spark, tmp_dir):
    rnd, have = random.Random(4), {}
    for step in range(5):
        numbers = [rnd.randrange(900) for _ in range(300)]
        added = SK.vector_append(ids(spark, numbers, f"t{step}"), tmp_dir)
        fresh = {n for n in numbers if n not in have}
        assert added == len(fresh)
        have |= dict.fromkeys(fresh, step)
        if step == 2:       # a new version without some ids, which may come again
            gone = sorted(have)[:40]
            SK.vector_delete(spark, tmp_dir, ids(spark, gone))
            for n in gone:
                del have[n]
        if step == 3:       # rows written by other means are found
            SK.read_current(spark, tmp_dir)
            ids(spark, [5000]).write.mode("append").parquet(f"{tmp_dir}/v={SK.versions(spark, tmp_dir)[-1]}")
            have[5000] = None
            assert SK.vector_append(ids(spark, [5000]), tmp_dir) == 0
    got = [r.chunk_id for r in SK.read_current(spark, tmp_dir).collect()]
    assert sorted(got) == sorted(f"c{n}" for n in have)


def test_few_ids_are_read(spark, tmp_dir):
    SK.vector_append(ids(spark, range(4000)), tmp_dir)
    reads = {}
    assert SK.vector_append(ids(spark, range(10_000, 12_000)), tmp_dir, reads=reads) == 2000
    assert reads["ids"] == 4000 and reads["ids_read"] < 1000
    assert SK.vector_append(ids(spark, [7, 20_000]), tmp_dir, reads=reads) == 1
    assert reads["buckets_read"] <= 2 and 0 < reads["ids_read"] < 1500
    plan = IdIndex(spark, tmp_dir, 1, "chunk_id")
    assert plan._ids("string").count() == 6001


def test_odd_keys(spark, tmp_dir):
    rows = [(None, "a"), (None, "b"), (3, "x"), (3, "y"), (4, None)]
    df = spark.createDataFrame(rows, "k long, t string")
    assert SK.vector_append(df, tmp_dir, key="k") == 3
    kept = {r.k: r.t for r in SK.read_current(spark, tmp_dir).collect()}
    again = {r.k: r.t for r in SK._one_per_key(df.orderBy(F.desc("t")), "k").collect()}
    assert kept == again and set(kept) == {None, 3, 4}
    assert SK.vector_append(df, tmp_dir, key="k") == 0
    assert SK.vector_append(df.limit(0), tmp_dir, key="k") == 0
    assert SK.vector_append(spark.createDataFrame([(9, "z")], "k long, t string"), tmp_dir, key="k") == 1
