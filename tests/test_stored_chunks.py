"""The stored chunk table, pages, ranks of large groups and one model call per prompt."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ragloom.functions import models as MD
from ragloom.functions.embed import hash_embedding
from ragloom.operators import order as OR
from ragloom.plans import retrieve as RT
from ragloom.sinks.chunks import read_page, store_chunks, write_pages


@pytest.fixture(scope="module")
def chunks(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = [(f"c{i:03d}", " ".join(rnd.choice(words) for _ in range(12)), i % 4) for i in range(200)]
    rows[7] = ("c007", rows[3][1], 1)          # same content twice
    df = spark.createDataFrame(rows, "chunk_id string, content string, grp int")
    return df.withColumn("embedding", hash_embedding(F.col("content"))).checkpoint()


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(i, f"w{i} w{i + 7} w{i + 20}") for i in range(9)],
                                 "question_id int, question string")


@pytest.mark.parametrize("options", [{}, {"use_mmr": False}, {"use_similarity": False},
                                     {"ivf_cells": 4, "ivf_nprobe": 4}])
def test_late_fetch_equals_payload(spark, chunks, questions, options):
    stored = store_chunks(chunks, buckets=4)
    cfg = dict(k=8, fetch_k=12, top_n=4, **options)
    a = RT.retrieve(questions, chunks, RT.RetrieverConfig(**cfg), chunk_filter=F.col("grp") < 3)
    b = RT.retrieve(questions, stored, RT.RetrieverConfig(late=True, **cfg),
                    chunk_filter=F.col("grp") < 3)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_no_text_below_the_merge(spark, chunks, questions):
    stored = store_chunks(chunks, buckets=4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = RT.retrieve(questions, stored, RT.RetrieverConfig(k=8, fetch_k=8, late=True))
        plan = hits._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    scans = re.findall(r"ReadSchema: struct<([^\n]*)>", plan)
    assert len(scans) == 2 and "Bucketed: true" in plan
    merged = next(s for s in scans if "content" not in s)
    assert "embedding" in merged
    # what is shuffled before the join with the table: ids, distances, keys
    below = plan[:plan.index(merged)].rsplit("SortMergeJoin", 1)[1]
    assert "content" not in below.split("FileScan")[0]


def test_pages_equal_slices(spark, tmp_dir):
    ids = list(range(0, 3000, 3))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(i, [float(i)]) for i in ids], "chunk_id int, embedding array<double>")
    write_pages(df.repartition(6), f"{tmp_dir}/p")
    want = sorted(ids)
    for offset, limit in ((0, 10), (333, 250), (995, 50), (1000, 5), (2000, 5)):
        got = [r.chunk_id for r in read_page(spark, f"{tmp_dir}/p", limit=limit, offset=offset).collect()]
        assert got == want[offset:offset + limit]
    page = read_page(spark, f"{tmp_dir}/p", ("chunk_id",), limit=5, offset=990)
    parts = re.search(r"_part#\d+ IN \(([^)]*)\)|_part#\d+ = (\d+)",
                      page._jdf.queryExecution().executedPlan().toString())
    assert parts and len((parts[1] or parts[2]).split(",")) == 1      # one range is read
    write_pages(df.limit(0), f"{tmp_dir}/none")
    assert read_page(spark, f"{tmp_dir}/none").count() == 0


def test_group_rank_of_a_large_group(spark):
    rows = [(None if i % 50 == 0 else 1 if i % 3 else i % 7, (i * 7919) % 6000, "x") for i in range(6000)]
    df = spark.createDataFrame(rows, "g int, o int, rank string").repartition(9)
    got = OR.group_rank(df, ["g"], ["o"], "place").collect()
    groups = {}
    for g, o, _ in rows:
        groups.setdefault(g, []).append(o)
    places = {(g, o): n + 1 for g, os in groups.items() for n, o in enumerate(sorted(os))}
    assert {(r.g, r.o): r.place for r in got} == places and len(got) == 6000
    assert OR.group_rank(df.limit(0), ["g"], ["o"]).count() == 0


def test_multi_query_with_many_variants(spark, chunks):
    words = [f"w{i % 60} w{(i * 7) % 60}" for i in range(2000)]
    variants = spark.createDataFrame([("q", n + 1, w) for n, w in enumerate(words)] + [("r", 1, "w5")],
                                     "question_id string, variant_no int, question string")
    cfg = RT.RetrieverConfig(k=2, use_mmr=False, dedup=False, rerank=False, reorder=False)
    hits = RT.retrieve(variants.where("question_id = 'q'").select(
        F.col("variant_no").alias("question_id"), "question"), chunks, cfg)
    seen = []
    for r in hits.orderBy("question_id", "rank").collect():
        if r.chunk_id not in seen:
            seen.append(r.chunk_id)
    got = RT.multi_query(variants, chunks, cfg)
    assert [r.chunk_id for r in got.where("question_id = 'q'").orderBy("rank").collect()] == seen
    assert got.where("question_id = 'r'").count() == 2


def test_multi_query_ranks_without_texts(spark, chunks, monkeypatch):
    variants = spark.createDataFrame([("q", 1, "w5 w9"), ("q", 2, "w9 w30"), ("r", 1, "w7"), (None, 1, "w8 w1")],
                                     "question_id string, variant_no int, question string")
    seen = []
    real = OR.group_rank
    monkeypatch.setattr(OR, "group_rank", lambda df, *a: seen.extend(df.columns) or real(df, *a))
    cfg = RT.RetrieverConfig(k=4, use_mmr=False, dedup=False, rerank=False, reorder=False)
    got = RT.multi_query(variants, chunks, cfg).collect()
    assert seen and "content" not in seen
    text = {r.chunk_id: r.content for r in chunks.collect()}
    assert all(r.content == text[r.chunk_id] and r.distance is not None for r in got)
    assert sorted(r["rank"] for r in got if r.question_id == "r") == [1, 2, 3, 4]
    assert sum(r.question_id is None for r in got) == 4


def test_model_is_asked_once_per_prompt(spark, tmp_dir):
    df = spark.range(400).select("id", F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(
        F.concat(F.lit("p" * 3), (F.col("id") % 7).cast("string"))).alias("prompt")).repartition(8)

    def make():
        import os
        import uuid

        def gen(prompts, n):
            with open(os.path.join(tmp_dir, uuid.uuid4().hex), "w") as f:
                f.write("\n".join(prompts))
            return [f"{p}!" for p in prompts]
        return gen

    got = MD.generate_distinct(df, "once", make=make)
    for _ in range(2):
        assert {(r.id, r.generated) for r in got.collect()} == {
            (r.id, f"{r.prompt or ''}!") for r in df.collect()}
    import pathlib

    asked = [p for f in pathlib.Path(tmp_dir).iterdir() if len(f.name) == 32
             for p in f.read_text().split("\n")]
    assert sorted(asked) == sorted({r.prompt or "" for r in df.collect()})
