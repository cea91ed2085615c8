"""BM25 against brute force."""

import math
from collections import Counter

import pytest

from ragloom.operators import hits as H
from ragloom.operators import lexical as LX


def brute(questions, chunks, k):
    docs = {i: (t or "").split() for i, t in chunks}
    df = Counter(w for ws in docs.values() for w in set(ws))
    mean = sum(map(len, docs.values())) / max(1, len(docs))
    out = {}
    for q, text in questions:
        scores = {}
        for i, ws in docs.items():
            tf = Counter(ws)
            hit = set((text or "").split()) & set(ws)
            if hit:
                scores[i] = round(sum(
                    math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2
                    / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in hit), 6)
        out[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


CHUNKS = [(i, " ".join(f"w{(i * j) % 17}" for j in range(1, 4 + i % 9)) + " common") for i in range(80)]
CHUNKS += [(100, None), (101, ""), (102, "common " * 3000), (103, "common w1"), (104, "common w1")]
QUESTIONS = [(1, "w1 w2 w2 common"), (2, "nothing known"), (3, None), (4, ""), (5, "w5"), (6, "common")]


@pytest.mark.parametrize("salts", [None, 5])
def test_equals_brute_force(spark, tmp_dir, salts):
    c = spark.createDataFrame([(*r, "x") for r in CHUNKS], "chunk_id int, content string, h string")
    q = spark.createDataFrame([(*r, 1) for r in QUESTIONS], "question_id int, question string, tf int")
    LX.build_index(c, f"{tmp_dir}/i")
    got = {}
    for r in LX.search(q, f"{tmp_dir}/i", 6, salts=salts).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append((r.chunk_id, r.score))
    want = {k: v for k, v in brute(QUESTIONS, CHUNKS, 6).items() if v}
    assert {k: [i for i, _ in v] for k, v in got.items()} == {k: [i for i, _ in v] for k, v in want.items()}
    assert all(abs(a[1] - b[1]) < 2e-6 for k in want for a, b in zip(got[k], want[k]))
    hits = LX.retriever(f"{tmp_dir}/i", c, 3)(q)
    merged = H.merge_interleave(hits, hits.where("question_id = 1"))
    assert merged.where("question_id = 1").count() == 6


def test_empty(spark, tmp_dir):
    c = spark.createDataFrame([], "chunk_id int, content string")
    q = spark.createDataFrame(QUESTIONS, "question_id int, question string")
    LX.build_index(c, f"{tmp_dir}/e")
    assert LX.search(q, f"{tmp_dir}/e", 6).count() == 0


def test_few_questions_move_each_posting_once(spark, tmp_dir, monkeypatch):
    chunks = CHUNKS + [(103, "w1 again"), (None, "common w5")]       # a repeated and a missing id
    c = spark.createDataFrame(chunks, "chunk_id int, content string")
    q = spark.createDataFrame(QUESTIONS + [(1, "w1 w3"), (None, "w5")], "question_id int, question string")
    LX.build_index(c, f"{tmp_dir}/m")
    kept = lambda df: sorted(map(tuple, df.collect()), key=str)     # noqa: E731
    monkeypatch.setattr(LX, "CELLS", 8)
    few = LX.search(q, f"{tmp_dir}/m", 6)
    assert kept(few) == kept(LX.search(q, f"{tmp_dir}/m", 6, salts=2))
    assert "MapInArrow" in few._jdf.queryExecution().toString()
    monkeypatch.setattr(LX, "MAX_QUESTIONS", 2)
    many = LX.search(q, f"{tmp_dir}/m", 6)
    assert kept(few) == kept(many) and "MapInArrow" not in many._jdf.queryExecution().toString()
