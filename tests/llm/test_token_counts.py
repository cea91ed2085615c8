"""Token counts against the library."""

import random

import pytest

from ragloom.llm import token_counts

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def made():
    path = token_counts.default_path()
    whole = token_counts.whole_tokens(path)
    return path, whole, token_counts._load(path)


def test_whole_tokens_are_proven(made):
    _, whole, model = made
    assert len(whole) > 10_000
    for w in random.Random(0).sample(sorted(whole), 2000):
        assert len(model.encode(w)) == 1 and len(model.encode(f"x {w}")) == len(model.encode("x")) + 1
    assert token_counts.crossing_pieces(["▁a", "b", "▁▁"]) == []
    assert token_counts.crossing_pieces(["a▁b", "a▁"]) == ["a▁b", "a▁"]


def test_counts_equal_the_library(made):
    path, whole, model = made
    rnd = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "\t", "▁", "é", "<s>", "</s>", "<unk>", "🙂", "中文", "½",
             "\x00", ".", ",", "ing", "\u00a0", "x" * 300, "\u200d", "<0x0A>", "\u3000"]
    for room in (token_counts.TABLE_BYTES, 500):
        count = token_counts.TokenCounter(path, whole, room).count
        for _ in range(6000):
            text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
            assert count(text) == len(model.encode(text)), text


def test_count_tokens_whole_table(spark, made):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in token_counts.count_tokens(docs).collect()}
    for r in docs.collect():
        text = r.text or ""
        n = len(made[2].encode(text))
        assert got[r.doc_id] == (r.doc_id, len(text.encode()), n, n > 4096)


def test_count_tokens_odd(spark):
    schema = "doc_id long, text string, _id string, _text int, n_bytes string"
    long = "palabra antidisestablishment " * 40_000
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, long), (5, "x"), (5, "x"), (None, "a b")]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], schema)
    got = sorted((tuple(r) for r in token_counts.count_tokens(df).collect()),
                 key=lambda r: (r[0] or 0, r[1]))
    assert [r[:2] for r in got] == [(None, 3), (1, 0), (2, 0), (3, 5), (4, len(long)), (5, 1), (5, 1)]
    assert [r[2] for r in got][1:3] == [0, 0] and got[4][3] and not got[0][3]
    assert token_counts.count_tokens(df.limit(0)).count() == 0
