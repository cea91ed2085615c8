import hashlib
import math

import pytest
from oracles import completion_mask_oracle
from pyspark.sql import functions as F

from ragloom.operators import evaluate as EV
from ragloom.operators import order as OR
from ragloom.operators import tokens as TK
from ragloom.sources.tables import read_answers


@pytest.fixture()
def answer_files(tmp_dir):
    pred = "Question_ID,Answer_ID,Task\n1,2,Phi-2\n2,3,Phi-2\n3,,Phi-2\n4,1,Phi-2\n5,5,Phi-2\n9,1,Phi-2\n"
    truth = "Question_ID,Answer_ID\n1,2\n2,4\n3,1\n4,1\n5,5\n6,2\n7,3\n8,1\n"
    with open(f"{tmp_dir}/pred.csv", "w") as f:
        f.write(pred)
    with open(f"{tmp_dir}/truth.csv", "w") as f:
        f.write(truth)
    return f"{tmp_dir}/pred.csv", f"{tmp_dir}/truth.csv"


def test_accuracy_strings_and_missing_truth(spark, answer_files):
    pred = read_answers(spark, answer_files[0])
    truth = read_answers(spark, answer_files[1], truth=True)
    r = EV.accuracy(pred, truth).first()
    # 6 predictions, 5 have truth, correct: 1, 4, 5 (the empty answer is wrong, not '2.0')
    assert (r.n_pred, r.n_matched, r.n_correct) == (6, 5, 3)
    assert r.accuracy == pytest.approx(0.6)
    assert EV.truth_semijoin(truth, pred).count() == 5


def test_duplicate_ids_raise(spark):
    df = spark.createDataFrame([("1", "2"), ("1", "3")], "Question_ID string, Answer_ID string")
    with pytest.raises(ValueError):
        EV.check_unique(df)


def test_exact_split_sizes_and_partitions(spark):
    from conftest import SF01

    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id")
    n = docs.count()
    results = []
    for parts in (1, 4, 17):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        s = OR.exact_split(docs.repartition(parts), "doc_id", 0.1, 123)
        rows = {r.doc_id: r.split for r in s.collect()}
        assert len(rows) == n
        assert sum(v == "test" for v in rows.values()) == math.ceil(0.1 * n)
        results.append(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]


def test_batches_and_shards(spark):
    df = spark.range(0, 103).withColumnRenamed("id", "doc_id").repartition(5)
    b = {r.doc_id: r.batch_id for r in OR.fixed_batches(df, 10, [F.col("doc_id")]).collect()}
    assert all(b[i] == i // 10 for i in range(103))
    s = {r.doc_id: r.shard_id for r in OR.balanced_shards(df, 8, [F.col("doc_id")]).collect()}
    assert all(s[i] == i // (103 // 8 + 1) for i in range(103))


def test_sample_n_exact_and_repeatable(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "doc_id")
    a = {r.doc_id for r in OR.sample_n(df, 37, "doc_id").collect()}
    b = {r.doc_id for r in OR.sample_n(df.repartition(7), 37, "doc_id").collect()}
    c = set(sorted((r.doc_id for r in df.collect()), key=lambda i: (hashlib.md5(f"123:{i}".encode()).hexdigest(), i))[:37])
    assert len(a) == 37 and a == b == c
    assert OR.sample_n(df, -1, "doc_id").count() == 500


LABELS = [
    [5, 6, 7, 8, 9],        # no marker
    [1, 2, 7, 3, 4],        # marker [7, 3] in the middle
    [7, 3, 1],              # marker at the start
    [1, 7, 3, 7, 3, 2],     # first marker wins
    [],
    [1, 7],                 # cut marker
]


def test_completion_mask_matches_oracle(spark):
    df = spark.createDataFrame([(i, l) for i, l in enumerate(LABELS)], "i int, labels array<int>")
    got = {r.i: r.labels for r in TK.completion_mask(df, [7, 3]).collect()}
    for i, l in enumerate(LABELS):
        assert got[i] == completion_mask_oracle(l, [7, 3])


def test_tokenize_truncate_keeps_right_end(spark):
    df = spark.createDataFrame([("a b c d e f",), ("x y",)], "prompt string")
    t = TK.tokenize_truncate(df, 4)
    rows = t.collect()
    full = {r.prompt: r.input_ids for r in TK.tokenize(df).collect()}
    for r in rows:
        assert r.input_ids == full[r.prompt][-4:]
        assert r.attention_mask == [1] * len(r.input_ids)
    # the Python tokenizer equals its built-in-expression twin
    sql = {r.prompt: r.ids for r in df.select(
        "prompt", TK.whitespace_tokenizer_sql()(F.col("prompt")).alias("ids")).collect()}
    assert sql == full
    assert TK.response_marker_ids(spark) == full_ids(spark, "### Answer:")


def full_ids(spark, text):
    df = spark.createDataFrame([(text,)], "prompt string")
    return TK.tokenize(df).first().input_ids


def test_accuracy_duplicate_truth_ids_do_not_fan_out(spark):
    pred = spark.createDataFrame([("1", "2")] * 50, "Question_ID string, Answer_ID string")
    truth = spark.createDataFrame([("1", "2")] * 40 + [("2", "1")],
                                  "Question_ID string, Answer_ID string")
    r = EV.accuracy(pred, truth).first()
    assert (r.n_pred, r.n_matched, r.n_correct) == (50, 50, 50)
    assert EV.align_answers(pred, truth).count() == 50


def test_turn_mask(spark):
    rows = [([1, 9, 2, 8, 5, 6], [-100, -100, -100, -100, 5, 6]),       # 9 = instruction, 8 = response
            ([9, 2, 8, 5, 9, 3, 8, 7], [-100, -100, -100, 5, -100, -100, -100, 7]),
            ([2, 8, 5, 9, 3], [-100, -100, 5, -100, -100]),               # cut on the left
            ([2, 8, 5], [-100] * 3), ([9, 2, 5], [-100] * 3), ([], [])]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "i int, labels array<int>")
    got = {r.i: r.labels for r in TK.turn_mask(df, [8], [9]).collect()}
    assert [got[i] for i in range(len(rows))] == [w for _, w in rows]


def test_split_and_sample_with_null_ids(spark):
    df = spark.range(130).select(F.when(F.col("id") >= 30, F.col("id")).alias("id"))
    for n, want in ((0, 0), (25, 25), (99, 99), (100, 100), (130, 130), (-1, 130)):
        got = OR.sample_n(df, n, "id")
        assert got.count() == want and (want == 130 or got.where("id is null").count() == 0)
    assert OR.sample_n(df, 110, "id").count() == 100      # the cut falls among rows without id
    small = df.limit(110)
    for share, want in ((0.5, 55), (0.0, 0), (1.0, 110)):
        split = OR.exact_split(small, "id", share)
        assert split.where("split = 'test'").count() == want and split.count() == 110
