"""A1 accuracy with R12 truth_semijoin and R13 align_answers.

Answers are compared as strings (H4). Predictions are paired with truth by
an equi-join on the id (the reference sorts both and compares positions,
which is the same thing when ids are unique). Duplicate ids are reported
by ``check_unique``, which raises; ``accuracy`` itself reduces the truth
table to one row per id before joining, so no id can fan out into pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ID = "Question_ID"
ANS = "Answer_ID"


def truth_semijoin(truth: DataFrame, pred: DataFrame, id_col: str = ID) -> DataFrame:
    """Truth rows whose id was predicted."""
    return truth.join(pred.select(id_col), id_col, "left_semi")


def truth_by_id(truth: DataFrame, id_col: str = ID, ans: str = ANS) -> DataFrame:
    """One truth row per id (partial aggregation on the map side), so repeated
    ids can never multiply into pairs in a join; an id with conflicting
    answers gets a NULL answer and so never counts as correct."""
    t = truth.select(F.col(id_col).cast("string").alias(id_col),
                     F.col(ans).cast("string").alias("a"))
    return (t.groupBy(id_col).agg(F.min("a").alias("actual"), F.max("a").alias("_hi"))
            .select(id_col, F.when(F.col("actual") == F.col("_hi"), F.col("actual"))
                    .alias("actual")))


def align_answers(pred: DataFrame, truth: DataFrame, id_col: str = ID, ans: str = ANS) -> DataFrame:
    """(id, predicted, actual, correct) for ids present on both sides."""
    p = pred.select(F.col(id_col).cast("string").alias(id_col),
                    F.col(ans).cast("string").alias("predicted"))
    return (p.join(truth_by_id(truth, id_col, ans), id_col, "inner")
            .withColumn("correct", F.coalesce(F.col("predicted") == F.col("actual"), F.lit(False))))


def accuracy(pred: DataFrame, truth: DataFrame, id_col: str = ID, ans: str = ANS) -> DataFrame:
    """A1: one row ``n_pred, n_matched, n_correct, accuracy`` (accuracy over matched ids)."""
    p = pred.select(F.col(id_col).cast("string").alias(id_col),
                    F.col(ans).cast("string").alias("predicted"))
    t = truth_by_id(truth, id_col, ans).withColumn("_m", F.lit(1))
    agg = p.join(t, id_col, "left_outer").agg(
        F.count(F.lit(1)).alias("n_pred"),
        F.count("_m").alias("n_matched"),
        F.count_if(F.col("predicted") == F.col("actual")).alias("n_correct"))
    return agg.select("n_pred", "n_matched", "n_correct",
                      F.when(F.col("n_matched") > 0,
                             F.round(F.col("n_correct") / F.col("n_matched"), 6)).alias("accuracy"))


def check_unique(df: DataFrame, id_col: str = ID) -> None:
    """Raise if an id occurs twice (H5)."""
    dup = df.groupBy(id_col).count().where(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"duplicate {id_col}: {dup[0][id_col]!r}")
