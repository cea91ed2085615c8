"""Corpus pipeline: language, quality, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
documents they keep, with the columns they came with, whatever those are.

* language_id: language bundles are learned from the input's labelled rows; a
  document whose language cannot be told (no letter) goes.
* quality_rules: documents that fail the base rules or lie far from their language
  and source go.
* ngram_jaccard: of each group of linked documents (five words, 80 percent) that with
  the smallest id stays.
* benchmark_leaks: documents that repeat a benchmark item go.
* best_fit_packing: one row per piece of the documents that are left.

Rows with a null id are kept by the first three stages as documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm import decontaminate, jaccard_join, langid, packing, quality_rules
from ragloom.llm.common import written
from ragloom.session import ensure_checkpoint_dir, ship_package

#: Ids up to this many are broadcast (16 MB), more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Near duplicates share this percentage of their n-grams of so many words.
NEAR_PERCENT, NEAR_WIDTH = 80, 5


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    bundles = langid.profiles(docs)
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)],
                        F.col("text").alias("_text"))
    found = langid.identify(plain, bundles, text_col="_text")
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select(
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    judged = quality_rules.judge_quality(docs)
    # the verdict depends on text, language and source, so rows that share an id are
    # told apart by what was counted; only ids that lose some row need that
    gone = written(judged.where(~F.col("kept")).select(
        F.col("doc_id").alias("_gone")).distinct(), "rejected")
    both = judged.where("kept and doc_id is not null").join(
        gone, F.col("doc_id") == F.col("_gone"), "left_semi").limit(1).count()
    if both or gone.where("_gone is null").limit(1).count():
        return _by_row(docs)
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["_gone"],
                     "left_anti")


def _by_row(docs: DataFrame) -> DataFrame:
    """Quality verdicts by the row's own number, for ids that repeat or are null."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    judged = quality_rules.judge_quality(numbered, id_col=row)
    return numbered.join(judged.where("kept").select(row), row, "left_semi").drop(row)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return jaccard_join.keep_one(docs, percent=NEAR_PERCENT, width=NEAR_WIDTH)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return decontaminate.decontaminated(docs, spark.read.parquet(
        f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("quality_rules", quality),
          ("ngram_jaccard", ngram_jaccard), ("benchmark_leaks", benchmark_leaks),
          ("best_fit_packing", best_fit_packing)]

#: Learned profiles, robust estimates and tokenisation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    _ready(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
