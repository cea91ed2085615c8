"""S3 question_load, S4 vector_scan, S5 answers_scan, S6 prompt_scan, S7 dataset_scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX

ANSWERS_SCHEMA = T.StructType([T.StructField("Question_ID", T.StringType()),
                               T.StructField("Answer_ID", T.StringType()),
                               T.StructField("Task", T.StringType())])
TRUTH_SCHEMA = T.StructType([T.StructField("Question_ID", T.StringType()),
                             T.StructField("Answer_ID", T.StringType())])
QUESTION_FILE_TYPE = "map<string,map<string,string>>"


def questions_from_json(raw: DataFrame, value: str = "value") -> DataFrame:
    """One JSON object ``{"question N": {"question": .., "option 1": .., ...}}`` per row
    -> questions(question_id, ordinal, question, options, answer, explanation).

    Record order is kept: ``from_json`` builds the map in document order and
    ``posexplode`` numbers it; options keep their order inside the record (H11).
    """
    # a malformed file fails the job instead of giving no rows (H9)
    m = F.from_json(F.col(value), QUESTION_FILE_TYPE, {"mode": "FAILFAST"})
    e = raw.select(F.posexplode(F.map_entries(m)).alias("ordinal", "e"))
    rec = F.col("e.value")
    return e.select(
        TX.question_number(F.col("e.key")).alias("question_id"),
        F.col("ordinal").cast("int").alias("ordinal"),
        rec["question"].alias("question"),
        TX.option_entries(rec).alias("options"),
        rec["answer"].alias("answer"),
        rec["explanation"].alias("explanation"))


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """S3: the reference's question file (one JSON object per file)."""
    q = questions_from_json(spark.read.text(path, wholetext=True))
    # a file is one row and one task: spread its questions
    return q.repartition(spark.sparkContext.defaultParallelism, "question_id")


def read_vectors(spark: SparkSession, path: str, columns=("chunk_id", "embedding"),
                 limit: int | None = None, offset: int = 0) -> DataFrame:
    """The vector table with chosen columns; ``limit``/``offset`` page it in id order."""
    df = spark.read.parquet(path).select(*columns)
    if limit is None and offset == 0:
        return df
    df = df.orderBy("chunk_id")
    if offset:
        df = df.offset(offset)
    return df.limit(limit) if limit is not None else df


def read_answers(spark: SparkSession, path: str, truth: bool = False) -> DataFrame:
    """Prediction / truth CSV with a header, read as strings (H4)."""
    return spark.read.schema(TRUTH_SCHEMA if truth else ANSWERS_SCHEMA).option("header", True) \
        .csv(path)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompts written by an earlier stage."""
    return spark.read.parquet(path)


def read_dataset(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The split training set; a ``split`` filter prunes partitions."""
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df
