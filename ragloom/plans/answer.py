"""Answering and scoring (E4-E6, P8, P9, P12, A1) and the load-docs job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models as MD
from ..functions import prompts as PR
from ..functions import text as TX
from ..operators import evaluate as EV
from ..operators import hits as H
from ..operators.split import add_release_metadata, chunk_documents
from ..sinks.tables import vector_append
from ..sources.files import load_documents

QID = "question_id"


def answer_questions(prompts: DataFrame, generator: str, task: str = "",
                     max_new_tokens: int = 4, batch_size: int = 128,
                     make: Callable | None = None) -> DataFrame:
    """E4 + P8 + P9: prompts(question_id, prompt) -> (Question_ID, Answer_ID, Task); the
    model is asked once per distinct prompt."""
    out = MD.generate_distinct(
        prompts.select(F.col(QID).cast("string").alias("Question_ID"), "prompt"), generator,
        out="_g", max_new_tokens=max_new_tokens, batch_size=batch_size, make=make)
    return out.select("Question_ID", TX.answer_parse(F.col("_g")).alias("Answer_ID"),
                      F.lit(task).alias("Task"))


def score_answers(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """A1 (with R12/R13): one row of counts and accuracy; an id that occurs twice on
    either side raises (H5)."""
    EV.check_unique(pred)
    EV.check_unique(truth)
    return EV.accuracy(pred, truth)


def compress_documents(hits: DataFrame, questions: DataFrame, generator: str,
                       max_word_count: int = 512, make: Callable | None = None) -> DataFrame:
    """E5: all hits of a question -> one synthetic chunk: contents joined by a
    space, P6 prompt, generated, chat markers removed (T8)."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "content")))
    ctx = hits.groupBy(QID).agg(F.array_join(F.transform(ordered, lambda s: s["content"]), " ")
                                .alias("context"))
    p = ctx.join(questions.select(QID, "question"), QID).select(
        QID, PR.compress_prompt(F.col("context"), F.col("question"), max_word_count).alias("prompt"))
    gen = MD.generate(F.col("prompt"), generator, max_word_count, make=make)
    return p.select(QID, F.lit(1).alias("rank"),
                    TX.strip_special_tokens(gen).alias("content"))


def answer_as_document(hits: DataFrame, questions: DataFrame, generator: str,
                       max_new_tokens: int = 32, make: Callable | None = None) -> DataFrame:
    """Retrieved context -> QA inference prompt -> generated answer, returned
    as the only hit of the question."""
    ctx = H.build_context(hits)
    p = questions.select(QID, "question").join(ctx, QID, "left_outer").select(
        QID, PR.qa_prompt(F.col("question"), F.coalesce(F.col("context"), F.lit(""))).alias("prompt"))
    gen = MD.generate(F.col("prompt"), generator, max_new_tokens, make=make)
    return p.select(QID, F.lit(1).alias("rank"), gen.alias("content"))


def load_docs(spark: SparkSession, folder: str, table: str, chunk_size: int = 512,
              overlap: int = 150, extensions=(".docx",), embed=None) -> int:
    """load-docs: S1/S2 -> T1 -> T2/T3 metadata -> E1 -> K1 append. Returns rows added."""
    from ..functions import embed as EM

    docs = load_documents(spark, folder, extensions)
    ch = add_release_metadata(chunk_documents(docs, chunk_size, overlap))
    emb = embed(F.col("content")) if embed else EM.hash_embedding(F.col("content"))
    return vector_append(ch, table, embed=lambda new: new.withColumn("embedding", emb))
