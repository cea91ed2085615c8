"""The reference's batch jobs as Spark jobs (fine-tuning itself is not built).

* ``load_docs``              -> ``plans.answer.load_docs``
* ``build_finetune_set``     questions x chunk table -> D1 prompts -> D3/D4/D5 -> O4 split -> K4
* ``build_inference_prompts`` K6 run modes -> R8 (+R10) -> D2 prompts -> K3
* ``test_model``             prompts -> E4 + P8 -> K5 answers
* ``metrics``                S5 -> A1
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import order as OR
from ..operators import tokens as TK
from ..sinks import tables as SK
from ..sources import tables as SRC
from . import answer as AN
from . import retrieve as RT


def build_finetune_set(questions: DataFrame, chunks: DataFrame, cfg: RT.RetrieverConfig,
                       context_length: int = 1024, tokenizer=None, kinds=("mcq",),
                       test_size: float = 0.1, seed: int = 123, out: str | None = None
                       ) -> DataFrame:
    """D1 -> D3 -> D4 -> D5 (both markers) -> O4 (-> K4 when ``out`` is given)."""
    spark = questions.sparkSession
    hits = RT.retrieve_with_fallback(questions, chunks, cfg)
    prompts = RT.training_prompts(questions, hits, kinds).withColumn(
        "row_key", F.concat_ws("|", F.col("question_id").cast("string"), "kind"))
    tok = TK.tokenize_truncate(prompts, context_length, tokenizer)
    lab = TK.turn_mask(TK.copy_labels(tok), TK.response_marker_ids(spark, tokenizer),
                       TK.instruction_marker_ids(spark, tokenizer))
    ds = OR.exact_split(lab, "row_key", test_size, seed).drop("row_key")
    if out:
        SK.write_dataset(ds, out)
    return ds


def build_inference_prompts(spark: SparkSession, run_mode: int, chunks: DataFrame,
                            cfg: RT.RetrieverConfig, train_questions: str | None = None,
                            test_questions: str | None = None, kind: str = "mcq",
                            out: str | None = None, n_samples: int = -1) -> DataFrame:
    """K6: one job over the selected question files, tagged by ``split``;
    ``n_samples >= 0`` takes that many questions of each (O3)."""
    train = SRC.load_questions(spark, train_questions) if train_questions else None
    test = SRC.load_questions(spark, test_questions) if test_questions else None
    train, test = (q if q is None else OR.sample_n(q, n_samples, "question_id")
                   for q in (train, test))
    qs = SK.route_splits(run_mode, train, test).withColumn(
        "question_id", F.concat_ws(":", "split", "question_id"))
    hits = RT.retrieve_with_fallback(qs, chunks, cfg)
    prompts = RT.inference_prompts(qs, hits, kind)
    # the split has no colon, an id may have some
    at = F.instr("question_id", ":")
    prompts = prompts.withColumn("split", F.expr("substring(question_id, 1, instr(question_id, ':') - 1)")
                                 ).withColumn("question_id", F.substr("question_id", at + 1))
    if out:
        prompts.write.mode("overwrite").partitionBy("split").parquet(out)
    return prompts


def test_model(prompts: DataFrame, generator: str, task: str = "", out: str | None = None,
               make: Callable | None = None, max_new_tokens: int = 4,
               batch_size: int = 512) -> DataFrame:
    """E4 + P8 + P9 (+ K5 when ``out`` is given)."""
    ans = AN.answer_questions(prompts, generator, task, max_new_tokens, batch_size, make)
    if out:
        SK.write_answers(ans, out, task)
    return ans


def metrics(spark: SparkSession, predictions: str, truth: str) -> DataFrame:
    """S5 + A1: one row ``n_pred, n_matched, n_correct, accuracy``."""
    return AN.score_answers(SRC.read_answers(spark, predictions),
                            SRC.read_answers(spark, truth, truth=True))
