"""Prompt texts as column expressions.

No template engine: each prompt is a ``concat`` of literals and columns, so
building prompts for any number of questions is one projection.
A NULL answer / explanation is rendered as the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Prompt texts that must match the reference byte for byte.
INSTRUCTIONS_TAG = "### Instructions:"
ANSWER_TAG = "### Answer:"
EXPLANATION_TAG = "### Explanation:"
MCQ_INSTRUCTION = (
    "Based on the provided context, select the correct answer from the choices given. "
    "Provide your answer in the following format: option Number: Answer."
)
QA_INSTRUCTION = "Based on the provided context, answer the question."
COMPRESS_SYSTEM = (
    "You are a telecommunication engineering expert. Given the context, explain the correct "
    "answer for the following question succinctly. Please provide a response that is clear "
    "and concise, not exceeding {max_word_count} words."
)
MULTI_QUERY_INSTRUCTION = (
    "You are an AI language model assistant. Your task is to generate two different versions "
    "of the given user question to retrieve relevant documents from a vector database. By "
    "generating multiple perspectives on the user question, your goal is to help the user "
    "overcome some of the limitations of the distance-based similarity search. Provide these "
    "alternative questions separated by newlines."
)
# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _s(c) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def options_block(options) -> Column:
    """``"<key>: <value>\\n"`` for every option struct, in array order."""
    lines = F.transform(_col(options), lambda o: F.concat(_s(o["key"]), F.lit(": "), _s(o["value"]),
                                                         F.lit("\n")))
    return F.array_join(F.coalesce(lines, F.array().cast("array<string>")), "")


def mcq_prompt(question, context, options, answer=None, explanation=None,
               show_answers: bool = False) -> Column:
    """Multiple-choice prompt; training form adds answer and explanation."""
    parts = [
        F.lit(INSTRUCTIONS_TAG + " \n" + MCQ_INSTRUCTION + "\n\nContext:\n"), _s(context),
        F.lit("\n\nQuestion:\n"), _s(question), F.lit("\nChoices:\n"), options_block(options),
        F.lit("\n" + ANSWER_TAG),
    ]
    if show_answers:
        parts += [F.lit("\n"), _s(answer), F.lit("\n" + EXPLANATION_TAG + "\n"), _s(explanation),
                  F.lit("\n")]
    return F.concat(*parts)


def qa_prompt(question, context, explanation=None, show_answers: bool = False) -> Column:
    """P5: free-answer prompt; the training form puts the explanation in the answer slot."""
    parts = [
        F.lit(INSTRUCTIONS_TAG + " \n" + QA_INSTRUCTION + "\n\nContext:\n"), _s(context),
        F.lit("\n\nQuestion:\n"), _s(question), F.lit("\n\n" + ANSWER_TAG),
    ]
    if show_answers:
        parts += [F.lit("\n"), _s(explanation), F.lit("\n")]
    return F.concat(*parts)


def compress_prompt(context, question, max_word_count: int = 512) -> Column:
    """Context + question -> explain-the-answer prompt with a word limit."""
    system = COMPRESS_SYSTEM.replace("{max_word_count}", str(int(max_word_count)))
    return F.concat(
        F.lit("<|system|>\n" + system + "</s>\n<|user|>\nContext:\n"), _s(context),
        F.lit("\nQuestion:\n"), _s(question), F.lit("</s>\n<|assistant|>\n"),
    )


def multi_query_prompt(question) -> Column:
    """Ask for two rephrasings of the question, one per line."""
    return F.concat(F.lit(MULTI_QUERY_INSTRUCTION + "\n    "), _s(question), F.lit("\n    "))
