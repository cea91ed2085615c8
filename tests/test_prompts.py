import json

import pytest
from oracles import answer_parse_oracle, mcq_prompt_oracle, qa_prompt_oracle
from pyspark.sql import functions as F

from ragloom.functions import prompts as PR
from ragloom.functions import text as TX
from ragloom.plans import retrieve as RT
from ragloom.sources.tables import load_questions

QUESTIONS_TRAIN = {
    "question 10": {"question": "Q ten?", "option 1": "a", "option 2": "b",
                    "answer": "option 2: b", "explanation": "because b"},
    "question 9": {"question": "Q nine?", "option 1": "w", "option 2": "x", "option 3": "y",
                   "option 4": "z", "answer": "option 1: w"},
    "question 3": {"question": "Q three?", "option 1": "1", "option 2": "2", "option 3": "3",
                   "option 4": "4", "option 5": "5", "answer": "option 5: 5", "explanation": "e"},
    "question 4": {"question": "Q four?", "category": "x", "option 1": "p", "option 2": "q",
                   "answer": "option 1: p", "explanation": "line1\nline2"},
}
QUESTIONS_TEST = {
    "question 1": {"question": "T one?", "option 1": "a", "option 2": "b"},
    "question 2": {"question": "T two?", "option 1": "c"},
    "question 3": {"question": "T three?"},
}


@pytest.fixture()
def qfile(tmp_dir):
    p = f"{tmp_dir}/questions_train.json"
    with open(p, "w", encoding="utf-8") as f:
        json.dump(QUESTIONS_TRAIN, f)
    return p


def test_load_questions_keeps_order_and_options(spark, qfile):
    q = load_questions(spark, qfile).orderBy("ordinal").collect()
    assert [r.question_id for r in q] == ["10", "9", "3", "4"]
    assert [r.ordinal for r in q] == [0, 1, 2, 3]
    assert [(o.key, o.value) for o in q[1].options] == [("option 1", "w"), ("option 2", "x"),
                                                         ("option 3", "y"), ("option 4", "z")]
    assert len(q[2].options) == 5 and q[1].explanation is None
    assert [o.key for o in q[3].options] == ["option 1", "option 2"]  # 'category' dropped


def test_mcq_and_qa_prompts_exact(spark, qfile):
    q = load_questions(spark, qfile)
    ctx = spark.createDataFrame([("10", 1, "ctx a\nmore"), ("10", 2, "ctx b"), ("9", 1, "c9")],
                                "question_id string, rank int, content string")
    train = {r.question_id: r for r in RT.training_prompts(q, ctx, ("qa", "mcq")).collect()
             if r.kind == "mcq"}
    qa = {r.question_id: r for r in RT.training_prompts(q, ctx, ("qa",)).collect()}
    infer = {r.question_id: r.prompt for r in RT.inference_prompts(q, ctx, "mcq").collect()}
    for rec_id, rec in QUESTIONS_TRAIN.items():
        qid = rec_id.split(" ")[1]
        context = {"10": "ctx a. more ctx b", "9": "c9"}.get(qid, "")
        opts = [(k, v) for k, v in rec.items() if k.startswith("option")]
        assert train[qid].prompt == mcq_prompt_oracle(rec["question"], context, opts,
                                                      rec.get("answer"), rec.get("explanation"),
                                                      True)
        assert infer[qid] == mcq_prompt_oracle(rec["question"], context, opts)
        assert qa[qid].prompt == qa_prompt_oracle(rec["question"], context,
                                                  rec.get("explanation"), True)
        assert train[qid].answer == rec.get("answer")
    assert infer["10"].endswith("option 2: b\n\n### Answer:")


def test_test_questions_without_answers(spark, tmp_dir):
    p = f"{tmp_dir}/questions_test.json"
    with open(p, "w") as f:
        json.dump(QUESTIONS_TEST, f)
    q = load_questions(spark, p)
    empty = spark.createDataFrame([], "question_id string, rank int, content string")
    got = {r.question_id: r.prompt for r in RT.inference_prompts(q, empty, "mcq").collect()}
    assert got["3"] == mcq_prompt_oracle("T three?", "", [])
    assert "Choices:\n\n### Answer:" in got["3"]


GENERATED = [" option 3: x", "option 4", "no digit", "", ":", "option 2 :"]


def test_answer_parse(spark):
    df = spark.createDataFrame([(g,) for g in GENERATED], "t string")
    got = [r.a for r in df.select(TX.answer_parse("t").alias("a")).collect()]
    assert got == [answer_parse_oracle(g) for g in GENERATED] == ["3", "4", "t", "", "", ""]


def test_text_functions(spark):
    df = spark.createDataFrame([("a\n  b \n\n c\t", "x</s>y<|assistant|>", "rel_17.docx",
                                 "/d/rel_x.docx", "question 12")],
                               "t string, s string, p1 string, p2 string, k string")
    r = df.select(TX.line_list("t").alias("l"), TX.strip_special_tokens("s").alias("s"),
                  TX.release_year("p1").alias("y1"), TX.release_year(TX.basename("p2")).alias("y2"),
                  TX.release_tag(TX.release_year("p1")).alias("tag"),
                  TX.stop_truncate(F.lit(" ans. more\nx"), [".", "\n"]).alias("st"),
                  TX.question_number("k").alias("qid")).first()
    assert r.l == ["a", "b", "c"] and r.s == "xy" and r.y1 == 17 and r.y2 is None
    assert r.tag == "3GPP Release 17" and r.st == "ans" and r.qid == "12"


def test_compress_and_multi_query_prompts(spark):
    r = spark.range(1).select(PR.compress_prompt(F.lit("C"), F.lit("Q"), 7).alias("p"),
                              PR.multi_query_prompt(F.lit("Q")).alias("m")).first()
    assert r.p.startswith("<|system|>\n") and "not exceeding 7 words.</s>\n<|user|>" in r.p
    assert r.p.endswith("Question:\nQ</s>\n<|assistant|>\n")
    assert r.m.endswith("separated by newlines.\n    Q\n    ")


@pytest.mark.parametrize("block", [2000, 7])
def test_context_of_long_conversations(spark, tmp_dir, monkeypatch, block):
    """All later turns are ranked, and the last assistant turn of the conversation explains."""
    import random
    import re

    from ragloom.operators import hits as H
    from ragloom.plans import catalog

    monkeypatch.setattr(H, "TURN_BLOCK", block)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(25)]
    rows = [(conv, t, "assistant" if t % 2 else "user",
             None if rng.random() < 0.05 else " ".join(rng.choices(words, k=rng.randint(0, 9))))
            for conv, n in ((1, 61), (2, 6), (3, 1)) for t in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_dir}/conversations.parquet")
    q, ctx = catalog.conversation_questions(spark, tmp_dir)
    got = {r.question_id: r.explanation for r in q.collect()}
    near = {}
    for r in ctx.collect():
        near.setdefault(r.question_id, {})[r["rank"]] = r.content

    def share(a, b):
        if a is None or b is None:
            return -1
        a, b = (set(re.findall(r"\w+", x)) for x in (a, b))
        return len(a & b) / max(1, len(a))

    asked = [r for r in rows if r[2] == "user"]
    assert len(got) == len(asked)
    for conv, t, _, text in asked:
        later = [r for r in rows if r[0] == conv and r[1] > t + 1]
        if not any(r[0] == conv and r[1] == t + 1 for r in rows):
            later = []
        said = [r[3] for r in later if r[2] == "assistant"]
        key = f"{conv}-{t}"
        best = [r[3] for r in sorted(later, key=lambda r: (-share(text, r[3]), r[1]))[:3]]
        assert got[key] == (said[-1] if said else None)
        assert near.get(key, {}) == dict(enumerate(best, 1))
