"""The conversation queries and their SQL twins on conversations of 30 and more turns."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as E

NAMES = ("mcq_prompt_train", "mcq_prompt_infer", "qa_prompt", "token_truncate", "copy_labels",
         "completion_mask", "turn_mask", "prompts_roundtrip", "compress", "answer_document")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rnd, rows = random.Random(8), []
    words = [f"word{i}" for i in range(25)] + ["the", "of", "and"]
    for conv, turns in ((1, 30), (2, 61), (3, 9), (4, 2)):
        for t in range(turns):
            role = "system" if t == 0 and conv == 2 else ("user", "assistant")[(t + (conv == 2)) % 2]
            lines = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 9)))
                     for _ in range(rnd.randint(1, 3))]
            rows.append((conv, t, role, "\n".join(lines) + rnd.choice([".", "?", ""])))
    path = tmp_path_factory.mktemp("long")
    pq.write_table(pa.table({c: pa.array(v, k) for (c, k), v in zip(
        (("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())),
        zip(*rows))}), f"{path}/conversations.parquet")
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_twin(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    want = con.sql(E.oracle_sql()[name])
    got = E.queries()[name](spark, folder)
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    rows = want.select(", ".join(f'"{c}"' for c in order)).fetchall()
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in got.select(order).collect())
    assert len(rows) > 0
