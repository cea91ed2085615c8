"""What an append evaluates and moves; texts of a batch embedded slice by slice."""

import pyarrow as pa
from pyspark.sql import functions as F

from ragloom.functions import embed as EM
from ragloom.sinks import tables as SK


def test_repeated_and_null_keys_keep_the_row_of_a_grouping(spark, tmp_dir, monkeypatch):
    rows = [(f"k{i % 7}" if i % 5 else None, f"text {i}") for i in range(40)] + [("once", "x")]
    df = spark.createDataFrame(rows, "chunk_id string, content string")
    want = sorted(map(tuple, SK._one_per_key(df, "chunk_id").collect()), key=str)
    for told in (100, 0):
        monkeypatch.setattr(SK, "MAX_TOLD", told)
        base = f"{tmp_dir}/t{told}"
        assert SK.vector_append(df, base) == len(want)
        assert sorted(map(tuple, SK.read_current(spark, base).collect()), key=str) == want
        more = df.unionByName(spark.createDataFrame([("new", "y"), ("new2", "z")], df.schema))
        assert SK.vector_append(more, base) == 2 and SK.vector_append(more, base) == 0
        assert SK.read_current(spark, base).count() == len(want) + 2


def test_unique_rows_are_not_grouped_with_their_text(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(SK, "_one_per_key", None)           # would move every text
    df = spark.range(30).select(F.col("id").alias("chunk_id"), F.lit("text").alias("content"))
    assert SK.vector_append(df, f"{tmp_dir}/u") == 30
    asked = []
    again = SK.vector_append(df, f"{tmp_dir}/u", embed=lambda new: asked.append(1) or new)
    assert again == 0 and not asked


def test_embedding_holds_the_words_of_a_slice_only(spark, monkeypatch):
    sizes = []
    real = EM._dense_batch
    monkeypatch.setattr(EM, "_dense_batch", lambda t, *a: sizes.append(len(t)) or real(t, *a))
    texts = [f"word{i} and {i}" for i in range(2 * EM.SLICE + 3)] + [None]
    out = EM._dense_udf(16).func(pa.array(texts))
    assert max(sizes) == EM.SLICE and len(out) == len(texts) and not any(out[-1].as_py())
    assert out[5].as_py() == real([texts[5]], 16, __import__("regex").compile(r"[\p{L}\p{N}]+").findall)[0].tolist()
