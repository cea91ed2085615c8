"""The Word-file data source, batch and stream, and the stream's quarantine."""

import os

import pytest
from pyspark.sql import functions as F

from ragloom.sinks.tables import read_current
from ragloom.sources import docx as DX
from ragloom.sources.files import docx_to_text
from ragloom.streaming.ingest import start_docx_ingest

TEXTS = {"a": "one\n\ntwo\tthree\nfour", "b": "", "c": "ümlaut <&> \"q\" ]]> 中文", "d": "x" * 200_000,
         "e": "  lead\n\n\n\ntrail  \r\n", "f": None}


def test_text_round_trip():
    for t in TEXTS.values():
        assert docx_to_text(DX.text_to_docx(t or "")) == (t or "")
    assert docx_to_text(DX.text_to_docx("a\x00b\x0bc\x1f")) == "abc"


@pytest.fixture()
def folder(spark, tmp_dir):
    DX.register(spark)
    df = spark.createDataFrame(list(TEXTS.items()), "name string, text string").repartition(3)
    assert DX.write_docx(df, f"file://{tmp_dir}/in") == len(TEXTS)
    DX.write_file(b"PK no zip", f"{tmp_dir}/in", "bad.docx")
    DX.write_file(b"other", f"{tmp_dir}/in", "note.txt")
    return f"{tmp_dir}/in"


def rows(df):
    return {os.path.basename(r.path): (r.text, r.error is not None) for r in df.collect()}


def test_batch_and_stream(spark, folder, tmp_dir):
    want = {f"{k}.docx": (v or "", False) for k, v in TEXTS.items()} | {"bad.docx": (None, True)}
    for options in ({}, {"partitionBytes": "1", "partitionFiles": "1"}, {"partitionFiles": "2"}):
        df = spark.read.format("docx").options(**options).load(folder)
        assert rows(df) == want
        if "partitionBytes" in options:
            assert df.rdd.getNumPartitions() == len(want)
    assert {r.source for r in DX.documents(df).collect()} == {f"{k}.docx" for k in TEXTS}

    def drain():
        (spark.readStream.format("docx").load(folder).writeStream.format("parquet")
         .option("checkpointLocation", f"{tmp_dir}/ckpt").trigger(availableNow=True)
         .start(f"{tmp_dir}/out").awaitTermination())
        return rows(spark.read.schema(DX.SCHEMA).parquet(f"{tmp_dir}/out"))

    assert drain() == want
    DX.write_file(DX.text_to_docx("late"), folder, "late.docx")
    assert drain() == want | {"late.docx": ("late", False)}
    assert spark.read.schema(DX.SCHEMA).parquet(f"{tmp_dir}/out").count() == len(want) + 1


def test_no_files(spark, tmp_dir):
    DX.register(spark)
    assert spark.read.format("docx").load(f"{tmp_dir}/nowhere").count() == 0


def test_ingest_stream_goes_on_after_a_bad_file(spark, folder, tmp_dir):
    for _ in range(2):
        start_docx_ingest(spark, folder, f"{tmp_dir}/table", f"{tmp_dir}/ck").awaitTermination()
        DX.write_file(DX.text_to_docx("more words"), folder, "more.docx")
    got = {r.source for r in read_current(spark, f"{tmp_dir}/table").select(
        F.col("source")).distinct().collect()}
    assert {"a.docx", "c.docx", "d.docx", "more.docx"} <= got and "bad.docx" not in got
    bad = spark.read.parquet(f"{tmp_dir}/table-errors")
    assert [(r.source, "BadZipFile" in r.error) for r in bad.collect()] == [("bad.docx", True)]


def test_driver_holds_few_bytes_a_file(tmp_dir):
    import tracemalloc

    from pyspark import cloudpickle

    folder, n = f"{tmp_dir}/{'deep' * 20}", 20_000
    os.mkdir(folder)
    for i in range(n):
        with open(f"{folder}/doc-{i}.docx", "wb") as f:
            f.write(b"x" * (i % 90))
    os.mkdir(f"{folder}/folder.docx")
    os.symlink(f"{folder}/nowhere", f"{folder}/link.docx")
    stream = DX.DocxStreamReader({"path": folder})
    for plan in (DX.DocxReader({"path": f"file://{folder}"}).partitions,
                 lambda: stream.partitions(stream.initialOffset(), stream.latestOffset())):
        plan()                                            # imports
        tracemalloc.start()
        parts = plan()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 150 * n and sum(len(cloudpickle.dumps(p)) for p in parts) < 25 * n
        found = sorted(f for p in parts for f in p.files)
        assert found == sorted((os.stat(p).st_mtime_ns, p, i % 90) for i in range(n)
                               for p in [f"{folder}/doc-{i}.docx"])
        assert {len(list(p.files)) for p in parts} == {DX.PARTITION_FILES}
