"""ST1 incremental_ingest.

New document files (Parquet drops, or Word files via ``binaryFile``) are
picked up by Structured Streaming, chunked, embedded and appended to the
vector table by ``foreachBatch``; the append anti-joins on the stable
``chunk_id``, so a re-delivered document adds nothing, and the checkpoint
records which files were processed (a restarted query resumes there).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import embed as EM
from ..operators.split import chunk_documents
from ..sinks.tables import vector_append

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


def ingest_batch(docs: DataFrame, table: str, chunk_size: int = 512, overlap: int = 150,
                 embed: Callable | None = None) -> int:
    """Chunk + embed + K1 append of one batch of documents."""
    ch = chunk_documents(docs, chunk_size, overlap)
    emb = embed(F.col("content")) if embed else EM.hash_embedding(F.col("content"))
    return vector_append(ch, table, embed=lambda new: new.withColumn("embedding", emb))


def start_ingest(spark: SparkSession, source_dir: str, table: str, checkpoint: str,
                 schema: T.StructType = DOCUMENT_SCHEMA, chunk_size: int = 512,
                 overlap: int = 150, available_now: bool = True, max_files_per_trigger: int = 0,
                 dedup: str = "table"):
    """Start the stream; with ``available_now`` it processes what is there and stops.

    ``dedup="table"``: each micro-batch anti-joins its chunk ids with the
    table's id column (also catches rows written by batch jobs).
    ``dedup="state"``: the stream drops repeated ``chunk_id`` in Spark's
    key-partitioned state store, so the per-batch cost follows the batch and
    not the table; rows written outside this stream are not seen. Each batch has
    its own folder ``batch=<id>`` below ``table``.
    """
    if dedup not in ("table", "state"):
        raise ValueError("dedup must be 'table' or 'state'")
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)

    if dedup == "table":
        def each(batch: DataFrame, batch_id: int) -> None:
            ingest_batch(batch, table, chunk_size, overlap)

        w = stream.writeStream.foreachBatch(each)
    else:
        chunks = chunk_documents(stream, chunk_size, overlap).dropDuplicates(["chunk_id"])
        chunks = chunks.withColumn("embedding", EM.hash_embedding(F.col("content")))

        def append(batch: DataFrame, batch_id: int) -> None:
            # a replayed batch replaces its own folder
            batch.write.mode("overwrite").parquet(f"{table.rstrip('/')}/batch={batch_id}")

        w = chunks.writeStream.foreachBatch(append)
    w = w.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def start_docx_ingest(spark: SparkSession, folder: str, table: str, checkpoint: str,
                      chunk_size: int = 512, overlap: int = 150, available_now: bool = True,
                      quarantine: str | None = None):
    """ST1 for Word files: ``binaryFile`` stream -> S2 text -> chunk/embed/append.

    A file that cannot be read is written with its error to ``quarantine`` (by default
    ``<table>-errors``) by the batch that meets it; the stream goes on."""
    from ..functions import text as TX
    from ..sources.files import _docx_checked_udf

    errors = quarantine or f"{table.rstrip('/')}-errors"
    binary_schema = T.StructType([
        T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    stream = (spark.readStream.format("binaryFile").schema(binary_schema)
              .option("pathGlobFilter", "*.docx").load(folder))
    docs = stream.select(F.xxhash64("path").alias("doc_id"), "path",
                         TX.basename(F.col("path")).alias("source"),
                         _docx_checked_udf(F.col("content")).alias("r"))

    def each(batch: DataFrame, batch_id: int) -> None:
        from ..operators.split import add_release_metadata

        batch = batch.persist()      # parsed once for both sides
        try:
            # a replayed batch replaces its own folder
            (batch.where(F.col("r.error").isNotNull())
             .select("doc_id", "path", "source", F.col("r.error").alias("error"))
             .write.mode("overwrite").parquet(f"{errors}/batch={batch_id}"))
            good = batch.where(F.col("r.error").isNull()).select(
                "doc_id", "source", F.col("r.text").alias("text"))
            ch = add_release_metadata(chunk_documents(good, chunk_size, overlap))
            vector_append(ch, table, embed=lambda new: new.withColumn(
                "embedding", EM.hash_embedding(F.col("content"))))
        finally:
            batch.unpersist()

    w = docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
