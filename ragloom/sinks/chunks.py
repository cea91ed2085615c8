"""The stored chunk table: written once, searched by id, text fetched late.

``store_chunks`` writes chunks (id, text, vector, metadata) as a table bucketed and sorted
by their id. A search scans ids and vectors only; a join on the id with the table brings
text and vectors to the hits, and needs no shuffle of the table, since its buckets are
already dealt by the id. ``ranges`` below does the same for pages in id order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def store_chunks(chunks: DataFrame, key: str = "chunk_id", buckets: int | None = None,
                 path: str | None = None) -> DataFrame:
    """Write ``chunks`` bucketed by ``key`` (one sorted file a bucket) and return the table.
    ``path`` is a folder in shared storage, by default one below ``spark.checkpoint.dir``.
    Size ``buckets`` so that a bucket fits a task (the default is the number of shuffle
    partitions); keys must be unique."""
    spark = chunks.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"chunks_{uuid.uuid4().hex[:12]}"
    (chunks.repartition(n, key).write.option("path", path or scratch_path(spark, "chunk-table"))
     .bucketBy(n, key).sortBy(key).saveAsTable(name))
    return spark.table(name)


# ---- pages in key order


def _ranges(spark: SparkSession, base: str) -> DataFrame:
    kept = spark.read.parquet(f"{base}/columns").schema
    return spark.read.schema(kept.add("_part", "integer")).parquet(f"{base}/rows")


def write_pages(df: DataFrame, path: str, key: str = "chunk_id") -> None:
    """Write ``df`` in ranges of ``key``, one folder a range, and an index with the rows
    before each range. Neither step puts the rows into one task."""
    base = path.rstrip("/")
    (df.repartitionByRange(F.col(key)).sortWithinPartitions(key)
     .withColumn("_part", F.spark_partition_id())
     .write.partitionBy("_part").parquet(f"{base}/rows"))
    spark = df.sparkSession
    # the columns, for a table without rows
    df.limit(0).write.parquet(f"{base}/columns")
    # one row a range: the running sum is over a table of files, not of rows
    sizes = _ranges(spark, base).groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes.select("_part", F.coalesce(before, F.lit(0)).alias("start"), "n").write.parquet(f"{base}/index")


def read_page(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None,
              limit: int = 100, offset: int = 0, key: str = "chunk_id") -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in key order. Only the ranges that hold the page
    are read (pruned by folder) and sorted, however large the offset."""
    base = path.rstrip("/")
    index = spark.read.parquet(f"{base}/index")
    # at most the ranges of one page
    hit = (index.where((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset))
           .orderBy("_part").collect())
    rows = _ranges(spark, base).where(F.col("_part").isin([r["_part"] for r in hit]))
    page = rows.orderBy(key).offset(max(0, offset - (hit[0]["start"] if hit else 0))).limit(limit)
    return page.select(*columns) if columns else page.drop("_part")
