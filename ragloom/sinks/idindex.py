"""Which ids does a table hold? An index of its ids in hash buckets with Bloom filters.

Beside the rows of a version lie, for each append, its ids by bucket (one folder a bucket)
and one Bloom filter a bucket. An append first asks the filters of the buckets its ids fall
into; only ids that may be there are compared with stored ids, and only the buckets of such
ids are read. New ids pass with ``BITS`` bits read per stored id; about one in 15,000 is
compared in vain.

The index follows the rows: it is written after them, and an append that finds it with
another number of ids than the table has rows (a lost append, rows written by other means)
builds it anew from the rows. Filters of one bucket are tested in one group, which holds
BITS / 8 bytes per id of the bucket; the number of buckets grows with the table.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BITS, PROBES = 20, 14
#: Ids a bucket should hold, and the least and greatest number of buckets.
BUCKET_IDS, LEAST, MOST = 200_000, 16, 1 << 14


def _places(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """PROBES bit numbers per id by double hashing; ``size`` is a power of two."""
    a, b = first.view(np.uint64)[:, None], second.view(np.uint64)[:, None] | np.uint64(1)
    return (a + np.arange(PROBES, dtype=np.uint64) * b) & np.uint64(size - 1)


def filter_bits(first: np.ndarray, second: np.ndarray) -> bytes:
    """Bloom filter of the ids with these two hashes."""
    size = max(64, 1 << (BITS * len(first) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[_places(first, second, size).ravel()] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_hold(data: bytes, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    at = _places(first, second, len(raw) * 8)
    return ((raw[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _hashed(ids: DataFrame, key: str, buckets: int) -> DataFrame:
    """(_k, _h1, _h2, bucket) of every row."""
    k = F.col(key)
    return ids.select(k.alias("_k"), F.xxhash64(k).alias("_h1"), F.xxhash64(k, F.lit(1)).alias("_h2"),
                      F.pmod(F.xxhash64(k, F.lit(2)), F.lit(buckets)).cast("int").alias("bucket"))


def _long(col) -> np.ndarray:
    return np.ascontiguousarray(col.to_numpy()).astype(np.int64)


class IdIndex:
    """The index of one version of a table."""

    def __init__(self, spark: SparkSession, base: str, version: int, key: str):
        self.spark, self.key = spark, key
        self.path = f"{base.rstrip('/')}/_ids/v={version}"

    def _exists(self) -> bool:
        from .tables import path_exists

        return path_exists(self.spark, f"{self.path}/size/_SUCCESS")

    def buckets(self) -> int:
        return self.spark.read.parquet(f"{self.path}/size").first()["buckets"]

    def _ids(self, kind: str) -> DataFrame:
        return self.spark.read.schema(f"_k {kind}, bucket int").parquet(f"{self.path}/ids")

    def ready(self, rows: DataFrame) -> None:
        """Build the index if it is not there, does not fit the rows or has grown too coarse."""
        n = rows.count()           # from file footers
        if self._exists():
            kind = rows.schema[self.key].dataType.simpleString()
            if self._ids(kind).count() == n and n <= 8 * BUCKET_IDS * self.buckets():
                return
        self.build(rows, n)

    def build(self, rows: DataFrame, n: int | None = None) -> None:
        n = rows.count() if n is None else n
        buckets = max(LEAST, min(MOST, -(-n // BUCKET_IDS)))
        from .tables import _fs

        fs, p = _fs(self.spark, self.path)
        fs.delete(p, True)         # the index is derived; the rows are not touched
        self._write(rows.select(self.key), buckets)
        self.spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{self.path}/size")

    def add(self, ids: DataFrame) -> None:
        self._write(ids, self.buckets())

    def _write(self, ids: DataFrame, buckets: int) -> None:
        def bits(table: pa.Table) -> pa.Table:
            data = filter_bits(_long(table.column("_h1")), _long(table.column("_h2")))
            return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()),
                             "bits": pa.array([data], pa.binary())})

        part = uuid.uuid4().hex
        hashed = _hashed(ids, self.key, buckets)
        (hashed.groupBy("bucket").applyInArrow(bits, "bucket int, bits binary")
         .write.mode("append").parquet(f"{self.path}/filters/{part}"))
        (hashed.select("_k", "bucket").repartition("bucket").write.mode("append")
         .partitionBy("bucket").parquet(f"{self.path}/ids"))

    def candidates(self, ids: DataFrame) -> DataFrame:
        """(_k, bucket) of the ids that some filter may hold."""
        kind = ids.schema[self.key].dataType.simpleString()

        def test(mine: pa.Table, filters: pa.Table) -> pa.Table:
            hit = np.zeros(mine.num_rows, bool)
            if mine.num_rows:
                first, second = _long(mine.column("_h1")), _long(mine.column("_h2"))
                for data in filters.column("bits"):
                    hit |= may_hold(data.as_py(), first, second)
            return mine.select(["_k", "bucket"]).filter(pa.array(hit))

        filters = (self.spark.read.schema("bucket int, bits binary").option("recursiveFileLookup", True)
                   .parquet(f"{self.path}/filters"))
        return (_hashed(ids, self.key, self.buckets()).groupBy("bucket")
                .cogroup(filters.groupBy("bucket")).applyInArrow(test, f"_k {kind}, bucket int"))

    def held(self, ids: DataFrame, reads: dict | None = None) -> DataFrame:
        """Those of ``ids`` that the table holds, as _k; ``reads`` is told what was read."""
        from ..session import scratch_path

        path = scratch_path(self.spark, "may-hold")
        found = self.candidates(ids)
        found.write.parquet(path)
        found = self.spark.read.schema(found.schema).parquet(path)
        # at most MOST bucket numbers
        hit = [r["bucket"] for r in found.select("bucket").distinct().collect()]
        stored = self._ids(ids.schema[self.key].dataType.simpleString())
        read = stored.where(F.col("bucket").isin(hit))
        if reads is not None:
            reads |= {"buckets": self.buckets(), "buckets_read": len(hit), "ids": stored.count(),
                      "ids_read": read.count()}
        read = read.select(F.col("_k").alias("_held"), F.col("bucket").alias("_bucket"))
        return found.join(read, (F.col("bucket") == F.col("_bucket"))
                          & F.col("_k").eqNullSafe(F.col("_held")), "left_semi").select("_k")
