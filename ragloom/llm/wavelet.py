"""Token ids as wavelet matrices, one compressed file per shard.

A shard holds the ids of consecutive documents (ascending id order) as a wavelet
matrix: one bit-plane per id bit, each stably partitioned by the plane above,
with cumulative counts every 512 bits. Any token can be read (``access``), any
id counted in a range (``rank``) and its n-th occurrence found (``select``)
without unpacking the rest. ``encode_corpus`` writes the shards as rows of a
Parquet table in shared storage (column ``data`` is the file format below, codec
zstd); ``decode_corpus``, ``count_token`` and ``locate_token`` read them back.

File format, little endian: magic ``WMX1``; u32 planes; u64 tokens; u64
documents; u64 zeros per plane; documents x (i64 id, u8 null flag); (documents
+ 1) x u64 starts; per plane its bits (most significant first, padded to whole
64-byte blocks) and u32 counts of ones before each block.

Defined results: a null text is empty and holds the end id only; a null id sorts
first; rows with one id are ordered by text and each kept; an empty table gives
an empty shard table and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from . import tokenize as T
from .common import slices

BLOCK = 512
#: Tokens per shard; with the codec a shard is about 2 bytes a token.
SHARD_TOKENS = 1 << 18
SHARDS = "part int, seq int, n_tokens long, n_docs long, data binary"
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class WaveletMatrix:
    """Bit-planes of a sequence of ids with rank and select."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray],
                 ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        kind = np.uint16 if bits <= 16 else np.uint32
        cur, zeros, planes, ranks = np.asarray(ids).astype(kind), [], [], []
        for b in range(bits - 1, -1, -1):
            one = (cur & kind(1 << b)) != 0
            raw = np.packbits(one)
            pad = -len(raw) % (BLOCK // 8)
            raw = np.concatenate([raw, np.zeros(pad, np.uint8)])
            ones = _POP[raw].reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
            planes.append(raw)
            ranks.append(np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4")
                         if len(ones) else np.zeros(0, "<u4"))
            low = cur.compress(~one)
            zeros.append(len(low))
            cur = np.concatenate([low, cur.compress(one)])
        return cls(len(ids), zeros, planes, ranks)

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first ``i`` bits of plane ``k``."""
        if i >= self.n:
            return self.n - self.zeros[k]
        block, byte = i // BLOCK, i // 8
        got = int(self.ranks[k][block]) + int(
            _POP[self.planes[k][block * (BLOCK // 8):byte]].sum(dtype=np.int64))
        return got + int(_POP[self.planes[k][byte] >> (8 - i % 8)]) if i % 8 else got

    def access(self, i: int) -> int:
        value = 0
        for k in range(len(self.planes)):
            bit = self.planes[k][i // 8] >> (7 - i % 8) & 1
            ones = self._ones(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | int(bit)
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        bits = len(self.planes)
        if token >> bits:
            return 0, 0
        for k in range(bits):
            a, b = self._ones(k, lo), self._ones(k, hi)
            if token >> (bits - 1 - k) & 1:
                lo, hi = self.zeros[k] + a, self.zeros[k] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, token: int, lo: int, hi: int) -> int:
        """How often ``token`` occurs in [lo, hi)."""
        a, b = self._range(token, lo, hi)
        return b - a

    def _select_bit(self, k: int, bit: int, nth: int) -> int:
        """Position of the nth (from 0) ``bit`` in plane ``k``."""
        before = self.ranks[k].astype(np.int64)
        if not bit:
            before = np.arange(len(before), dtype=np.int64) * BLOCK - before
        block = int(np.searchsorted(before, nth, "right")) - 1
        part = self.planes[k][block * (BLOCK // 8):(block + 1) * (BLOCK // 8)]
        hits = np.flatnonzero(np.unpackbits(part) == bit)
        return block * BLOCK + int(hits[nth - int(before[block])])

    def select(self, token: int, nth: int) -> int:
        """Position of the nth (from 0) occurrence of ``token``."""
        lo, _ = self._range(token, 0, self.n)
        i, bits = lo + nth, len(self.planes)
        for k in range(bits - 1, -1, -1):
            bit = token >> (bits - 1 - k) & 1
            i = self._select_bit(k, bit, i - self.zeros[k] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, j) for j in range(self.rank(token, 0, self.n))]

    def all(self) -> np.ndarray:
        """Every id, undoing the partitions from the last plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        cur = np.zeros(self.n, kind)
        for k in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n)
            one = bit.view(bool)
            up = np.empty_like(cur)
            up[np.flatnonzero(~one)] = cur[:self.zeros[k]]
            up[np.flatnonzero(one)] = cur[self.zeros[k]:] | kind(1 << (len(self.planes) - 1 - k))
            cur = up
        return cur


def pack_shard(ids: np.ndarray, doc_ids: list, starts: list[int], bits: int) -> bytes:
    wm = WaveletMatrix.build(ids, bits)
    head = struct.pack("<4sIQQ", b"WMX1", bits, wm.n, len(doc_ids))
    table = np.zeros(len(doc_ids), [("id", "<i8"), ("null", "u1")])
    table["id"] = [d or 0 for d in doc_ids]
    table["null"] = [d is None for d in doc_ids]
    return b"".join([head, np.asarray(wm.zeros, "<u8").tobytes(), table.tobytes(),
                     np.asarray([*starts, wm.n], "<u8").tobytes(),
                     *[x.tobytes() for p in zip(wm.planes, wm.ranks) for x in p]])


def open_shard(data: bytes) -> tuple[WaveletMatrix, list, np.ndarray]:
    """(matrix, document ids, documents' starts and the end)."""
    magic, bits, n, docs = struct.unpack_from("<4sIQQ", data)
    if magic != b"WMX1":
        raise ValueError("not a wavelet shard")
    at = 24
    zeros = np.frombuffer(data, "<u8", bits, at).tolist()
    at += 8 * bits
    table = np.frombuffer(data, [("id", "<i8"), ("null", "u1")], docs, at)
    at += 9 * docs
    starts = np.frombuffer(data, "<u8", docs + 1, at).astype(np.int64)
    at += 8 * (docs + 1)
    blocks = -(-n // BLOCK)
    planes, ranks = [], []
    for _ in range(bits):
        planes.append(np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at))
        at += blocks * BLOCK // 8
        ranks.append(np.frombuffer(data, "<u4", blocks, at))
        at += 4 * blocks
    ids = [None if z else int(i) for i, z in zip(table["id"], table["null"])]
    return WaveletMatrix(n, zeros, planes, ranks), ids, starts


def encode_corpus(docs: DataFrame, path: str, tokenizer: str | None = None,
                  end_id: int = T.END_ID, bits: int = 16, shard_tokens: int = SHARD_TOKENS,
                  id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the ids of all documents in ascending id order as shards below ``path``.

    ``bits`` must hold the largest id. One range shuffle of id and text; a task
    holds the ids of one shard at a time (a longer document makes a longer shard)."""
    file = tokenizer or T.default_path()
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        names, starts, held, n = [], [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(held), "<u4")
            if len(ids) and int(ids.max()) >> bits:
                raise ValueError(f"an id needs more than {bits} bits")
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                 "n_tokens": pa.array([n], pa.int64()), "n_docs": pa.array([len(names)], pa.int64()),
                 "data": pa.array([pack_shard(ids, names, starts, bits)], pa.binary())})

        for rows, texts in slices(batches, text_col):
            ids = T.encoder(file).ids(texts)
            for d, raw in zip(rows.column(0).to_pylist(), ids):
                names.append(d)
                starts.append(n)
                held += [raw, end]
                n += len(raw) // 4 + 1
                if n >= shard_tokens:
                    yield flush()
                    names, starts, held, n, seq = [], [], [], 0, seq + 1
        if names:
            yield flush()

    (docs.select(id_col, text_col).repartitionByRange(F.col(id_col))
     .sortWithinPartitions(id_col, text_col)
     .mapInArrow(run, SHARDS)
     .write.option("compression", "zstd").parquet(path))
    return path


def shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, shard_start): tokens before each shard. Only one number per
    writing task meets in one place."""
    sizes = shards(spark, path).select("part", "seq", "n_tokens")
    parts = (sizes.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
             .select("part", F.coalesce(F.sum("_n").over(
                 Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                 F.lit(0)).alias("_before")))
    inside = F.coalesce(F.sum("n_tokens").over(
        Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))
    return (sizes.withColumn("_inside", inside).join(parts, "part")
            .select("part", "seq", (F.col("_before") + F.col("_inside")).alias("shard_start")))


def decode_corpus(spark: SparkSession, path: str, id_type: str = "long",
                  id_col: str = "doc_id") -> DataFrame:
    """Per document, from the shards: id, start, n_tokens, ids_crc32."""

    def run(batches):
        for b in batches:
            for part, seq, data in zip(*(c.to_pylist() for c in b.columns)):
                wm, ids, starts = open_shard(data)
                raw = wm.all().astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a:4 * z]) for a, z in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), pa.array([seq] * len(ids), pa.int32()),
                     pa.array(ids, pa.int64()), pa.array(starts[:-1]), pa.array(np.diff(starts)),
                     pa.array(crc, pa.int64())],
                    names=["part", "seq", id_col, "_at", "n_tokens", "ids_crc32"])

    docs = (shards(spark, path).select("part", "seq", "data")
            .mapInArrow(run, f"part int, seq int, `{id_col}` long, _at long, n_tokens long, "
                             "ids_crc32 long"))
    return (docs.join(shard_starts(spark, path), ["part", "seq"])
            .select(F.col(id_col).cast(id_type).alias(id_col),
                    (F.col("shard_start") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32"))


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(part, seq, n): occurrences of an id per shard, by rank alone."""

    def run(batches):
        for b in batches:
            for part, seq, data in zip(*(c.to_pylist() for c in b.columns)):
                wm, _, _ = open_shard(data)
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                     "n": pa.array([wm.rank(token, 0, wm.n)], pa.int64())})

    return (shards(spark, path).select("part", "seq", "data")
            .mapInArrow(run, "part int, seq int, n long"))


def locate_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(doc_id, position in the document) of every occurrence of an id, by select."""

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                wm, ids, starts = open_shard(data)
                at = np.array(wm.occurrences(token), np.int64)
                doc = np.searchsorted(starts, at, "right") - 1
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array([ids[d] for d in doc], pa.int64()),
                     "position": pa.array(at - starts[doc], pa.int64())})

    return shards(spark, path).select("data").mapInArrow(run, "doc_id long, position long")


def token_files(docs: DataFrame, **options) -> DataFrame:
    """Encode into a fresh folder below ``spark.checkpoint.dir`` and read it back."""
    spark = docs.sparkSession
    id_col = options.get("id_col", "doc_id")
    path = encode_corpus(docs, scratch_path(spark, "wavelet"), **options)
    return decode_corpus(spark, path, docs.schema[id_col].dataType.simpleString(), id_col)
