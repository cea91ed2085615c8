"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: Largest number of text bytes handled at once inside a task.
SLICE_BYTES = 2 << 20


_CLAIMS: dict[str, Callable[[], None]] = {}


def claim(owner: str, drop: Callable[[], None]) -> None:
    """Tables that a worker process keeps between tasks belong to one operator at a time:
    ``owner`` is about to use its own, so those of all others are dropped. Workers outlive
    stages, and the tables of every stage of a pipeline would add up."""
    if owner not in _CLAIMS:
        for other in list(_CLAIMS):
            _CLAIMS.pop(other)()
        _CLAIMS[owner] = drop


def broadcast_small(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """``df`` marked for broadcast if its rows, as JSON, take at most ``limit`` bytes."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(
        *[F.col(f"`{c}`") for c in df.columns]))))).first()[0]
    return F.broadcast(df) if (size or 0) <= limit else df


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back: the lineage
    ends at files that every executor can read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(id_col: str, mod: int) -> F.Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return (F.crc32(F.col(id_col).cast("string")) % mod).cast("int")


def slices(batches: Iterator[pa.RecordBatch], text_col: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(rows, texts as UTF-8 bytes) in pieces of about ``limit`` bytes; a null text is empty."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text_col))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        at, total = 0, 0
        for i, n in enumerate(sizes):
            total += n
            if total >= limit or i == len(sizes) - 1:
                part = batch.slice(at, i + 1 - at)
                texts = col.slice(at, i + 1 - at).cast(pa.binary()).to_pylist()
                yield part, [t or b"" for t in texts]
                at, total = i + 1, 0


def map_texts(df: DataFrame, cols: list[str], fn: Callable, schema: str,
              text_col: str = "text") -> DataFrame:
    """``mapInArrow`` over slices of ``df``: ``fn(rows, texts)`` returns a list of
    Arrow arrays (or Python lists) in the order of ``schema``. Only ``cols`` and
    the text leave the JVM."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for rows, texts in slices(batches, text_col):
            arrays = fn(rows, texts)
            yield pa.RecordBatch.from_arrays(
                [a.cast(f.type) if isinstance(a, (pa.Array, pa.ChunkedArray))
                 else pa.array(a, f.type) for a, f in zip(arrays, out)], schema=out)

    return df.select(*cols, text_col).mapInArrow(run, schema)


def column(rows: pa.RecordBatch, name: str) -> pa.Array:
    return rows.column(rows.schema.get_field_index(name))


def runs_of(batches: Iterator[pa.RecordBatch], keys: int):
    """Rows of sorted batches, by equal values of the first ``keys`` columns; lazily."""
    from itertools import groupby

    def rows():
        for b in batches:
            for at in range(0, b.num_rows, 256):
                yield from zip(*(c.slice(at, 256).to_pylist() for c in b.columns))

    return groupby(rows(), key=lambda r: r[:keys])
