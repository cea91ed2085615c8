"""T1 recursive_split and the chunk table.

The splitter is greedy and order dependent inside one text, so it runs as a
small per-text helper inside an Arrow-batched pandas UDF; Spark spreads the
texts over tasks, and ``posexplode`` turns the chunk arrays into rows
JVM-side. Everything around it (ids, metadata) is built-in expressions.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX

# Separators tried in order (paragraph, line, word, character).
DEFAULT_SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, sep: str) -> list[str]:
    """Split keeping each separator at the start of the following piece."""
    if sep == "":
        return list(text)
    parts = text.split(sep)
    out = [parts[0]] if parts[0] else []
    out.extend(sep + p for p in parts[1:])
    return out


def _merge(pieces: list[str], size: int, overlap: int, out: list[str]) -> None:
    window: deque[str] = deque()
    total = 0
    for p in pieces:
        n = len(p)
        if total + n > size and window:
            chunk = "".join(window).strip()
            if chunk:
                out.append(chunk)
            while total > overlap or (total + n > size and total > 0):
                total -= len(window.popleft())
        window.append(p)
        total += n
    chunk = "".join(window).strip()
    if chunk:
        out.append(chunk)


def _split(text: str, seps: tuple[str, ...], size: int, overlap: int, out: list[str]) -> None:
    sep, rest = seps[-1], ()
    for i, s in enumerate(seps):
        if s == "":
            sep = s
            break
        if s in text:
            sep, rest = s, seps[i + 1:]
            break
    pending: list[str] = []
    for piece in _pieces(text, sep):
        if len(piece) < size:
            pending.append(piece)
            continue
        if pending:
            _merge(pending, size, overlap, out)
            pending = []
        if rest:
            _split(piece, rest, size, overlap, out)
        else:
            out.append(piece)
    if pending:
        _merge(pending, size, overlap, out)


def split_text(text: str | None, chunk_size: int = 512, overlap: int = 150,
               separators: tuple[str, ...] = DEFAULT_SEPARATORS) -> list[str]:
    """Chunks of at most ``chunk_size`` code points with up to ``overlap`` shared."""
    if overlap > chunk_size:
        raise ValueError("overlap must not exceed chunk_size")
    out: list[str] = []
    if text:
        _split(text, tuple(separators), chunk_size, overlap, out)
    return out


def split_udf(chunk_size: int = 512, overlap: int = 150,
              separators: tuple[str, ...] = DEFAULT_SEPARATORS):
    """Arrow UDF ``text -> array<string>`` (chunk lists go back as one flat buffer)."""
    seps = tuple(separators)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def _udf(texts: pa.Array) -> pa.Array:
        parts = [split_text(t, chunk_size, overlap, seps) for t in texts.to_pylist()]
        offsets = np.zeros(len(parts) + 1, dtype=np.int32)
        np.cumsum([len(p) for p in parts], out=offsets[1:])
        flat = [c for p in parts for c in p]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.string()))

    return _udf


def chunk_documents(docs: DataFrame, chunk_size: int = 512, overlap: int = 150,
                    text_col: str = "text", id_col: str = "doc_id",
                    keep: tuple[str, ...] = ("source",),
                    separators: tuple[str, ...] = DEFAULT_SEPARATORS) -> DataFrame:
    """documents -> chunks(chunk_id, doc_id, <keep>, chunk_index, content).

    Tasks follow the input's partitions; spread a small scan first
    (``partitioning.spread``).

    ``chunk_id = sha2(doc_id|chunk_index|content)`` is stable, so a second
    ingest of the same text yields the same ids (K1 relies on it).
    """
    cols = [F.col(id_col).alias("doc_id")] + [F.col(c) for c in keep]
    # posexplode_outer + an explicit filter: an inner explode would make Spark
    # infer size(chunks) > 0 and evaluate the UDF a second time for that filter
    exploded = docs.select(*cols, F.posexplode_outer(split_udf(chunk_size, overlap, separators)(
        F.col(text_col))).alias("chunk_index", "content")).where(F.col("content").isNotNull())
    return exploded.select(
        chunk_id_expr(F.col("doc_id"), F.col("chunk_index"), F.col("content")).alias("chunk_id"),
        "doc_id", *keep, F.col("chunk_index").cast("int").alias("chunk_index"), "content")


def chunk_id_expr(doc_id, index, content):
    return F.sha2(F.concat_ws("|", doc_id.cast("string"), index.cast("string"), content), 256)


def add_release_metadata(chunks: DataFrame, source_col: str = "source") -> DataFrame:
    """T2 + T3: basename of the source, ``year`` and ``tag`` from ``rel_<n>`` names."""
    base = TX.basename(F.col(source_col))
    year = TX.release_year(base)
    return (chunks.withColumn(source_col, base)
            .withColumn("year", year)
            .withColumn("tag", TX.release_tag(F.col("year"))))


def release_name_report(chunks: DataFrame, source_col: str = "source") -> DataFrame:
    """H1: per source, whether it carries the release prefix and whether the
    number parsed; unparsable names become NULL years and are counted here."""
    base = TX.basename(F.col(source_col))
    d = chunks.select(base.alias("source")).distinct()
    return d.select(
        F.count_if(F.col("source").startswith(TX.RELEASE_PREFIX)).alias("n_release_names"),
        F.count_if(F.col("source").startswith(TX.RELEASE_PREFIX)
                   & TX.release_year(F.col("source")).isNull()).alias("n_unparsable"))


def window_chunks(docs: DataFrame, size: int = 512, step: int = 362, text_col: str = "text",
                  id_col: str = "doc_id") -> DataFrame:
    """Plain fixed windows (test aid with a SQL twin): start at 1, 1+step, ...
    while start <= length; each window is ``substring(text, start, size)``."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text_col), F.lit(1)), F.lit(step))
    w = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"),
                    F.posexplode(F.when(F.length(text_col) > 0, starts)).alias("chunk_index", "_s"))
    content = F.substring(F.col("_t"), F.col("_s"), size)
    return w.select(chunk_id_expr(F.col("doc_id"), F.col("chunk_index"), content).alias("chunk_id"),
                    "doc_id", F.col("chunk_index").cast("int").alias("chunk_index"),
                    content.alias("content"))
