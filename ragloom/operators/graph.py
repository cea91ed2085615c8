"""E7 graph_extract and K7 graph_sink.

An extractor is a Column function ``text -> array<struct<src, src_type,
rel, dst, dst_type>>``; a model-backed one is a pandas UDF of that shape
(``batch_extractor``). The shipped default is a co-occurrence extractor
written with built-in expressions: in every sentence, capitalised words are
entities and each entity is linked to the next one in the same sentence
(consecutive pairs only, so the edge count is linear in the text).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


EDGE_TYPE = T.StructType([
    T.StructField("src", T.StringType()), T.StructField("src_type", T.StringType()),
    T.StructField("rel", T.StringType()), T.StructField("dst", T.StringType()),
    T.StructField("dst_type", T.StringType())])

SENTENCE_SPLIT = "[.!?\n]+"
ENTITY_PATTERN = r"^\p{Lu}"


def cooccurrence_extractor(entity_type: str = "Entity", rel: str = "NEXT_TO"
                           ) -> Callable[[Column], Column]:
    """Sentences end at ``[.!?\n]+``; each is written as a ``.`` token, so the
    text becomes one token stream where entities and sentence breaks alternate,
    and an edge is a pair of neighbouring stream items that are both entities.
    Every step is linear in the text (no per-index lambda)."""
    def extract(text: Column) -> Column:
        marked = F.regexp_replace(F.coalesce(text, F.lit("")), SENTENCE_SPLIT, " . ")
        toks = F.split(marked, r"[^\p{L}\p{N}.]+")
        stream = F.transform(F.filter(toks, lambda t: (t == F.lit(".")) | t.rlike(ENTITY_PATTERN)),
                             F.lower)
        nxt = F.slice(stream, 2, F.greatest(F.size(stream) - 1, F.lit(1)))
        pairs = F.arrays_zip(stream.alias("a"), nxt.alias("b"))
        pairs = F.filter(pairs, lambda p: p["b"].isNotNull() & (p["a"] != F.lit("."))
                         & (p["b"] != F.lit(".")))
        return F.transform(pairs, lambda p: F.struct(
            p["a"].alias("src"), F.lit(entity_type).alias("src_type"), F.lit(rel).alias("rel"),
            p["b"].alias("dst"), F.lit(entity_type).alias("dst_type")))

    return extract


def batch_extractor(fn: Callable[[list[str]], list[list[dict]]]) -> Callable[[Column], Column]:
    """Wrap a Python batch extractor (texts -> lists of edge dicts) as a Column function."""
    @F.pandas_udf(T.ArrayType(EDGE_TYPE))
    def _ext(texts: pd.Series) -> pd.Series:
        return pd.Series(fn(texts.fillna("").tolist()))
    return _ext


def extract_graph(chunks: DataFrame, extractor: Callable[[Column], Column],
                  text: str = "text", chunk_id: str = "chunk_id") -> DataFrame:
    """edges(src, dst, type, chunk_id) of every chunk, one row per distinct edge and chunk
    (chunk ids must be unique: distinct inside the row, no shuffle).
    Extraction is heavy per-row work: spread a small scan first."""
    # explode_outer + filter: no inferred size() filter re-running a UDF extractor
    e = chunks.select(F.col(chunk_id).alias("chunk_id"),
                      F.explode_outer(F.array_distinct(extractor(F.col(text)))).alias("e")
                      ).where(F.col("e").isNotNull())
    return e.select(F.col("e.src").alias("src"), F.col("e.dst").alias("dst"),
                    F.col("e.rel").alias("type"), F.col("e.src_type").alias("src_type"),
                    F.col("e.dst_type").alias("dst_type"), "chunk_id")


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Distinct (id, type) over both ends of the edges."""
    a = edges.select(F.col("src").alias("id"), F.col("src_type").alias("type"))
    b = edges.select(F.col("dst").alias("id"), F.col("dst_type").alias("type"))
    return a.unionByName(b).distinct()
