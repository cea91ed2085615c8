"""R5 dedup_corpus, A2 duplicate_count, K2-style removal by id.

Copies are found on ``sha2(strip(content))`` so the shuffle carries 64-byte
keys, never the text. The first copy per key is chosen with a grouped
``min(struct(order..., id))``: Spark aggregates partially on the map side, so
a key held by a third of all rows still sends at most one row per map task.
The winners are then semi-joined back by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX


def content_key(content) -> F.Column:
    return F.sha2(TX.strip(content if not isinstance(content, str) else F.col(content)), 256)


def first_copies(df: DataFrame, content: str, order: tuple[str, ...], id_cols: tuple[str, ...]
                 ) -> DataFrame:
    """Ids of the first row per stripped content, first by ``order``."""
    fields = list(dict.fromkeys(order + id_cols))
    if len(fields) == 1:
        # one column: a plain min, aggregated by hash (partial on the map side)
        c = fields[0]
        keyed = df.select(content_key(content).alias("_k"), F.col(c))
        return keyed.groupBy("_k").agg(F.min(c).alias(c)).select(c)
    keyed = df.select(content_key(content).alias("_k"),
                      F.struct(*[F.col(c) for c in fields]).alias("_o"))
    win = keyed.groupBy("_k").agg(F.min("_o").alias("_o"))
    return win.select(*[F.col(f"_o.{c}").alias(c) for c in id_cols])


def dedup_corpus(df: DataFrame, content: str = "text", order: tuple[str, ...] = ("doc_id",),
                 id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keep the first row of every stripped content (stored content unchanged)."""
    return df.join(first_copies(df, content, order, id_cols), list(id_cols), "left_semi")


def duplicate_rows(df: DataFrame, content: str = "text", order: tuple[str, ...] = ("doc_id",),
                   id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Ids of the later copies, i.e. the rows a dedup run deletes."""
    return df.select(*id_cols).join(first_copies(df, content, order, id_cols), list(id_cols),
                                    "left_anti")


def duplicate_count(df: DataFrame, content: str = "text") -> DataFrame:
    """A2 + A3: all rows, distinct contents, removed rows (one row)."""
    keyed = df.select(content_key(content).alias("_k"))
    per_key = keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(F.sum("_n").cast("long").alias("n_rows"),
                       F.count(F.lit(1)).alias("n_unique"),
                       F.sum(F.col("_n") - 1).cast("long").alias("n_duplicates"))
