"""Ordering, sampling, splitting and batching.

Everything that needs the position of a row in a total order uses
``row_index``: a range-partitioned sort (Spark's distributed sort), a
per-partition position from ``monotonically_increasing_id`` and the prefix
sum of the partition sizes (one small row per partition). The sorted frame
is checkpointed into the shared ``spark.checkpoint.dir`` first, so both
passes see the same rows and a lost executor does not change them. No step
puts the table into one partition.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hash_order(id_col: str, seed: int | str) -> F.Column:
    """Seeded shuffle key: ``md5('<seed>:<id>')`` (ties broken by the id)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def row_index(df: DataFrame, order: list, name: str = "row_idx") -> DataFrame:
    """Add ``name`` = 0-based position of each row in ``order`` (exact, distributed)."""
    spark = df.sparkSession
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    mid = (df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
           .checkpoint(eager=True))
    part = F.shiftright(F.col("_mid"), 33)
    sizes = (mid.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c")))
    offsets = sizes.withColumn(
        "_off", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)))
    # one row per partition: a proven size bound for the broadcast
    return (mid.join(F.broadcast(offsets.select("_p", "_off")), part == F.col("_p"))
            .withColumn(name, F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_mid", "_p", "_off"))


def group_rank(df: DataFrame, group: list[str], order: list, name: str = "rank") -> DataFrame:
    """``name`` = 1-based place of each row in ``order`` within its ``group`` (which together
    must be a total order), exact for groups of any size: rows are sorted by ranges, so a
    large group lies in many partitions, and the rows of a group in earlier partitions are
    summed over one small row per (partition, group at its edge)."""
    keys = [F.col(g).asc_nulls_first() for g in group]
    spark = df.sparkSession
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    mid = (df.withColumnRenamed(name, "_old") if name in df.columns else df)
    order = ["_old" if c == name else c for c in order]
    mid = (mid.orderBy(*keys, *order).withColumn("_mid", F.monotonically_increasing_id())
           .checkpoint(eager=True))
    part = F.shiftright(F.col("_mid"), 33)
    # first row number and size of every group in every partition, aggregated per task
    runs = mid.groupBy(*group, part.alias("_p")).agg(F.min("_mid").alias("_first"),
                                                     F.count(F.lit(1)).alias("_c"))
    ahead = F.sum("_c").over(Window.partitionBy(*group).orderBy("_p").rowsBetween(
        Window.unboundedPreceding, -1))
    runs = runs.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_p", "_first",
                       F.coalesce(ahead, F.lit(0)).alias("_before"))
    same = part == F.col("_p")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (mid.join(runs, same)
            .withColumn(name, (F.col("_before") + F.col("_mid") - F.col("_first") + 1).cast("int"))
            .drop("_mid", "_p", "_first", "_before", "_old", *[f"_g{i}" for i in range(len(group))]))


def reverse_order(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """O2: process in reverse file order."""
    return df.orderBy(F.desc(ordinal))


def hash_threshold(df: DataFrame, n: int, id_col: str, seed: int | str, digits: int = 5):
    """The first ``n`` rows in the seeded hash order, as a condition.

    Rows without an id come after all others and cannot be told apart: where the cut
    falls among them, all of them are beyond it. A histogram of the first ``digits`` hash digits (at most 16 ** digits rows) gives the
    bucket in which the n-th row lies; only that bucket's keys are ordered."""
    h = hash_order(id_col, seed)
    bucket = F.substring(h, 1, digits)
    # one row a bucket, at most 16 ** digits
    total, last = 0, None
    df = df.where(F.col(id_col).isNotNull())
    for r in df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c")).orderBy("b").toLocalIterator():
        if total + r["c"] > n:
            last = r["b"]
            break
        total += r["c"]
    if last is None:
        return F.col(id_col).isNotNull()
    edge = (df.where(bucket == last).select(h.alias("h"), F.col(id_col).alias("i"))
            .orderBy("h", "i").offset(n - total).limit(1).first())
    return F.coalesce((h < F.lit(edge["h"]))
                      | ((h == F.lit(edge["h"])) & (F.col(id_col) < F.lit(edge["i"]))), F.lit(False))


def sample_n(df: DataFrame, n: int, id_col: str, seed: int = 123) -> DataFrame:
    """O3: exactly ``n`` rows picked by a seeded hash order; ``n < 0`` or ``n`` of at least
    the number of rows keeps all. A filter: no sort and no shuffle of the rows. Ids must be
    unique; rows without one are taken only together with all others."""
    return df if n < 0 or n >= df.count() else df.where(hash_threshold(df, n, id_col, seed))


def exact_split(df: DataFrame, id_col: str, test_size: float = 0.1, seed: int = 123,
                split_col: str = "split") -> DataFrame:
    """Shuffled train/test split with exactly ``ceil(test_size * n)`` test rows; like
    ``sample_n`` a filter. Ids must be unique; rows without one count, and are train unless
    every row is a test row."""
    ids = df.select(id_col)
    n = ids.count()
    n_test = math.ceil(test_size * n)
    first = F.lit(True) if n_test >= n else hash_threshold(ids, n_test, id_col, seed)
    return df.withColumn(split_col, F.when(first, F.lit("test")).otherwise(F.lit("train")))


def sort_by_id(df: DataFrame, id_col: str = "Question_ID") -> DataFrame:
    """O1: rows in the numeric order of their id (ids that are no number last, as text)."""
    return df.orderBy(F.expr(f"try_cast(`{id_col}` AS BIGINT)").asc_nulls_last(), F.col(id_col))


def split_sizes(df: DataFrame, split_col: str = "split") -> DataFrame:
    """A5: rows per split."""
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n_rows"))


def fixed_batches(df: DataFrame, size: int, order: list, name: str = "batch_id") -> DataFrame:
    """T5: consecutive groups of ``size`` rows in ``order``; the last may be short."""
    idx = row_index(df, order, "_i")
    return idx.withColumn(name, F.floor(F.col("_i") / F.lit(size)).cast("long")).drop("_i")


def balanced_shards(df: DataFrame, n_jobs: int, order: list, name: str = "shard_id") -> DataFrame:
    """``int(n / n_jobs) + 1`` rows per shard, in ``order``."""
    idx = row_index(df, order, "_i")
    n = idx.count()   # reads the checkpointed rows, not the upstream plan
    size = int(n / n_jobs) + 1
    return idx.withColumn(name, F.floor(F.col("_i") / F.lit(size)).cast("long")).drop("_i")
