"""Sinks and table maintenance (K1-K7).

Writes go to Parquet paths (on a cluster: shared storage). A vector table is a
folder of versions: each is a sub-folder ``v=<n>``, visible once Spark's
``_SUCCESS`` marker exists. K1 appends to the current version, K2 writes the next
one, so a reader of the current version is never overwritten under its feet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import duplicate_rows

#: Ids up to which a list of them is broadcast (after a count).
MAX_TOLD = 100_000


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _one_per_key(rows: DataFrame, key: str) -> DataFrame:
    """One row per key: that with the least hash over all columns, so a replay keeps the
    same one whatever the order of rows."""
    rest = [c for c in rows.columns if c != key]
    if not rest:
        return rows.distinct()
    plain = [c for c, t in rows.dtypes if "map<" not in t]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    best = rows.groupBy(key).agg(F.min_by(row, F.xxhash64(*[F.col(f"`{c}`") for c in plain])).alias("_row"))
    return best.select(*[F.col(f"`{c}`") if c == key else F.col("_row")[c].alias(c)
                         for c in rows.columns])


def vector_append(chunks: DataFrame, base: str, key: str = "chunk_id",
                  embed: Callable[[DataFrame], DataFrame] | None = None,
                  reads: dict | None = None) -> int:
    """K1: append chunks whose id is not in the table yet (re-delivery adds nothing).

    Rows go into the current version (the first append makes version 1), so K2 and
    ``read_current`` see one table. Ids are compared first, through the table's id index
    (``idindex``: Bloom filters, then the buckets that may hold one); ``embed`` (or any
    other costly step) runs on the rows that are left. Of rows that share an id one is
    kept, the same one on every replay; rows without an id are not kept apart. Returns the
    number of added rows; ``reads`` is filled with what was read of the index."""
    from .idindex import IdIndex

    spark = chunks.sparkSession
    have = versions(spark, base)
    # made once, read for ids and then for what is left
    new = _distinct(_written(chunks, "append"), key)
    if have:
        index = IdIndex(spark, base, have[-1], key)
        index.ready(read_current(spark, base))
        held = _written(index.held(new.select(key), reads), "held")
        same = F.col(key).eqNullSafe(F.col("_k"))
        ids = _written(new.select(key).join(held, same, "left_anti"), "new-ids")
        left, gone = ids.count(), held.count()
        if not left:
            return 0
        if gone:
            left_ids = ids.select(F.col(key).alias("_k"))
            new = (new.join(F.broadcast(left_ids), same, "left_semi") if left <= MAX_TOLD else
                   new.join(F.broadcast(held) if gone <= MAX_TOLD else held, same, "left_anti"))
    if embed is not None:
        new = embed(new)
    seen = Observation()
    new = new.observe(seen, F.count(F.lit(1)).alias("n"))
    if have:
        new.write.mode("append").parquet(f"{base.rstrip('/')}/v={have[-1]}")
        if seen.get["n"]:
            index.add(ids)
    else:
        write_version(new, base)
    return int(seen.get["n"])


def _written(df: DataFrame, name: str) -> DataFrame:
    from ..session import scratch_path

    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _distinct(rows: DataFrame, key: str) -> DataFrame:
    """``_one_per_key`` of written rows, where only rows of repeated keys are moved: the keys
    are counted without the other columns."""
    twice = _written(rows.groupBy(F.col(key).alias("_twice")).agg(F.count(F.lit(1)).alias("_n"))
                     .where("_n > 1").select("_twice"), "twice")
    n = twice.count()
    if not n:
        return rows
    if n > MAX_TOLD:
        return _one_per_key(rows, key)
    same = F.col(key).eqNullSafe(F.col("_twice"))
    return rows.join(F.broadcast(twice), same, "left_anti").unionByName(
        _one_per_key(rows.join(F.broadcast(twice), same, "left_semi"), key))


def _version_folders(spark: SparkSession, base: str) -> dict[int, bool]:
    """Version number -> whether it was committed."""
    fs, p = _fs(spark, base)
    if not fs.exists(p):
        return {}
    return {int(st.getPath().getName()[2:]): fs.exists(st.getPath().suffix("/_SUCCESS"))
            for st in fs.listStatus(p) if st.getPath().getName().startswith("v=")}


def versions(spark: SparkSession, base: str) -> list[int]:
    return sorted(v for v, done in _version_folders(spark, base).items() if done)


def read_current(spark: SparkSession, base: str) -> DataFrame:
    v = versions(spark, base)
    if not v:
        raise FileNotFoundError(f"no committed version under {base}")
    return spark.read.parquet(f"{base.rstrip('/')}/v={v[-1]}")


def write_version(df: DataFrame, base: str) -> int:
    """Write ``df`` as the next version of the table at ``base``; a number that an
    unfinished write has taken is left alone."""
    n = max(_version_folders(df.sparkSession, base), default=0) + 1
    df.write.mode("errorifexists").parquet(f"{base.rstrip('/')}/v={n}")
    return n


def vector_delete(spark: SparkSession, base: str, ids: DataFrame, key: str = "chunk_id") -> int:
    """K2: new version without the given ids (never rewrites the version being read)."""
    cur = read_current(spark, base)
    return write_version(cur.join(ids.select(key), key, "left_anti"), base)


def dedup_collection(spark: SparkSession, base: str, content: str = "content",
                     key: str = "chunk_id") -> int:
    """R5 + K2 as one job: a new version without the later copies of any content
    (first by id). Returns its number."""
    cur = read_current(spark, base)
    return vector_delete(spark, base, duplicate_rows(cur, content, (key,), (key,)), key)


def write_prompts(prompts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3."""
    prompts.write.mode(mode).parquet(path)


def write_dataset(dataset: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K4: one folder per split."""
    dataset.write.mode(mode).partitionBy("split").parquet(path)


def write_answers(answers: DataFrame, path: str, task: str = "") -> None:
    """K5: ``Question_ID,Answer_ID,Task`` CSV parts with a header each."""
    (answers.select(F.col("Question_ID").cast("string"), F.col("Answer_ID").cast("string"),
                    F.lit(task).alias("Task"))
     .write.mode("overwrite").option("header", True).csv(path))


def route_splits(run_mode: int, train: DataFrame | None = None,
                 test: DataFrame | None = None) -> DataFrame:
    """K6: 0 = train, 1 = test, 2 = both, as one DataFrame tagged by ``split``."""
    wanted = {0: ["train"], 1: ["test"], 2: ["train", "test"]}.get(run_mode)
    given = {"train": train, "test": test}
    if wanted is None or any(given[w] is None for w in wanted):
        raise ValueError("run_mode must be 0, 1 or 2 with all of its inputs")
    parts = [given[w].withColumn("split", F.lit(w)) for w in wanted]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def graph_append(edges: DataFrame, nodes: DataFrame, base: str) -> tuple[int, int]:
    """K7: add new nodes and relationships to the ``nodes``/``edges`` tables."""
    n_nodes = vector_append(nodes.withColumn("node_key", F.concat_ws("|", "id", "type")),
                            f"{base}/nodes", key="node_key")
    e = edges.withColumn("edge_key", F.sha2(F.concat_ws("|", "src", "dst", "type", "chunk_id"), 256))
    n_edges = vector_append(e, f"{base}/edges", key="edge_key")
    return n_nodes, n_edges
