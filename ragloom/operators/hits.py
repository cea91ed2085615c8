"""Operators on ranked hit lists.

A hit list is a DataFrame with one row per (question, chunk) and an explicit
``rank`` (1 = best); row order is never relied on. All windows partition by
the question id, so after the first shuffle on it every later window of the
chain reuses the same partitioning (Spark's HashPartitioning(question_id)
satisfies ClusteredDistribution(question_id, ...)), and each group is bounded
by the retriever's k.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX

QID = "question_id"


def merge_interleave(*lists: DataFrame, qid: str = QID, rank: str = "rank") -> DataFrame:
    """Round-robin merge: position i of list 1, position i of list 2, ...
    Exhausted lists are skipped, so the new rank is the order of (rank, list)."""
    tagged = None
    for i, df in enumerate(lists):
        t = df.withColumn("_src", F.lit(i))
        tagged = t if tagged is None else tagged.unionByName(t, allowMissingColumns=True)
    w = Window.partitionBy(qid).orderBy(rank, "_src")
    return tagged.withColumn(rank, F.row_number().over(w)).drop("_src")


def dedup_hits(hits: DataFrame, qid: str = QID, content: str = "content",
               rank: str = "rank") -> DataFrame:
    """Drop hits whose stripped content repeats an earlier hit of the same
    question (first in rank order wins, stored content is kept), then re-rank."""
    key = F.sha2(TX.strip(F.col(content)), 256)
    first = Window.partitionBy(qid, "_k").orderBy(rank)
    kept = (hits.withColumn("_k", key).withColumn("_n", F.row_number().over(first))
            .where(F.col("_n") == 1).drop("_k", "_n"))
    return kept.withColumn(rank, F.row_number().over(Window.partitionBy(qid).orderBy(rank)))


def overlap_score(question, content) -> Column:
    """E3 default (lexical): share of the question's distinct words found in the chunk."""
    qw = F.array_distinct(TX.words(question))
    cw = F.array_distinct(TX.words(content))
    return (F.size(F.array_intersect(qw, cw)).cast("double")
            / F.greatest(F.size(qw), F.lit(1)).cast("double"))


def rerank_topn(hits: DataFrame, top_n: int, score: Column | None = None, qid: str = QID,
                rank: str = "rank", question: str = "question",
                content: str = "content") -> DataFrame:
    """Score every hit against its question, keep the best ``top_n``
    (ties keep the earlier rank); ``rank`` becomes the score order."""
    s = score if score is not None else overlap_score(F.col(question), F.col(content))
    w = Window.partitionBy(qid).orderBy(F.desc("score"), rank)
    return (hits.withColumn("score", s).withColumn(rank, F.row_number().over(w))
            .where(F.col(rank) <= top_n))


def long_context_reorder(hits: DataFrame, qid: str = QID, rank: str = "rank") -> DataFrame:
    """Best hits at both ends, worst in the middle.

    For rank r of n: ranks with the parity of n come first in ascending order,
    the others follow in descending order (n=5 -> 1,3,5,4,2; n=4 -> 2,4,3,1).
    The new position is closed-form, so only a count over the group is needed.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(qid))
    r = F.col(rank)
    front = F.ceil(n / 2)
    same = (n - r) % 2 == 0
    first_same = F.when(n % 2 == 1, F.lit(1)).otherwise(F.lit(2))
    pos = F.when(same, (r - first_same) / 2 + 1).otherwise(front + (n - 1 - r) / 2 + 1)
    return hits.withColumn(rank, pos.cast("int"))


def build_context(hits: DataFrame, qid: str = QID, rank: str = "rank",
                  content: str = "content") -> DataFrame:
    """P3 (+H10): contents in rank order joined by one space, then ``\\n`` -> ``". "``.
    One row per question; the group is bounded by the retriever's top_n."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("p"), F.col(content).alias("c"))))
    joined = F.array_join(F.transform(ordered, lambda s: s["c"]), " ")
    return hits.groupBy(qid).agg(TX.newline_to_period(joined).alias("context"),
                                 F.count(F.lit(1)).alias("n_hits"))


def fallback(primary: DataFrame, questions: DataFrame, backup, qid: str = QID) -> DataFrame:
    """Questions with no primary hit are retried with ``backup(questions)``."""
    missing = questions.join(primary.select(qid).distinct(), qid, "left_anti")
    return primary.unionByName(backup(missing), allowMissingColumns=True)


def backup_k(k: int) -> int:
    """H8: the backup retriever uses k // 100 results, at least one."""
    return max(1, int(k) // 100)


# ---------------------------------------------------------------------------
# R2 maximal marginal relevance


def mmr_select(query: np.ndarray, cands: np.ndarray, k: int, lambda_mult: float) -> list[int]:
    """Greedy MMR over candidates given in distance order (cosine for both terms).

    First pick: most similar to the query; then the unpicked candidate with the
    largest ``lambda*sim(q,c) - (1-lambda)*max sim(c, picked)``; strict ``>``
    keeps the earlier candidate on ties; stops at ``min(k, n)``.
    """
    n = len(cands)
    if min(k, n) <= 0:
        return []

    c = cands.astype(np.float64)
    q = query.astype(np.float64)
    cn = np.sqrt((c * c).sum(axis=1))

    def cos(x: np.ndarray, xn: float) -> np.ndarray:
        # dot / (|a| |b|), zero where a norm is zero; per-row sums keep it
        # deterministic for identical rows
        den = cn * xn
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(den > 0, (c * x).sum(axis=1) / np.where(den > 0, den, 1.0), 0.0)

    qs = cos(q, float(np.sqrt((q * q).sum())))
    picked = [int(np.argmax(qs))]
    red = cos(c[picked[0]], cn[picked[0]])
    taken = np.zeros(n, dtype=bool)
    taken[picked[0]] = True
    while len(picked) < min(k, n):
        score = lambda_mult * qs - (1.0 - lambda_mult) * red
        score[taken] = -np.inf
        nxt = int(np.argmax(score))
        picked.append(nxt)
        taken[nxt] = True
        red = np.maximum(red, cos(c[nxt], cn[nxt]))
    return picked


def mmr(candidates: DataFrame, query_vectors: DataFrame, k: int, lambda_mult: float = 0.5,
        qid: str = QID, vid: str = "chunk_id", qvec: str = "embedding",
        fetch_k: int | None = None, similarity_k: int = 0,
        payload: tuple[str, ...] = ()) -> DataFrame:
    """R2: MMR over each question's candidates (``knn(..., with_vectors=True)``,
    in distance order). One group per question, bounded by the candidate depth.

    With ``similarity_k > 0`` the same pass also emits the plain similarity
    list (the first ``similarity_k`` candidates) tagged ``_src = 0`` next to the
    MMR picks (``_src = 1``), so one kNN scan feeds both retrievers and
    ``merge_interleave_tagged`` merges them. ``payload`` columns pass through.
    """
    qv = query_vectors.select(F.col(qid), F.col(qvec).alias("_qvec"))
    joined = candidates.join(qv, qid, "inner")
    depth = fetch_k
    payload = tuple(payload)
    fields = [T.StructField(qid, candidates.schema[qid].dataType),
              T.StructField(vid, candidates.schema[vid].dataType),
              T.StructField("rank", T.IntegerType()), T.StructField("distance", T.DoubleType()),
              T.StructField("_src", T.IntegerType())]
    fields += [T.StructField(c, candidates.schema[c].dataType) for c in payload]
    schema = T.StructType(fields)
    names = [f.name for f in schema.fields]
    cols = [qid, vid, "distance", *payload]

    def per_question(pdf: pd.DataFrame) -> list[pd.DataFrame]:
        pdf = pdf.sort_values("rank")
        parts = []
        if similarity_k > 0:
            sim = pdf[pdf["rank"] <= similarity_k]
            parts.append(sim[cols].assign(rank=sim["rank"].astype(np.int32).to_numpy(), _src=0))
        pool = pdf if depth is None else pdf[pdf["rank"] <= depth]
        if len(pool) and k > 0:
            cands = np.stack([np.asarray(x, dtype=np.float64) for x in pool["cand_vec"]])
            order = mmr_select(np.asarray(pool["_qvec"].iloc[0], dtype=np.float64), cands, k,
                               lambda_mult)
            sel = pool.iloc[order]
            parts.append(sel[cols].assign(rank=np.arange(1, len(order) + 1, dtype=np.int32),
                                          _src=1))
        return parts

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for _, g in pdf.groupby(qid, sort=False):
            parts.extend(per_question(g))
        if not parts:
            return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})
        return pd.concat(parts)[names]

    def kernel(batches):
        # rows arrive clustered by question; a question cut by a batch
        # boundary is carried into the next batch
        carry = None
        for pdf in batches:
            if carry is not None and len(carry):
                pdf = pd.concat([carry, pdf], ignore_index=True)
            if len(pdf) == 0:
                continue
            last = pdf[qid].iloc[-1]
            tail = (pdf[qid] == last).to_numpy()
            carry = pdf[tail]
            done = pdf[~tail]
            if len(done):
                yield run(done)
        if carry is not None and len(carry):
            yield run(carry)

    clustered = joined.repartition(qid).sortWithinPartitions(qid, "rank")
    out = clustered.mapInPandas(kernel, schema)
    return out if similarity_k > 0 else out.drop("_src")


def merge_interleave_tagged(hits: DataFrame, qid: str = QID, rank: str = "rank",
                            src: str = "_src") -> DataFrame:
    """R3 over lists already stacked in one DataFrame and tagged by ``src``."""
    w = Window.partitionBy(qid).orderBy(rank, src)
    return hits.withColumn(rank, F.row_number().over(w)).drop(src)


#: Turns of a conversation that are scored against its questions in one group.
TURN_BLOCK = 2000


def best_later(questions: DataFrame, turns: DataFrame, blocks: DataFrame, top_n: int) -> DataFrame:
    """(question_id, turn, content, score): of all turns after ``a_turn`` in a question's
    conversation a superset of the best ``top_n`` by ``overlap_score`` (ties: the earlier).

    ``blocks`` (conv_id, n) names conversations that are cut: each block of questions meets
    each block of turns in a group of its own, and only its best leave it."""

    def cut(df, mine, other):
        n = F.coalesce("n", F.lit(1))
        return (df.where(F.col("conv_id").isNotNull()).join(F.broadcast(blocks), "conv_id", "left")
                .withColumn(mine, F.pmod(F.xxhash64("turn"), n))
                .withColumn(other, F.explode(F.sequence(F.lit(0), n - 1))))

    def hashed(text):
        return F.transform(F.array_distinct(TX.words(F.col(text))), lambda w: F.xxhash64(w))

    left = cut(questions.withColumnRenamed("a_turn", "turn"), "i", "j").select(
        "conv_id", F.col("i").cast("int"), F.col("j").cast("int"), F.lit(1).alias("side"),
        F.col("turn").cast("long"), QID, hashed("question").alias("words"))
    right = cut(turns, "j", "i").select(
        "conv_id", F.col("i").cast("int"), F.col("j").cast("int"), F.lit(0).alias("side"),
        F.col("turn").cast("long"), F.col("text").alias(QID), hashed("text").alias("words"))

    def run(batches):
        rows = (r for b in batches for at in range(0, b.num_rows, 256)
                for r in zip(*(c.slice(at, 256).to_pylist() for c in b.columns)))
        for _, group in groupby(rows, key=lambda r: r[:3]):
            held, asked = [], None
            out = []
            for _, _, _, side, turn, text, words in group:
                if not side:
                    held.append((turn, text, words))
                    continue
                if asked is None:
                    at = np.array([t for t, _, _ in held], np.int64)
                    known = np.array([w is not None for _, _, w in held], bool)
                    token = np.array([x for _, _, w in held for x in w or ()], np.int64)
                    owner = np.repeat(np.arange(len(held)), [len(w or ()) for _, _, w in held])
                    order = np.argsort(token, kind="stable")
                    token, owner, asked = token[order], owner[order], True
                score = np.zeros(len(held))
                for x in words or ():
                    lo, hi = np.searchsorted(token, x, "left"), np.searchsorted(token, x, "right")
                    score[owner[lo:hi]] += 1
                score /= max(1, len(words or ()))
                score[~known if words is not None else slice(None)] = -1
                later = np.flatnonzero(at > turn)
                for k in later[np.lexsort((at[later], -score[later]))[:top_n]]:
                    out.append((text, int(at[k]), held[k][1], score[k] if score[k] >= 0 else None))
                if len(out) > 1000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.float64()))],
            names=[QID, "turn", "content", "score"])

    return (left.unionByName(right).repartition("conv_id", "i", "j")
            .sortWithinPartitions("conv_id", "i", "j", "side", "turn")
            .mapInArrow(run, f"{QID} string, turn long, content string, score double"))
