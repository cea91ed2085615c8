"""Composite retrieval (R8 retrieve_pipeline, R9 retrieve_simple, R10, R11)
and prompt building (D1, D2).

One call retrieves for a whole table of questions: one kNN pass over the
chunk table (shared by similarity and MMR, computed with max(k, fetch_k)),
then window steps that all partition by the question id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import embed as EM
from ..functions import prompts as PR
from ..functions import text as TX
from ..operators import hits as H
from ..operators import knn as KNN

QID = "question_id"


@dataclass(frozen=True)
class RetrieverConfig:
    k: int = 200
    fetch_k: int = 20
    lambda_mult: float = 0.5
    top_n: int = 5
    metric: str = "l2"
    use_similarity: bool = True
    use_mmr: bool = True
    dedup: bool = True
    rerank: bool = True
    reorder: bool = True
    embedder: str = "hash"
    dim: int = EM.DEFAULT_DIM
    # approximate search (IVF) instead of the exact one when ivf_cells > 0
    ivf_cells: int = 0
    ivf_nprobe: int = 8
    # chunks are a stored table (``sinks.chunks.store_chunks``): the search moves ids and
    # distances only, text and vectors are fetched by id after the merge
    late: bool = False
    # E3 plug-in: (question column, content column) -> score column
    scorer: Callable[[Column, Column], Column] | None = None


def embed_questions(questions: DataFrame, cfg: RetrieverConfig, text: str = "question") -> DataFrame:
    return questions.select(QID, F.col(text).alias("question"),
                            EM.embed(F.col(text), cfg.embedder, "query", cfg.dim).alias("embedding"))


def retrieve(questions: DataFrame, chunks: DataFrame, cfg: RetrieverConfig,
             text: str = "question", chunk_filter: Column | None = None) -> DataFrame:
    """hits(question_id, chunk_id, content, rank, score, distance).

    ``chunks`` needs ``chunk_id, content, embedding``; ``chunk_filter`` (P13)
    is applied to the chunk table before the search, so it reaches the scan.
    """
    if chunk_filter is not None:
        chunks = chunks.where(chunk_filter)
    qv = embed_questions(questions, cfg, text)
    depth = max(cfg.k if cfg.use_similarity else 0, cfg.fetch_k if cfg.use_mmr else 0)
    # one scan of the chunk table; unless it is fetched late, the text rides along
    ride = {} if cfg.late else {"with_vectors": cfg.use_mmr, "payload": ("content",)}
    if cfg.ivf_cells > 0:
        from ..operators.ivf import knn_ivf

        cand = knn_ivf(qv, chunks, depth, cfg.ivf_cells, cfg.ivf_nprobe, cfg.metric,
                       vector_id="chunk_id", **ride)
    else:
        cand = KNN.knn(qv, chunks, depth, cfg.metric, vector_id="chunk_id", **ride)
    if cfg.late:
        cand = cand.join(chunks.select("chunk_id", "content", *(
            [F.col("embedding").cast("array<float>").alias("cand_vec")] if cfg.use_mmr else [])),
            "chunk_id")
    if cfg.use_mmr:
        both = H.mmr(cand, qv, cfg.k, cfg.lambda_mult, fetch_k=cfg.fetch_k,
                     similarity_k=cfg.k if cfg.use_similarity else 0, payload=("content",))
        hits = H.merge_interleave_tagged(both) if cfg.use_similarity else both
    else:
        hits = cand.where(F.col("rank") <= cfg.k).select(QID, "chunk_id", "rank", "distance",
                                                         "content")
    if cfg.dedup:
        hits = H.dedup_hits(hits)
    if cfg.rerank:
        hits = hits.join(qv.select(QID, "question"), QID, "inner")
        score = (cfg.scorer(F.col("question"), F.col("content")) if cfg.scorer
                 else H.overlap_score(F.col("question"), F.col("content")))
        hits = H.rerank_topn(hits, cfg.top_n, score).drop("question")
    else:
        hits = hits.withColumn("score", F.lit(None).cast("double"))
    if cfg.reorder:
        hits = H.long_context_reorder(hits)
    return hits.select(QID, "chunk_id", "content", "rank", "score", "distance")


def apply_transformers(hits: DataFrame, questions: DataFrame,
                       transformers: list[Callable[[DataFrame, DataFrame], DataFrame]]) -> DataFrame:
    """A document-compressor pipeline; each step maps (hits, questions) -> hits."""
    for t in transformers:
        hits = t(hits, questions)
    return hits


def retrieve_with_fallback(questions: DataFrame, chunks: DataFrame, cfg: RetrieverConfig,
                           backup: RetrieverConfig | None = None, text: str = "question",
                           chunk_filter: Column | None = None,
                           backup_filter: Column | None = None) -> DataFrame:
    """Questions without any primary hit are answered by the backup
    retriever (by default the same chain with ``max(1, k // 100)`` results, over the
    same chunks unless ``backup_filter`` says otherwise). The primary hits are written
    once below ``spark.checkpoint.dir`` and read for both sides."""
    from dataclasses import replace

    from ..session import scratch_path

    backup = backup or replace(cfg, k=H.backup_k(cfg.k))
    spark, path = questions.sparkSession, scratch_path(questions.sparkSession, "primary")
    primary = retrieve(questions, chunks, cfg, text, chunk_filter)
    primary.write.parquet(path)
    primary = spark.read.schema(primary.schema).parquet(path)
    wider = chunk_filter if backup_filter is None else backup_filter
    return H.fallback(primary, questions, lambda q: retrieve(q, chunks, backup, text, wider))


def multi_query(variants: DataFrame, chunks: DataFrame, cfg: RetrieverConfig) -> DataFrame:
    """``variants(question_id, variant_no, question)`` -> unique union of
    the hits of every variant, in the order variant 1's hits, then variant 2's
    new hits, ... (original question last). One retrieval call for all.

    A chunk's first place is a minimum, aggregated before the shuffle, and places are
    counted by ``group_rank``: a question with any number of variants is no single group.
    Only ids and places take part in that; the other columns are fetched from the hits of
    that variant and rank at the end, so a caller without use for texts moves none."""
    from ..operators.blocks import written
    from ..operators.order import group_rank

    def key(qid):
        return F.concat_ws("#", F.col(qid).cast("string"), F.col("variant_no").cast("string"))

    keyed = variants.withColumn("_orig", F.col(QID)).withColumn(QID, key(QID))
    hits = retrieve(keyed, chunks, cfg)
    # read twice: the block form has written what it found, other hits are kept
    if cfg.use_mmr or cfg.dedup or cfg.rerank or keyed.count() <= KNN.MAX_BROADCAST_QUERIES:
        hits = written(hits, "variant-hits")
    rest = [c for c in hits.columns if c not in (QID, "chunk_id", "rank")]
    back = keyed.select(QID, "_orig", "variant_no")
    h = hits.select(QID, "chunk_id", "rank").join(back, QID).drop(QID).withColumnRenamed("_orig", QID)
    first = h.groupBy(QID, "chunk_id").agg(F.min(F.struct("variant_no", "rank")).alias("_p"))
    first = first.select(QID, "chunk_id", F.col("_p.variant_no").alias("variant_no"),
                         F.col("_p.rank").alias("_hit"))
    ranked = group_rank(first, [QID], ["variant_no", "_hit"]).withColumn("_keyed", key(QID))
    fetched = hits.select(F.col(QID).alias("_keyed"), F.col("rank").alias("_hit"), *rest)
    return ranked.join(fetched, ["_keyed", "_hit"]).select(
        *[c for c in hits.columns if c != QID], QID, "variant_no")


def generate_variants(questions: DataFrame, generator: str, make=None,
                      max_new_tokens: int = 256, batch_size: int = 128) -> DataFrame:
    """R11 front half: P7 prompt -> E4 generation -> T7 lines, original last."""
    from ..functions import models as MD

    gen = MD.generate(PR.multi_query_prompt(F.col("question")), generator, max_new_tokens,
                      batch_size, make)
    return variants_from_text(questions.select(QID, "question", gen.alias("generated")))


def variants_from_text(df: DataFrame, text: str = "generated", question: str = "question") -> DataFrame:
    """T7 + include_original: generated lines first (in order), original question last."""
    lines = TX.line_list(F.col(text))
    allq = F.concat(lines, F.array(F.col(question)))
    return df.select(QID, F.posexplode(allq).alias("_p", "question")) \
        .select(QID, (F.col("_p") + 1).alias("variant_no"), "question")


# ---------------------------------------------------------------------------
# Prompts from questions and hits


def inference_prompts(questions: DataFrame, hits: DataFrame, kind: str = "mcq",
                      with_counts: bool = False) -> DataFrame:
    """(question_id, prompt) for every question (empty context if no hit);
    ``with_counts`` adds ``n_hits`` from the same aggregation."""
    ctx = H.build_context(hits)
    q = questions.join(ctx, QID, "left_outer")
    context = F.coalesce(F.col("context"), F.lit(""))
    if kind == "mcq":
        p = PR.mcq_prompt(F.col("question"), context, F.col("options"))
    elif kind == "qa":
        p = PR.qa_prompt(F.col("question"), context)
    else:
        raise ValueError("kind must be 'mcq' or 'qa'")
    if with_counts:
        return q.select(QID, p.alias("prompt"),
                        F.coalesce(F.col("n_hits"), F.lit(0)).cast("long").alias("n_hits"))
    return q.select(QID, p.alias("prompt"))


def training_prompts(questions: DataFrame, hits: DataFrame, kinds: tuple[str, ...] = ("mcq",)
                     ) -> DataFrame:
    """(question_id, kind, prompt, answer, explanation); H13 ``kinds``."""
    ctx = H.build_context(hits)
    q = questions.join(ctx, QID, "left_outer")
    context = F.coalesce(F.col("context"), F.lit(""))
    outs = []
    for kind in kinds:
        if kind == "mcq":
            p = PR.mcq_prompt(F.col("question"), context, F.col("options"), F.col("answer"),
                              F.col("explanation"), show_answers=True)
        elif kind == "qa":
            p = PR.qa_prompt(F.col("question"), context, F.col("explanation"), show_answers=True)
        else:
            raise ValueError("kind must be 'mcq' or 'qa'")
        outs.append(q.select(QID, F.lit(kind).alias("kind"), p.alias("prompt"), "answer",
                             "explanation"))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out
