"""Queries over the driver's tables, one per §2.12 check row.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole input tables. Computed columns carry the same names as the SQL twins
in ``catalog_sql``; floats are rounded, ranks are INT, counts BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import embed as EM
from ..functions import text as TX
from ..operators import dedup as DD
from ..operators import evaluate as EV
from ..operators import graph as GR
from ..operators import hits as H
from ..operators import order as OR
from ..operators import tokens as TK
from ..operators.knn import knn
from ..operators.partitioning import spread
from ..operators.split import chunk_documents, window_chunks
from . import retrieve as RT

DIM = EM.DEFAULT_DIM


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus for heavy per-row stages (split, embed, extract): spread at the scan."""
    return spread(_t(spark, sf, "documents"))


# ---------------------------------------------------------------------------
# T1 / A3


def recursive_chunks(spark, sf):
    ch = chunk_documents(_docs(spark, sf), 512, 150)
    return ch.select("doc_id", "chunk_index", F.length("content").cast("long").alias("n_chars"),
                     F.md5("content").alias("content_md5"))


def chunk_stats(spark, sf):
    ch = chunk_documents(_docs(spark, sf), 512, 150)
    return ch.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.countDistinct("doc_id").alias("n_docs"),
        F.max(F.length("content")).cast("long").alias("max_chars"),
        F.sum(F.length("content")).cast("long").alias("total_chars"))


# ---------------------------------------------------------------------------
# retrieval chains


def _benchmark_questions(spark, sf):
    return _t(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"),
                                             F.col("text").alias("question"))


def _stored(chunks: DataFrame) -> DataFrame:
    """The chunk table as a retrieval user has it: split and embedded once, bucketed by id."""
    from ..sinks.chunks import store_chunks

    return store_chunks(chunks)


def _embedded(df: DataFrame, text: str = "content") -> DataFrame:
    return df.withColumn("embedding", EM.hash_embedding(F.col(text), DIM))


def retrieve_sql(spark, sf):
    """E1, R1, R4, R6, R7, P3, P5 over plain windows (512, step 362)."""
    chunks = _stored(_embedded(window_chunks(_docs(spark, sf), 512, 362)))
    q = _benchmark_questions(spark, sf)
    cfg = RT.RetrieverConfig(k=10, top_n=4, use_mmr=False, late=True)
    hits = RT.retrieve(q, chunks, cfg)
    return RT.inference_prompts(q, hits, kind="qa", with_counts=True)


def retrieve_mmr_sql(spark, sf):
    """The full R8 chain (similarity + MMR, merge, dedup, rerank, reorder, P3, P5)
    over plain windows, so that every step has a SQL twin."""
    chunks = _stored(_embedded(window_chunks(_docs(spark, sf), 512, 362)))
    q = _benchmark_questions(spark, sf)
    cfg = RT.RetrieverConfig(k=10, fetch_k=20, lambda_mult=0.5, top_n=5, late=True)
    hits = RT.retrieve(q, chunks, cfg)
    return RT.inference_prompts(q, hits, kind="qa", with_counts=True)


def retrieve_prompt(spark, sf):
    """Flagship: T1 chunks -> E1 -> stored table -> R1 + R2 -> R3 -> R4 -> R6 -> R7 -> P3 -> P4."""
    chunks = _stored(_embedded(chunk_documents(_docs(spark, sf), 512, 150))
                     .select("chunk_id", "content", "embedding"))
    q = _benchmark_questions(spark, sf).withColumn(
        "options", F.array().cast("array<struct<key:string,value:string>>"))
    cfg = RT.RetrieverConfig(k=10, fetch_k=20, lambda_mult=0.5, top_n=5, late=True)
    hits = RT.retrieve(q, chunks, cfg)
    return RT.inference_prompts(q, hits, kind="mcq", with_counts=True)


def rerank_overlap(spark, sf):
    """E3 + R6: kNN (k=20) over whole documents, best 5 by word overlap."""
    docs = _embedded(_docs(spark, sf).select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")))
    q = _benchmark_questions(spark, sf)
    cfg = RT.RetrieverConfig(k=20, top_n=5, use_mmr=False, dedup=False, reorder=False)
    hits = RT.retrieve(q, docs, cfg)
    return hits.select(F.col("question_id").alias("item_id"), F.col("chunk_id").alias("doc_id"),
                       "rank", F.round("score", 6).alias("score"))


def hash_embed(spark, sf):
    docs = _t(spark, sf, "documents").select(F.lit("documents").alias("kind"),
                                             F.col("doc_id").alias("id"), "text")
    bench = _t(spark, sf, "benchmark").select(F.lit("benchmark").alias("kind"),
                                              F.col("item_id").alias("id"), "text")
    e = spread(docs.unionByName(bench)).select("kind", "id",
                                               EM.hash_embedding(F.col("text"), DIM).alias("v"))
    return (e.select("kind", "id", F.posexplode_outer("v").alias("dim", "w"))
            .where(F.col("w") != 0)
            .select("kind", "id", F.col("dim").cast("int").alias("dim"),
                    F.round(F.col("w").cast("double"), 6).alias("w")))


# ---------------------------------------------------------------------------
# vectors


def _vec(spark, sf):
    return _t(spark, sf, "embeddings")


def _queries(spark, sf):
    return _vec(spark, sf).select(F.col("vec_id").alias("query_id"), "embedding", "label")


def _knn_out(df):
    return df.select("query_id", "vec_id", "rank", F.round("distance", 4).alias("distance"))


def knn_l2(spark, sf):
    return _knn_out(knn(_queries(spark, sf), _vec(spark, sf), 10, "l2", query_id="query_id",
                        vector_id="vec_id"))


def knn_codes(spark, sf):
    """R1 on two large sides: the vector-approximation file, exact; all vectors as queries."""
    from ..operators.vafile import knn_codes as codes

    return _knn_out(codes(_queries(spark, sf), _vec(spark, sf), 10, "l2", query_id="query_id",
                          vector_id="vec_id"))


def knn_cosine(spark, sf):
    return _knn_out(knn(_queries(spark, sf), _vec(spark, sf), 10, "cosine",
                        query_id="query_id", vector_id="vec_id"))


def knn_filtered(spark, sf):
    """The metadata predicate is applied to the vector table before the search."""
    v = _vec(spark, sf).where(F.col("label") < 5)
    return _knn_out(knn(_queries(spark, sf), v, 5, "l2", query_id="query_id", vector_id="vec_id"))


def mmr(spark, sf):
    q = _queries(spark, sf)
    cand = knn(q, _vec(spark, sf), 20, "l2", query_id="query_id", vector_id="vec_id",
               with_vectors=True)
    out = H.mmr(cand, q, 5, 0.5, qid="query_id", vid="vec_id")
    return out.select("query_id", "vec_id", "rank")


def _two_lists(spark, sf):
    q = _queries(spark, sf)
    v = _vec(spark, sf)
    a = knn(q, v.where(F.col("label") < 6), 5, "l2", query_id="query_id", vector_id="vec_id")
    b = knn(q, v.where(F.col("label") > 3), 5, "cosine", query_id="query_id", vector_id="vec_id")
    return a.select("query_id", "vec_id", "rank"), b.select("query_id", "vec_id", "rank")


def merge_dedup(spark, sf):
    """R3 then R4 (content = the vector id as text)."""
    a, b = _two_lists(spark, sf)
    merged = H.merge_interleave(a, b, qid="query_id")
    merged = merged.withColumn("content", F.col("vec_id").cast("string"))
    return H.dedup_hits(merged, qid="query_id").select("query_id", "vec_id", "rank")


def long_context_order(spark, sf):
    return H.long_context_reorder(merge_dedup(spark, sf), qid="query_id")


def fallback_hits(spark, sf):
    """primary = l2 top-3 among label < 3 within distance 1.3; questions
    left without a hit get the backup (cosine, k = max(1, 3 // 100))."""
    q = _queries(spark, sf)
    v = _vec(spark, sf)
    primary = (knn(q, v.where(F.col("label") < 3), 3, "l2", query_id="query_id",
                   vector_id="vec_id")
               .where(F.col("distance") <= 1.3).withColumn("retriever", F.lit("primary")))

    def backup(missing):
        return knn(missing, v, H.backup_k(3), "cosine", query_id="query_id",
                   vector_id="vec_id").withColumn("retriever", F.lit("backup"))

    out = H.fallback(primary, q.select("query_id", "embedding"), backup, qid="query_id")
    return out.select("query_id", "vec_id", "rank", "retriever",
                      F.round("distance", 4).alias("distance"))


def accuracy(spark, sf):
    """Leave-one-out 5-NN label vote against the stored label."""
    q = _queries(spark, sf)
    v = _vec(spark, sf)
    nn = (knn(q, v, 6, "l2", query_id="query_id", vector_id="vec_id")
          .where(F.col("query_id") != F.col("vec_id")))
    nn = nn.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))) \
        .where(F.col("r") <= 5)
    votes = (nn.join(v.select("vec_id", "label"), "vec_id")
             .groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n")))
    best = votes.withColumn("b", F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("n"), "label"))).where(F.col("b") == 1)
    pred = best.select(F.col("query_id").cast("string").alias("Question_ID"),
                       F.col("label").cast("string").alias("Answer_ID"))
    truth = v.select(F.col("vec_id").cast("string").alias("Question_ID"),
                     F.col("label").cast("string").alias("Answer_ID"))
    return EV.accuracy(pred, truth)


def _ivf(spark, sf, exact):
    from ..operators.ivf import cells_for
    from ..operators.ivf import knn_ivf as ivf

    v = _vec(spark, sf)
    rows = v.count()
    n = cells_for(rows)
    # cells are fitted on 256 vectors each; every vector is indexed
    part = min(1.0, 256 * n / max(1, rows))
    # vectors without structure need most cells for a recall of 0.95
    return _knn_out(ivf(_queries(spark, sf), v, 10, n, max(1, n // 8 if exact else n * 3 // 4), "l2",
                        query_id="query_id", vector_id="vec_id", exact=exact, train_fraction=part))


def knn_ivf(spark, sf):
    """l2 top-10 by cell pruning (about sqrt(n) cells), exact; all vectors as queries."""
    return _ivf(spark, sf, True)


def ivf_recall(spark, sf):
    """Recall@10 of the IVF search against the exact search (one row)."""
    from ..operators.ivf import recall_at_k

    exact = knn(_queries(spark, sf), _vec(spark, sf), 10, "l2", query_id="query_id",
                vector_id="vec_id")
    return recall_at_k(_ivf(spark, sf, False), exact, "query_id", "vec_id", 10)


# ---------------------------------------------------------------------------
# corpus maintenance


def dedup_corpus(spark, sf):
    return DD.dedup_corpus(_t(spark, sf, "documents")).select("doc_id", "source")


def duplicate_count(spark, sf):
    return DD.duplicate_count(_t(spark, sf, "documents"))


def source_metadata(spark, sf):
    d = _t(spark, sf, "documents")
    path = F.concat(F.lit("/data/"), F.col("source"), F.lit("/"),
                    F.when(F.col("lang") == "en",
                           F.concat(F.lit("rel_"), (F.col("n_chars") % 20).cast("string"),
                                    F.lit(".docx")))
                    .when(F.col("lang") == "fr", F.concat(F.lit("rel_"), F.col("lang"),
                                                          F.lit(".docx")))
                    .otherwise(F.concat(F.col("source"), F.lit(".docx"))))
    base = TX.basename(path)
    year = TX.release_year(base)
    return d.select("doc_id", path.alias("path"), base.alias("source"), year.alias("year"),
                    TX.release_tag(year).alias("tag"))


# ---------------------------------------------------------------------------
# order / split / batches


def exact_split(spark, sf):
    return OR.exact_split(_t(spark, sf, "documents").select("doc_id"), "doc_id", 0.1, 123)


def split_sizes(spark, sf):
    return OR.split_sizes(exact_split(spark, sf))


def sample_n(spark, sf):
    return OR.sample_n(_t(spark, sf, "documents").select("doc_id"), 25, "doc_id", 123)


def reverse_order(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id")
    return OR.row_index(d, [F.desc("doc_id")], "position")


def batches(spark, sf):
    return OR.fixed_batches(_t(spark, sf, "documents").select("doc_id"), 64, [F.col("doc_id")])


def shards(spark, sf):
    return OR.balanced_shards(_t(spark, sf, "documents").select("doc_id"), 8, [F.col("doc_id")])


# ---------------------------------------------------------------------------
# text functions on conversations


def answer_parse(spark, sf):
    c = _t(spark, sf, "conversations")
    return c.select("conv_id", "turn", TX.answer_parse(F.col("text")).alias("answer"))


def line_list(spark, sf):
    c = _t(spark, sf, "conversations")
    return (c.select("conv_id", "turn", F.posexplode(TX.line_list(F.col("text")))
                     .alias("line_no", "line"))
            .select("conv_id", "turn", (F.col("line_no") + 1).cast("int").alias("line_no"), "line"))


def strip_tokens(spark, sf):
    c = _t(spark, sf, "conversations")
    return c.select("conv_id", "turn", TX.strip_special_tokens(F.col("text")).alias("text"))


def stop_truncate(spark, sf):
    c = _t(spark, sf, "conversations")
    return c.select("conv_id", "turn", TX.stop_truncate(F.col("text"), [".", "\n"]).alias("text"))


# ---------------------------------------------------------------------------
# questions and prompts from conversations


CONTEXT_TOP_N = 3


def user_turns(c: DataFrame) -> DataFrame:
    """(conv_id, u_turn, question_id, question): every user turn is a question."""
    return c.where(F.col("role") == "user").select(
        "conv_id", F.col("turn").alias("u_turn"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        .alias("question_id"), F.col("text").alias("question"))


def conversation_questions(spark, sf):
    """Question records: every user turn = question, lines of the assistant turn
    after it = options (through a record map and P2), answer ``option 1: <line 1>``,
    context = those of all turns after the answer that best overlap the question (R6
    top 3, P3), explanation = the last assistant turn of the conversation if it is after
    the answer (else NULL). Long conversations are cut into blocks of turns."""
    c = _t(spark, sf, "conversations")
    reply = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("u_turn"), F.col("turn").alias("a_turn"),
        F.col("text").alias("a_text"))
    # conversations of several blocks, at most turns / TURN_BLOCK
    blocks = (c.groupBy("conv_id").agg(F.ceil(F.count(F.lit(1)) / H.TURN_BLOCK).cast("int").alias("n"))
              .where("n > 1"))
    n = F.coalesce("n", F.lit(1))
    u = (user_turns(c).join(reply, ["conv_id", "u_turn"], "left")
         .join(F.broadcast(blocks), "conv_id", "left")
         .withColumn("_part", F.pmod(F.xxhash64("u_turn"), n)).drop("n"))
    later = H.best_later(u.where(F.col("a_turn").isNotNull())
                         .select("conv_id", "question_id", "question", "a_turn"),
                         c.select("conv_id", "turn", "text"), blocks, CONTEXT_TOP_N)
    last = (c.where(F.col("role") == "assistant").groupBy("conv_id")
            .agg(F.max_by("text", "turn").alias("last_text"), F.max("turn").alias("last_turn"))
            .join(F.broadcast(blocks), "conv_id", "left")
            .select("conv_id", "last_text", "last_turn",
                    F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("_part")))
    u = u.join(last, ["conv_id", "_part"], "left").withColumn(
        "explanation", F.when(F.col("last_turn") > F.col("a_turn"), F.col("last_text")))
    lines = F.coalesce(TX.line_list(F.col("a_text")), F.array().cast("array<string>"))
    opt = F.transform(lines, lambda x, i: F.struct(F.concat(F.lit("option "), (i + 1).cast("string"))
                                                   .alias("key"), x.alias("value")))
    rec = F.map_from_entries(F.concat(F.array(F.struct(F.lit("question").alias("key"),
                                                       F.col("question").alias("value"))), opt))
    key = F.concat(F.lit("question "), F.col("question_id"))
    q = u.select(
        TX.question_number(key).alias("question_id"), "conv_id", "question",
        TX.option_entries(rec).alias("options"),
        F.when(F.size(lines) > 0, F.concat(F.lit("option 1: "), F.element_at(lines, 1)))
        .alias("answer"), "explanation")
    ctx = H.rerank_topn(later.withColumnRenamed("turn", "rank"), CONTEXT_TOP_N,
                        F.col("score")).select("question_id", "rank", "content")
    return q, ctx


def mcq_prompt_train(spark, sf):
    q, ctx = conversation_questions(spark, sf)
    return RT.training_prompts(q, ctx, ("mcq",)).select("question_id", "prompt", "answer",
                                                         "explanation")


def mcq_prompt_infer(spark, sf):
    q, ctx = conversation_questions(spark, sf)
    return RT.inference_prompts(q, ctx, "mcq")


def qa_prompt(spark, sf):
    q, ctx = conversation_questions(spark, sf)
    return RT.training_prompts(q, ctx, ("qa",)).select("question_id", "prompt", "answer")


CONTEXT_LENGTH = 128
TURN_CONTEXT_LENGTH = 400


def _tokens(spark, sf):
    p = mcq_prompt_train(spark, sf).select("question_id", "prompt")
    return TK.tokenize_truncate(p, CONTEXT_LENGTH)


def token_truncate(spark, sf):
    t = _tokens(spark, sf)
    return t.select("question_id", F.size("input_ids").cast("int").alias("n_tokens"),
                    F.array_join("input_ids", ",").alias("ids"))


def copy_labels(spark, sf):
    t = TK.copy_labels(_tokens(spark, sf))
    return t.select("question_id", F.array_join("labels", ",").alias("labels"))


def completion_mask(spark, sf):
    t = TK.completion_mask(TK.copy_labels(_tokens(spark, sf)), TK.response_marker_ids(spark))
    return t.select("question_id",
                    F.size(F.filter("labels", lambda x: x == TK.IGNORE_INDEX)).cast("int")
                    .alias("n_masked"),
                    F.array_join("labels", ",").alias("labels"))


def turn_mask(spark, sf):
    """D3, D4, D5 with the instruction and the response marker, over a longer context."""
    p = mcq_prompt_train(spark, sf).select("question_id", "prompt")
    t = TK.turn_mask(TK.copy_labels(TK.tokenize_truncate(p, TURN_CONTEXT_LENGTH)),
                     TK.response_marker_ids(spark), TK.instruction_marker_ids(spark))
    return t.select("question_id",
                    F.size(F.filter("labels", lambda x: x == TK.IGNORE_INDEX)).cast("int")
                    .alias("n_masked"),
                    F.array_join("labels", ",").alias("labels"))


# ---------------------------------------------------------------------------
# multi-query


def multi_query(spark, sf):
    """Lines of a user turn are the generated variants, the whole turn is the
    original (last); kNN top-3 over whole documents."""
    u = user_turns(_t(spark, sf, "conversations")).select(
        "question_id", "question", F.col("question").alias("generated"))
    variants = RT.variants_from_text(u)
    docs = _embedded(_docs(spark, sf).select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")))
    cfg = RT.RetrieverConfig(k=3, use_mmr=False, dedup=False, rerank=False, reorder=False)
    h = RT.multi_query(variants, docs, cfg)
    return h.select("question_id", F.col("chunk_id").alias("doc_id"), "rank")


# ---------------------------------------------------------------------------
# graph


def graph_edges(spark, sf):
    d = _docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), "text")
    edges = GR.extract_graph(d, GR.cooccurrence_extractor())
    return (edges.groupBy("src", "dst", "type")
            .agg(F.count(F.lit(1)).alias("n_chunks")))


# ---------------------------------------------------------------------------
# streaming ingest


def incremental_ingest(spark, sf):
    """ST1 + K1: two drops of ``documents`` (English first, then the whole
    table, which repeats the first drop) through the streaming ingest; the
    table must hold every chunk exactly once."""
    from ..session import scratch_path
    from ..sinks.tables import read_current
    from ..streaming.ingest import start_ingest

    docs = _docs(spark, sf)
    base = scratch_path(spark, "ingest")
    src, table, ckpt = f"{base}/drops", f"{base}/table", f"{base}/checkpoint"
    docs.where(F.col("lang") == "en").write.parquet(src)
    start_ingest(spark, src, table, ckpt).awaitTermination()
    docs.write.mode("append").parquet(src)
    start_ingest(spark, src, table, ckpt).awaitTermination()
    return read_current(spark, table).select("doc_id", "chunk_index", "chunk_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "recursive_chunks": recursive_chunks,
    "chunk_stats": chunk_stats,
    "retrieve_sql": retrieve_sql,
    "retrieve_prompt": retrieve_prompt,
    "retrieve_mmr_sql": retrieve_mmr_sql,
    "source_metadata": source_metadata,
    "dedup_corpus": dedup_corpus,
    "duplicate_count": duplicate_count,
    "hash_embed": hash_embed,
    "knn_l2": knn_l2,
    "knn_codes": knn_codes,
    "knn_cosine": knn_cosine,
    "knn_filtered": knn_filtered,
    "mmr": mmr,
    "merge_dedup": merge_dedup,
    "rerank_overlap": rerank_overlap,
    "long_context_order": long_context_order,
    "fallback_hits": fallback_hits,
    "multi_query": multi_query,
    "mcq_prompt_train": mcq_prompt_train,
    "mcq_prompt_infer": mcq_prompt_infer,
    "qa_prompt": qa_prompt,
    "token_truncate": token_truncate,
    "copy_labels": copy_labels,
    "completion_mask": completion_mask,
    "turn_mask": turn_mask,
    "exact_split": exact_split,
    "split_sizes": split_sizes,
    "sample_n": sample_n,
    "reverse_order": reverse_order,
    "answer_parse": answer_parse,
    "accuracy": accuracy,
    "line_list": line_list,
    "strip_tokens": strip_tokens,
    "stop_truncate": stop_truncate,
    "batches": batches,
    "shards": shards,
    "graph_edges": graph_edges,
    "incremental_ingest": incremental_ingest,
    "knn_ivf": knn_ivf,
    "ivf_recall": ivf_recall,
}
