"""Checks of sources, sinks, prompts and model steps: written below
``spark.checkpoint.dir``, read back, with SQL twins. Models are stand-ins that SQL
can repeat: the length of a prompt."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import embed as EM
from ..functions import prompts as PR
from ..operators import dedup as DD
from ..operators import graph as GR
from ..operators import order as OR
from ..operators.split import window_chunks
from ..session import scratch_path
from ..sinks import tables as SK
from ..sinks.chunks import read_page, write_pages
from ..sources import tables as SRC
from . import answer as AN
from . import catalog as C
from .catalog_sql import GRAPH_EDGES, MCQ_INFER, RERANK_OVERLAP, SQL, T1, strip, words

QID = "question_id"
#: The page that ``vector_page`` returns.
PAGE_ROWS, PAGE_OFFSET = 100, 250


def _length_model():
    def generate(prompts, max_new_tokens):
        return [str(len(p)) for p in prompts]
    return generate


def _option_model():
    def generate(prompts, max_new_tokens):
        return [f" option {len(p) % 5 + 1}: text" for p in prompts]
    return generate


def collection_dedup(spark, sf):
    """K1 in two drops (the second repeats the first), then R5 + K2 as one job."""
    ch = window_chunks(C._t(spark, sf, "documents"), 512, 362).withColumn("chunk_id", F.concat_ws(
        "-", F.lpad(F.col("doc_id").cast("string"), 12, "0"),
        F.lpad(F.col("chunk_index").cast("string"), 6, "0")))
    base = scratch_path(spark, "collection")
    SK.vector_append(ch.where(F.col("doc_id") % 2 == 0), base)
    SK.vector_append(ch, base)
    SK.dedup_collection(spark, base)
    return SK.read_current(spark, base).select("doc_id", "chunk_index", "content")


def ingest_drops(spark, sf):
    """K1 in two drops, embedded after the ids are compared; read back."""
    ch = window_chunks(C._t(spark, sf, "documents"), 512, 362).withColumn("chunk_id", F.concat_ws(
        "-", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))
    base = scratch_path(spark, "drops")
    for drop in (ch.where(F.col("doc_id") % 2 == 0), ch):
        SK.vector_append(drop, base, embed=lambda new: new.withColumn(
            "embedding", EM.hash_embedding(F.col("content"))))
    return SK.read_current(spark, base).select("chunk_id", F.size("embedding").alias("dim"))


def _prompts(spark, sf):
    return C.user_turns(C._t(spark, sf, "conversations")).select(QID, F.col("question").alias("prompt"))


def append_reads(spark, sf):
    """K1 by the id index: a first drop, a drop of new ids, one that repeats a few
    chunks, and all at once. Per drop: rows added, and whether less than half of the
    stored ids was read."""
    ch = window_chunks(C._t(spark, sf, "documents"), 512, 362).withColumn("chunk_id", F.concat_ws(
        "-", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))
    base, rows = scratch_path(spark, "append-reads"), []
    drops = (ch.where("doc_id % 4 = 0"), ch.where("doc_id % 4 = 1"),
             ch.where("doc_id < 8 and doc_id % 4 = 0 and chunk_index = 0"), ch)
    for i, drop in enumerate(drops):
        reads: dict = {}
        added = SK.vector_append(drop, base, reads=reads)
        rows.append((i + 1, added, 2 * reads.get("ids_read", 0) < max(1, reads.get("ids", 0))))
    return spark.createDataFrame(rows, "drop int, added long, few_reads boolean")


def answers_roundtrip(spark, sf):
    """E4, P8, P9, K5, S5."""
    path = scratch_path(spark, "answers")
    SK.write_answers(AN.answer_questions(_prompts(spark, sf), "options", "demo", make=_option_model),
                     path, "demo")
    return SRC.read_answers(spark, path)


def prompts_roundtrip(spark, sf):
    """D2, K3, S6, P12."""
    path = scratch_path(spark, "prompts")
    SK.write_prompts(C.mcq_prompt_infer(spark, sf), path)
    return SRC.read_prompts(spark, path).select("prompt")


def dataset_roundtrip(spark, sf):
    """O4, K4, S7 with a pruned split."""
    path = scratch_path(spark, "dataset")
    d = C._t(spark, sf, "documents").select("doc_id", "n_chars")
    SK.write_dataset(OR.exact_split(d, "doc_id", 0.1, 123), path)
    return SRC.read_dataset(spark, path, "test").select("doc_id", "n_chars")


def split_routing(spark, sf):
    """K6, run mode 2."""
    x = C._t(spark, sf, "labels").select("doc_id", "quality")
    return SK.route_splits(2, x.where("quality = 1"), x.where("quality = 0")).select("doc_id", "split")


def graph_sink(spark, sf):
    """E7, K7 twice: the second append adds nothing."""
    d = C._docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), "text")
    base = scratch_path(spark, "graph")
    extracted = GR.extract_graph(d, GR.cooccurrence_extractor())
    extracted.write.parquet(f"{base}/extracted")            # read for nodes and edges of both appends
    edges = spark.read.schema(extracted.schema).parquet(f"{base}/extracted")
    for _ in range(2):
        SK.graph_append(edges, GR.graph_nodes(edges), base)
    return (SK.read_current(spark, f"{base}/edges").groupBy("src", "dst", "type")
            .agg(F.count(F.lit(1)).alias("n_chunks")))


def vector_page(spark, sf):
    """A page from the middle of the vector table in id order; of the sorted ranges only
    those with the page are read."""
    v = C._vec(spark, sf).select(F.col("vec_id").alias("chunk_id"), "embedding")
    path = scratch_path(spark, "pages")
    write_pages(v, path)
    page = read_page(spark, path, limit=PAGE_ROWS, offset=PAGE_OFFSET)
    return page.select("chunk_id", F.size("embedding").alias("dim"))


def embedding_dim(spark, sf):
    """P11 over the whole vector table."""
    v = C._vec(spark, sf)
    path = scratch_path(spark, "vectors")
    v.select(F.col("vec_id").alias("chunk_id"), "embedding").write.parquet(path)
    return EM.embedding_dim(SRC.read_vectors(spark, path, ("chunk_id", "embedding")))


def sorted_answers(spark, sf):
    """O1 with S5: the answers table in the numeric order of its ids, as numbered rows."""
    path = scratch_path(spark, "answers")
    v = C._vec(spark, sf).select(F.col("vec_id").cast("string").alias("Question_ID"),
                                 F.col("label").cast("string").alias("Answer_ID"))
    SK.write_answers(v, path, "demo")
    order = [F.expr("try_cast(Question_ID AS BIGINT)").asc_nulls_last(), F.col("Question_ID")]
    return OR.row_index(OR.sort_by_id(SRC.read_answers(spark, path)), order, "position").select(
        "position", "Question_ID", "Answer_ID")


def docx_roundtrip(spark, sf):
    """S1, S2, ST1: every document as a Word file, read as a batch and as a stream of two
    drops; a file that is no Word file is a row with an error."""
    from ..sources import docx as DX

    DX.register(spark)
    d = C._t(spark, sf, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"),
                                            "doc_id", "text")
    base = scratch_path(spark, "docx")
    folder, out, ckpt = f"{base}/files", f"{base}/rows", f"{base}/checkpoint"
    DX.write_file(b"no Word file", folder, "broken.docx")
    for drop in (d.where("doc_id % 2 = 0"), d.where("doc_id % 2 <> 0 or doc_id is null")):
        DX.write_docx(drop, folder)
        (spark.readStream.format("docx").load(folder).writeStream.format("parquet")
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start(out).awaitTermination())
    batch = spark.read.format("docx").load(folder)
    both = batch.withColumn("way", F.lit("batch")).unionByName(
        spark.read.schema(batch.schema).parquet(out).withColumn("way", F.lit("stream")))
    number = F.expr(r"try_cast(regexp_extract(path, 'doc-(-?[0-9]+)[.]docx$', 1) AS BIGINT)")
    return both.select("way", number.alias("doc_id"), F.md5("text").alias("text_md5"), "error")


def docx_ingest(spark, sf):
    """S1, S2, T1, E1, K1 as one job: Word files of all documents, split, embedded and
    appended twice (the second load adds nothing)."""
    from ..operators.split import chunk_documents
    from ..sources import docx as DX

    DX.register(spark)
    d = C._t(spark, sf, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"),
                                            "text")
    base = scratch_path(spark, "docx-ingest")
    DX.write_docx(d, f"{base}/files")
    for _ in range(2):
        docs = DX.documents(spark.read.format("docx").load(f"{base}/files"))
        SK.vector_append(chunk_documents(docs, 512, 150), f"{base}/table", embed=lambda new: new.withColumn(
            "embedding", EM.hash_embedding(F.col("content"))))
    number = F.expr(r"try_cast(regexp_extract(source, 'doc-(-?[0-9]+)[.]docx$', 1) AS BIGINT)")
    return SK.read_current(spark, f"{base}/table").select(
        number.alias("doc_id"), "chunk_index", F.length("content").cast("long").alias("n_chars"),
        F.md5("content").alias("content_md5"), F.size("embedding").alias("dim"))


def lexical_retrieve(spark, sf):
    """BM25 top 10 of every benchmark item over all documents."""
    from ..operators import lexical as LX

    docs = C._docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    path = scratch_path(spark, "lexical")
    LX.build_index(docs, path)
    return LX.search(C._benchmark_questions(spark, sf), path, 10).select(
        F.col(QID).alias("item_id"), F.col("chunk_id").alias("doc_id"), "rank",
        F.round("score", 4).alias("score"))


def hybrid_hits(spark, sf):
    """The lexical retriever merged round robin with the vector retriever, then the
    first place of every document (U3)."""
    from ..operators import hits as H
    from ..operators import lexical as LX
    from . import retrieve as RT

    docs = C._stored(C._embedded(C._docs(spark, sf).select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))))
    q = C._benchmark_questions(spark, sf)
    path = scratch_path(spark, "lexical")
    LX.build_index(docs, path)
    near = RT.retrieve(q, docs, RT.RetrieverConfig(k=5, use_mmr=False, dedup=False, rerank=False,
                                                   reorder=False, late=True))
    merged = H.merge_interleave(LX.retriever(path, docs, 5)(q), near)
    first = merged.groupBy(QID, "chunk_id").agg(F.min("rank").alias("rank"))
    return OR.group_rank(first, [QID], ["rank"]).select(
        F.col(QID).alias("item_id"), F.col("chunk_id").alias("doc_id"), "rank")


def later_copies(spark, sf):
    """U4: ids of the rows a dedup run deletes."""
    return DD.duplicate_rows(C._t(spark, sf, "documents"))


def multi_query_prompts(spark, sf):
    """P7."""
    return _prompts(spark, sf).select(QID, PR.multi_query_prompt(F.col("prompt")).alias("prompt"))


def _context(spark, sf):
    q, ctx = C.conversation_questions(spark, sf)
    return q.select(QID, "question"), ctx.withColumn("content", F.coalesce("content", F.lit("")))


def compress(spark, sf):
    """The prompt's length stands for the generated text."""
    q, ctx = _context(spark, sf)
    return AN.compress_documents(ctx, q, "length", make=_length_model).select(QID, "content")


def answer_document(spark, sf):
    """P3, P5, E4, E6."""
    q, ctx = _context(spark, sf)
    return AN.answer_as_document(ctx, q, "length", make=_length_model).select(QID, "content")


QUERIES = {f.__name__: f for f in (
    collection_dedup, ingest_drops, append_reads, answers_roundtrip, prompts_roundtrip, dataset_roundtrip,
    split_routing, graph_sink, vector_page, embedding_dim, sorted_answers, docx_roundtrip, docx_ingest,
    lexical_retrieve, hybrid_hits, later_copies, multi_query_prompts, compress,
    answer_document)}

_WINDOWS = """w AS (SELECT doc_id, unnest(range(0, (length(text) - 1) // 362 + 1))::INTEGER AS chunk_index,
             text FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, chunk_index, substr(text, 1 + chunk_index * 362, 512) AS content FROM w)"""
_Q = MCQ_INFER[MCQ_INFER.index("WITH"):MCQ_INFER.index("SELECT q2.question_id,")]
_PLAIN = len(PR.COMPRESS_SYSTEM.replace("{max_word_count}", "512")) + len(
    "<|system|>\n</s>\n<|user|>\nContext:\n\nQuestion:\n</s>\n<|assistant|>\n")
_QA = len(PR.INSTRUCTIONS_TAG + " \n" + PR.QA_INSTRUCTION + "\n\nContext:\n\n\nQuestion:\n\n\n" + PR.ANSWER_TAG)
_BM25 = f"""dw AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
sz AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM dw),
tf AS (SELECT doc_id, len, term, count(*) AS tf
       FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM dw) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT item_id, unnest(list_distinct({words("coalesce(text, '')")})) AS term FROM benchmark),
sc AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE
                                         / (tf + 1.2::DOUBLE * (0.25 + 0.75 * len / mean))), 6) AS score
       FROM qt JOIN df USING (term) JOIN tf USING (term) CROSS JOIN sz GROUP BY ALL),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
         FROM sc)"""
_HEAD, _TAIL = PR.MULTI_QUERY_INSTRUCTION + "\n    ", "\n    "

IO_SQL = {
    "collection_dedup": f"""
WITH {_WINDOWS}
SELECT doc_id, chunk_index, content FROM c
QUALIFY row_number() OVER (PARTITION BY {strip('content')} ORDER BY doc_id, chunk_index) = 1
""",
    "ingest_drops": f"""
WITH {_WINDOWS}
SELECT doc_id::VARCHAR || '-' || chunk_index::VARCHAR AS chunk_id, 256::INTEGER AS dim FROM c
""",
    "append_reads": f"""
WITH {_WINDOWS}
SELECT 1::INTEGER AS drop, count(*) FILTER (WHERE doc_id % 4 = 0) AS added, TRUE AS few_reads FROM c
UNION ALL SELECT 2, count(*) FILTER (WHERE doc_id % 4 = 1), TRUE FROM c
UNION ALL SELECT 3, 0, TRUE
UNION ALL SELECT 4, count(*) FILTER (WHERE doc_id % 4 NOT IN (0, 1)), FALSE FROM c
""",
    "answers_roundtrip": """
SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS "Question_ID",
       (length(text) % 5 + 1)::VARCHAR AS "Answer_ID", 'demo' AS "Task"
FROM conversations WHERE role = 'user'
""",
    "prompts_roundtrip": f"SELECT prompt FROM ({MCQ_INFER})",
    "dataset_roundtrip": f"""
SELECT d.doc_id, d.n_chars FROM documents d JOIN ({SQL['exact_split']}) s USING (doc_id)
WHERE s.split = 'test'
""",
    "split_routing": """
SELECT doc_id, CASE quality WHEN 1 THEN 'train' ELSE 'test' END AS split FROM labels
WHERE quality IN (0, 1)
""",
    "graph_sink": GRAPH_EDGES,
    "vector_page": f"""
SELECT vec_id AS chunk_id, len(embedding)::INTEGER AS dim FROM embeddings
ORDER BY vec_id LIMIT {PAGE_ROWS} OFFSET {PAGE_OFFSET}
""",
    "sorted_answers": """
SELECT row_number() OVER (ORDER BY vec_id, vec_id::VARCHAR) - 1 AS position,
       vec_id::VARCHAR AS "Question_ID", label::VARCHAR AS "Answer_ID" FROM embeddings
""",
    "embedding_dim": """
SELECT count(*) AS n_vectors, max(len(embedding))::INTEGER AS dim FROM embeddings
""",
    "docx_roundtrip": """
SELECT way, doc_id, md5(coalesce(text, '')) AS text_md5, NULL::VARCHAR AS error
FROM documents CROSS JOIN (VALUES ('batch'), ('stream')) w(way)
UNION ALL SELECT way, NULL, NULL, 'BadZipFile: File is not a zip file'
FROM (VALUES ('batch'), ('stream')) w(way)
""",
    "docx_ingest": f"""
WITH RECURSIVE {T1}
SELECT doc_id, chunk_index, length(content) AS n_chars, md5(content) AS content_md5,
       256::INTEGER AS dim FROM t1
""",
    "lexical_retrieve": f"""
WITH {_BM25}
SELECT item_id, doc_id, rank, round(score, 4) AS score FROM bm25 WHERE rank <= 10
""",
    "hybrid_hits": f"""
WITH {_BM25},
near AS (SELECT * FROM ({RERANK_OVERLAP[:RERANK_OVERLAP.index('scored AS')].rstrip().rstrip(',')}
         SELECT qid AS item_id, vid AS doc_id, rank FROM top WHERE rank <= 5)),
m AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY rank, src) AS r
      FROM (SELECT item_id, doc_id, rank, 0 AS src FROM bm25 WHERE rank <= 5
            UNION ALL SELECT item_id, doc_id, rank, 1 FROM near)),
f AS (SELECT item_id, doc_id, min(r) AS r FROM m GROUP BY ALL)
SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY r)::INTEGER AS rank FROM f
""",
    "later_copies": f"""
SELECT doc_id FROM documents
QUALIFY row_number() OVER (PARTITION BY {strip('text')} ORDER BY doc_id) > 1
""",
    "multi_query_prompts": f"""
SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS question_id,
       '{_HEAD.replace("'", "''")}' || coalesce(text, '') || '{_TAIL}' AS prompt
FROM conversations WHERE role = 'user'
""",
    "compress": f"""
{_Q}, j AS (SELECT question_id, string_agg(coalesce(text, ''), ' ' ORDER BY pos) AS context
            FROM best GROUP BY question_id)
SELECT j.question_id, ({_PLAIN} + length(j.context) + length(coalesce(q2.question, '')))::VARCHAR AS content
FROM j JOIN q2 USING (question_id)
""",
    "answer_document": f"""
{_Q}
SELECT q2.question_id, ({_QA} + length(coalesce(ctx.context, ''))
                        + length(coalesce(q2.question, '')))::VARCHAR AS content
FROM q2 LEFT JOIN ctx USING (question_id)
""",
}
