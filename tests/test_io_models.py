import os

import pytest
import zipfile

from pyspark.sql import functions as F

from ragloom.functions import models as MD
from ragloom.plans import answer as AN
from ragloom.plans import retrieve as RT
from ragloom.sinks import tables as SK
from ragloom.sources.files import load_documents

DOCX_XML = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">'
            '<w:body>{}</w:body></w:document>')


def write_docx(path, paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", DOCX_XML.format(body))


def make_docs(folder):
    os.makedirs(folder, exist_ok=True)
    write_docx(f"{folder}/rel_17.docx", ["Release seventeen text.", "Second paragraph here."])
    write_docx(f"{folder}/rel_x.docx", ["Bad number file."])
    write_docx(f"{folder}/notes.docx", ["Plain notes."])
    with open(f"{folder}/ignored.txt", "w") as f:
        f.write("not a docx")


def test_load_docs_and_metadata(spark, tmp_dir):
    folder = f"{tmp_dir}/docs"
    make_docs(folder)
    docs = {r.source: r for r in load_documents(spark, folder).collect()}
    assert set(docs) == {"rel_17.docx", "rel_x.docx", "notes.docx"}
    assert docs["rel_17.docx"].text == "Release seventeen text.\n\nSecond paragraph here."
    table = f"{tmp_dir}/vectors"
    n1 = AN.load_docs(spark, folder, table, 20, 5)
    n2 = AN.load_docs(spark, folder, table, 20, 5)          # K1: twice == once
    t = SK.read_current(spark, table)
    assert n1 == t.count() and n2 == 0
    one = t.first().chunk_id                                # K1 and K2 share the table
    SK.vector_delete(spark, table, spark.createDataFrame([(one,)], "chunk_id string"))
    assert SK.read_current(spark, table).count() == n1 - 1
    meta = {r.source: (r.year, r.tag) for r in t.select("source", "year", "tag").distinct().collect()}
    assert meta["rel_17.docx"] == (17, "3GPP Release 17")
    assert meta["rel_x.docx"] == (None, None) and meta["notes.docx"] == (None, None)


def test_versioned_delete(spark, tmp_dir):
    base = f"{tmp_dir}/tbl"
    df = spark.createDataFrame([(f"c{i}", i) for i in range(10)], "chunk_id string, v int")
    SK.write_version(df, base)
    ids = spark.createDataFrame([("c1",), ("c5",)], "chunk_id string")
    assert SK.vector_delete(spark, base, ids) == 2
    assert SK.versions(spark, base) == [1, 2]
    assert SK.read_current(spark, base).count() == 8
    os.makedirs(f"{base}/v=3")                              # a write that never finished
    df = df.withColumn("v", F.col("v").cast("string"))
    assert SK.write_version(df, base) == 4
    assert SK.vector_append(df.union(df), base) == 0
    assert SK.vector_append(df.withColumn("chunk_id", F.concat(F.lit("n"), "chunk_id")), base) == 10
    assert SK.read_current(spark, base).count() == 20
    assert SK.dedup_collection(spark, base, content="v") == 5
    assert sorted(r.chunk_id for r in SK.read_current(spark, base).collect()) == [f"c{i}" for i in range(10)]


def test_answers_sink_and_routing(spark, tmp_dir):
    ans = spark.createDataFrame([("1", "2"), ("2", "3")], "Question_ID string, Answer_ID string")
    SK.write_answers(ans.coalesce(1), f"{tmp_dir}/out", task="Phi-2")
    files = [f for f in os.listdir(f"{tmp_dir}/out") if f.endswith(".csv")]
    assert len(files) == 1
    with open(f"{tmp_dir}/out/{files[0]}") as f:
        assert f.read().splitlines() == ["Question_ID,Answer_ID,Task", "1,2,Phi-2", "2,3,Phi-2"]
    r = SK.route_splits(2, ans, ans)
    assert sorted(x.split for x in r.select("split").distinct().collect()) == ["test", "train"]
    assert SK.route_splits(1, ans, ans).count() == 2
    with pytest.raises(ValueError):
        SK.route_splits(2, ans)


def echo_factory():
    # a closure, so Spark ships it by value to the workers
    def make():
        def gen(prompts, max_new_tokens):
            return [f" option {len(p) % 5 + 1}: text</s>" for p in prompts]
        return gen
    return make


def test_batch_generate_and_parse(spark):
    prompts = spark.createDataFrame([(str(i), "p" * i) for i in range(1, 8)],
                                    "question_id string, prompt string")
    out = {r.Question_ID: r.Answer_ID for r in
           AN.answer_questions(prompts, "echo", "T", make=echo_factory()).collect()}
    assert out == {str(i): str(i % 5 + 1) for i in range(1, 8)}


def test_compress_and_answer_as_document(spark):
    hits = spark.createDataFrame([("q1", 1, "a\nb"), ("q1", 2, "c")],
                                 "question_id string, rank int, content string")
    qs = spark.createDataFrame([("q1", "what?")], "question_id string, question string")
    c = AN.compress_documents(hits, qs, "echo", make=echo_factory()).first()
    assert c.rank == 1 and "</s>" not in c.content
    d = AN.answer_as_document(hits, qs, "echo", make=echo_factory()).first()
    assert d.content.startswith(" option")


def test_registered_scorer_in_rerank(spark):
    from ragloom.functions.embed import hash_embedding

    q = spark.createDataFrame([(1, "alpha beta")], "question_id int, question string")
    ch = spark.createDataFrame([(f"c{i}", "alpha " + "x" * (i + 1)) for i in range(6)],
                               "chunk_id string, content string")
    ch = ch.withColumn("embedding", hash_embedding(F.col("content")))
    cfg = RT.RetrieverConfig(k=6, top_n=2, use_mmr=False, reorder=False,
                             scorer=MD.scorer_fn("len", make=lambda: (
                                 lambda qs, ts: [float(len(t)) for t in ts])))
    hits = RT.retrieve(q, ch, cfg)
    assert [r.chunk_id for r in hits.orderBy("rank").collect()] == ["c5", "c4"]


def test_jobs_end_to_end(spark, tmp_dir):
    import json

    from ragloom.functions.embed import hash_embedding
    from ragloom.plans import jobs as J

    recs = {f"question {i}": {"question": f"alpha beta gamma {i}", "option 1": "yes",
                              "option 2": "no", "answer": "option 1: yes",
                              "explanation": f"because {i}"} for i in range(1, 21)}
    with open(f"{tmp_dir}/train.json", "w") as f:
        json.dump(recs, f)
    with open(f"{tmp_dir}/test.json", "w") as f:
        json.dump({k: {"question": v["question"], "option 1": "a"} for k, v in list(recs.items())[:5]}, f)
    ch = spark.createDataFrame([(f"c{i}", f"alpha text {i}\nbeta {i}") for i in range(40)],
                               "chunk_id string, content string")
    ch = ch.withColumn("embedding", hash_embedding(F.col("content")))
    cfg = RT.RetrieverConfig(k=4, fetch_k=8, top_n=2)
    qs = __import__("ragloom.sources.tables", fromlist=["x"]).load_questions(spark, f"{tmp_dir}/train.json")
    ds = J.build_finetune_set(qs, ch, cfg, context_length=64, out=f"{tmp_dir}/ds")
    rows = ds.collect()
    assert len(rows) == 20 and sum(r.split == "test" for r in rows) == 2
    assert all(len(r.input_ids) <= 64 and len(r.labels) == len(r.input_ids) for r in rows)
    assert {r.split for r in spark.read.parquet(f"{tmp_dir}/ds").select("split").collect()} == \
        {"train", "test"}
    pr = J.build_inference_prompts(spark, 2, ch, cfg, f"{tmp_dir}/train.json",
                                   f"{tmp_dir}/test.json")
    assert pr.groupBy("split").count().orderBy("split").collect()[0]["count"] == 5
    ans = J.test_model(pr.where(F.col("split") == "train"), "echo", "T", f"{tmp_dir}/ans",
                       make=echo_factory())
    assert ans.count() == 20
    truth = f"{tmp_dir}/truth.csv"
    with open(truth, "w") as f:
        f.write("Question_ID,Answer_ID\n" + "".join(f"{i},1\n" for i in range(1, 21)))
    m = J.metrics(spark, f"{tmp_dir}/ans", truth).first()
    assert m.n_pred == 20 and m.n_matched == 20


def test_docx_stream_ingest(spark, tmp_dir):
    from ragloom.streaming.ingest import start_docx_ingest

    folder = f"{tmp_dir}/stream_docs"
    make_docs(folder)
    table, ckpt = f"{tmp_dir}/vt", f"{tmp_dir}/ck"
    start_docx_ingest(spark, folder, table, ckpt, 20, 5).awaitTermination()
    n1 = spark.read.parquet(table).count()
    write_docx(f"{folder}/rel_18.docx", ["Another release text."])
    start_docx_ingest(spark, folder, table, ckpt, 20, 5).awaitTermination()
    t = spark.read.parquet(table)
    assert t.count() > n1
    assert t.where(F.col("year") == 18).count() > 0
    assert t.select("chunk_id").distinct().count() == t.count()


def test_registered_embedder(spark):
    import numpy as np

    from ragloom.functions import embed as EM

    EM.register_embedder("const", lambda texts, prefix: np.ones((len(texts), 3)) *
                         (1.0 if prefix == "search_query" else 2.0), 3)
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    r = df.select(EM.embed(F.col("t"), "const", "query").alias("e")).collect()
    assert [list(x.e) for x in r] == [[1.0, 1.0, 1.0]] * 2
    import pytest
    with pytest.raises(ValueError):
        EM.embed(F.col("t"), "missing")


def test_quarantine_and_release_report(spark, tmp_dir):
    from ragloom.operators.split import chunk_documents, release_name_report

    folder = f"{tmp_dir}/qdocs"
    make_docs(folder)
    with open(f"{folder}/broken.docx", "wb") as f:
        f.write(b"not a zip file")
    docs = load_documents(spark, folder, quarantine=f"{tmp_dir}/quarantine")
    assert sorted(r.source for r in docs.collect()) == ["notes.docx", "rel_17.docx", "rel_x.docx"]
    q = spark.read.parquet(f"{tmp_dir}/quarantine").collect()
    assert [r.source for r in q] == ["broken.docx"] and q[0].error
    rep = release_name_report(chunk_documents(docs)).first()
    assert (rep.n_release_names, rep.n_unparsable) == (2, 1)


def test_vector_scan_prompt_and_dataset_round_trip(spark, tmp_dir):
    from ragloom.sources import tables as SRC

    vt = f"{tmp_dir}/vec"
    spark.createDataFrame([(f"c{i:02d}", [float(i)]) for i in range(20)],
                          "chunk_id string, embedding array<float>").write.parquet(vt)
    page = SRC.read_vectors(spark, vt, ("chunk_id", "embedding"), limit=5, offset=10)
    assert [r.chunk_id for r in page.collect()] == [f"c{i}" for i in range(10, 15)]
    assert SRC.read_vectors(spark, vt, ("chunk_id",)).columns == ["chunk_id"]

    prompts = spark.createDataFrame([("1", "p1"), ("2", "p2")], "question_id string, prompt string")
    SK.write_prompts(prompts, f"{tmp_dir}/prompts")
    assert sorted(r.prompt for r in SRC.read_prompts(spark, f"{tmp_dir}/prompts").collect()) == \
        ["p1", "p2"]

    ds = prompts.withColumn("split", F.when(F.col("question_id") == "1", "test").otherwise("train"))
    SK.write_dataset(ds, f"{tmp_dir}/ds")
    test = SRC.read_dataset(spark, f"{tmp_dir}/ds", "test")
    assert [r.question_id for r in test.collect()] == ["1"]
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "split" in plan


def test_generate_variants_then_multi_query(spark):
    from ragloom.functions.embed import hash_embedding

    def make():
        def gen(prompts, n):
            return ["  alpha one \n\n beta two\n" for _ in prompts]
        return gen

    q = spark.createDataFrame([(1, "gamma three")], "question_id int, question string")
    v = RT.generate_variants(q, "lines", make=make)
    assert [(r.variant_no, r.question) for r in v.orderBy("variant_no").collect()] == \
        [(1, "alpha one"), (2, "beta two"), (3, "gamma three")]
    ch = spark.createDataFrame([("c1", "alpha one"), ("c2", "beta two"), ("c3", "gamma three"),
                                ("c4", "delta")], "chunk_id string, content string")
    ch = ch.withColumn("embedding", hash_embedding(F.col("content")))
    cfg = RT.RetrieverConfig(k=1, use_mmr=False, dedup=False, rerank=False, reorder=False)
    hits = RT.multi_query(v, ch, cfg)
    assert [r.chunk_id for r in hits.orderBy("rank").collect()] == ["c1", "c2", "c3"]


def test_retrieve_with_fallback_and_transformers(spark):
    from ragloom.functions.embed import hash_embedding

    ch = spark.createDataFrame([(f"c{i}", f"topic{i % 3} words {i}", i % 3) for i in range(30)],
                               "chunk_id string, content string, grp int")
    ch = ch.withColumn("embedding", hash_embedding(F.col("content")))
    q = spark.createDataFrame([(1, "topic0 words"), (2, "topic1 words")],
                              "question_id int, question string")
    cfg = RT.RetrieverConfig(k=300, fetch_k=10, top_n=5, rerank=False)
    # the primary's filter leaves nothing to search and the backup keeps it
    assert RT.retrieve_with_fallback(q, ch, cfg, chunk_filter=F.col("grp") > 5).count() == 0
    # a wider backup searches the whole table with max(1, 300 // 100) = 3 results
    out = RT.retrieve_with_fallback(q, ch, cfg, chunk_filter=F.col("grp") > 5,
                                    backup_filter=F.lit(True))
    counts = {r.question_id: r["count"] for r in out.groupBy("question_id").count().collect()}
    assert counts == {1: 3, 2: 3}
    # a primary that answers everything leaves the backup unused
    full = RT.retrieve_with_fallback(q, ch, cfg)
    assert full.groupBy("question_id").count().agg(F.min("count")).first()[0] > 3

    def keep_best(hits, qs):
        return hits.where(F.col("rank") == 1)

    assert RT.apply_transformers(out, q, [keep_best]).count() == 2


def test_text_files_and_graph_sink(spark, tmp_dir):
    from ragloom.operators import graph as GR
    from ragloom.sources.files import load_text_files

    folder = f"{tmp_dir}/txt"
    os.makedirs(folder)
    with open(f"{folder}/a.txt", "w") as f:
        f.write("Alpha met Beta. Gamma saw Delta and Alpha.\nBeta left.")
    with open(f"{folder}/skip.md", "w") as f:
        f.write("Zeta Eta.")
    docs = load_text_files(spark, folder)
    assert [r.source for r in docs.collect()] == ["a.txt"]
    edges = GR.extract_graph(docs.withColumnRenamed("doc_id", "chunk_id"),
                             GR.cooccurrence_extractor())
    got = sorted((r.src, r.dst) for r in edges.collect())
    assert got == [("alpha", "beta"), ("delta", "alpha"), ("gamma", "delta")]
    nodes = GR.graph_nodes(edges)
    assert nodes.count() == 4
    base = f"{tmp_dir}/graph"
    assert SK.graph_append(edges, nodes, base) == (4, 3)
    assert SK.graph_append(edges, nodes, base) == (0, 0)      # re-delivery adds nothing


def test_two_models_of_one_name_do_not_mix(spark):
    from ragloom.functions.models import generate

    df = spark.createDataFrame([("p",)], "prompt string").coalesce(1)
    for word in ("one", "two"):
        def make(word=word):
            return lambda prompts, n: [word for _ in prompts]
        assert df.select(generate("prompt", "g", make=make).alias("g")).first().g == word


def test_malformed_questions_fail(spark, tmp_dir):
    from ragloom.sources.tables import load_questions

    with open(f"{tmp_dir}/q.json", "w") as f:
        f.write('{"question 1": {"question": "wh')
    with pytest.raises(Exception):
        load_questions(spark, f"{tmp_dir}/q.json").collect()


def test_hidden_files_and_nested_paragraphs(spark, tmp_dir):
    import zipfile

    from ragloom.sources.files import discover_files, docx_to_text

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    path = f"{tmp_dir}/_a.docx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>outer</w:t></w:r><w:txbx>"
                   "<w:p><w:r><w:t>inner</w:t></w:r></w:p></w:txbx></w:p></w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {w}><w:p><w:r><w:t>head</w:t></w:r></w:p></w:hdr>")
        z.writestr("word/footer1.xml", f"<w:ftr {w}><w:p><w:r><w:t>foot</w:t></w:r></w:p></w:ftr>")
    with open(path, "rb") as f:
        assert docx_to_text(f.read()) == "head\n\nouter\n\ninner\n\nfoot"
    with pytest.raises(ValueError):
        discover_files(spark, tmp_dir)


def test_duplicate_ids_raise_when_scored(spark):
    one = spark.createDataFrame([("1", "a"), ("2", "b")], "Question_ID string, Answer_ID string")
    with pytest.raises(ValueError):
        AN.score_answers(one.union(one), one)
    assert AN.score_answers(one, one).first().accuracy == 1.0


def test_prefix_reaches_the_embedder(spark):
    import numpy as np

    from ragloom.functions.embed import embed, embedding_dim, register_embedder

    register_embedder("prefix_length", lambda texts, prefix: np.full((len(texts), 2), len(prefix)), 2)
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    got = df.select(embed("t", "prefix_length", "query").alias("v"))
    assert got.first().v == [len("search_query")] * 2
    assert tuple(embedding_dim(got, "v").first()) == (2, 2)
