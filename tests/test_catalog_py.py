"""Catalog queries without a SQL twin, checked against brute force on sf0.001."""
from collections import defaultdict

import duckdb
import numpy as np
from conftest import SF001
from oracles import mmr_oracle, split_oracle

from ragloom.plans import catalog as C


def _docs():
    return duckdb.sql(f"SELECT doc_id, source, text FROM read_parquet('{SF001}/documents.parquet')"
                      ).fetchall()


def test_chunk_stats_brute_force(spark):
    want = defaultdict(lambda: [0, set(), 0, 0])
    for doc_id, source, text in _docs():
        for c in split_oracle(text, 512, 150):
            w = want[source]
            w[0] += 1
            w[1].add(doc_id)
            w[2] = max(w[2], len(c))
            w[3] += len(c)
    got = {r.source: [r.n_chunks, r.n_docs, r.max_chars, r.total_chars]
           for r in C.chunk_stats(spark, SF001).collect()}
    assert got == {s: [w[0], len(w[1]), w[2], w[3]] for s, w in want.items()}


def test_incremental_ingest_exactly_once(spark):
    got = sorted((r.doc_id, r.chunk_index) for r in C.incremental_ingest(spark, SF001).collect())
    want = sorted((doc_id, i) for doc_id, _, text in _docs()
                  for i, _ in enumerate(split_oracle(text, 512, 150)))
    assert got == want


def test_mmr_query_brute_force(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM read_parquet('{SF001}/embeddings.parquet')"
                      ).fetchall()
    ids = np.array([r[0] for r in rows])
    V = np.array([r[1] for r in rows], dtype=np.float64)
    got = defaultdict(list)
    for r in C.mmr(spark, SF001).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for qi in range(0, len(ids), 7):
        d = ((V - V[qi]) ** 2).sum(1)
        order = sorted(range(len(ids)), key=lambda j: (round(d[j], 9), ids[j]))[:20]
        picks = mmr_oracle(list(V[qi]), [list(V[j]) for j in order], 5, 0.5)
        assert got[ids[qi]] == [ids[order[p]] for p in picks]


def test_stream_ingest_state_dedup(spark, tmp_path):
    from ragloom.streaming.ingest import start_ingest

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    src, table, ck = f"{tmp_path}/src", f"{tmp_path}/t", f"{tmp_path}/ck"
    docs.where("lang = 'en'").write.parquet(src)
    start_ingest(spark, src, table, ck, dedup="state").awaitTermination()
    docs.write.mode("append").parquet(src)
    start_ingest(spark, src, table, ck, dedup="state").awaitTermination()
    got = sorted((r.doc_id, r.chunk_index) for r in spark.read.parquet(table).collect())
    want = sorted((doc_id, i) for doc_id, _, text in _docs()
                  for i, _ in enumerate(split_oracle(text, 512, 150)))
    assert got == want
