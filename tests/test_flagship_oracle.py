"""The flagship chain against a brute-force Python re-implementation on sf0.001."""
import duckdb
import numpy as np
from conftest import SF001
from oracles import (hash_embed_oracle, long_context_order, mcq_prompt_oracle, mmr_oracle,
                     round_robin, split_oracle, words_oracle)

from ragloom.plans import catalog as C

STRIP = " \t\n\r\f\x0b"


def test_retrieve_prompt_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{SF001}/documents.parquet')").fetchall()
    bench = duckdb.sql(f"SELECT item_id, text FROM read_parquet('{SF001}/benchmark.parquet')").fetchall()
    import hashlib
    chunks = []
    for doc_id, text in docs:
        for i, c in enumerate(split_oracle(text, 512, 150)):
            cid = hashlib.sha256(f"{doc_id}|{i}|{c}".encode()).hexdigest()
            chunks.append((cid, c, hash_embed_oracle(c)))
    ids = [c[0] for c in chunks]
    V = np.stack([c[2] for c in chunks])
    order_id = np.argsort(np.array(ids))            # rank of each id in string order
    id_rank = np.empty(len(ids), dtype=np.int64)
    id_rank[order_id] = np.arange(len(ids))
    want = {}
    for qid, qtext in bench:
        q = hash_embed_oracle(qtext)
        d = ((V - q) ** 2).sum(axis=1)
        cand = sorted(range(len(ids)), key=lambda j: (round(d[j], 9), id_rank[j]))[:20]
        sim = cand[:10]
        picks = mmr_oracle(list(q), [list(V[j]) for j in cand], 10, 0.5)
        mmr = [cand[p] for p in picks]
        merged = round_robin(sim, mmr)
        seen, dedup = set(), []
        for j in merged:
            key = chunks[j][1].strip(STRIP)
            if key not in seen:
                seen.add(key)
                dedup.append(j)
        qw = set(words_oracle(qtext))
        score = [len(qw & set(words_oracle(chunks[j][1]))) / max(len(qw), 1) for j in dedup]
        best = [dedup[i] for i in sorted(range(len(dedup)), key=lambda i: (-score[i], i))][:5]
        ordered = long_context_order(best)
        ctx = " ".join(chunks[j][1] for j in ordered).replace("\n", ". ")
        want[qid] = (mcq_prompt_oracle(qtext, ctx, []), len(best))
    got = {r.question_id: (r.prompt, r.n_hits) for r in C.retrieve_prompt(spark, SF001).collect()}
    assert got == want
