"""SQL twins (DuckDB dialect) of the catalog queries, for the oracle check.

They are written independently of the Spark code from the operator
definitions: same tables, same parameters, same column names and types.
Only ``ivf_recall`` (approximate, depends on k-means) has no entry here.
"""

from __future__ import annotations

WS = "chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)"
NL = "chr(10)"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def words(x: str) -> str:
    return (f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), "
            f"lambda t: t <> '')")


def hvec(name: str, src: str, id_expr: str, text: str, dim: int = 256) -> str:
    """CTEs ``{name}_c(id, dim, n)``, ``{name}(id, dim, w)``, ``{name}_n(id, ss)``."""
    return f"""
{name}_t AS (SELECT {id_expr} AS id, unnest({words(text)}) AS tok FROM {src}),
{name}_c AS (SELECT id, ('0x' || substr(md5(tok), 1, 8))::BIGINT % {dim} AS dim, count(*) AS n
             FROM {name}_t GROUP BY ALL),
{name} AS (SELECT id, dim, (n / sqrt(sum(n * n) OVER (PARTITION BY id)))::FLOAT AS w FROM {name}_c),
{name}_n AS (SELECT id, sum(w::DOUBLE * w::DOUBLE) AS ss FROM {name} GROUP BY id)"""


def sparse_l2(qname: str, vname: str, qids: str, vids: str) -> str:
    """CTE ``{qname}_{vname}_d(qid, vid, d)``: squared L2 of every pair."""
    return f"""
{qname}_{vname}_dot AS (SELECT a.id AS qid, b.id AS vid, sum(a.w::DOUBLE * b.w::DOUBLE) AS dot
        FROM {qname} a JOIN {vname} b USING (dim) GROUP BY ALL),
{qname}_{vname}_d AS (SELECT q.id AS qid, v.id AS vid,
        greatest(coalesce(qn.ss, 0) + coalesce(vn.ss, 0) - 2 * coalesce(x.dot, 0), 0) AS d
        FROM {qids} q CROSS JOIN {vids} v
        LEFT JOIN {qname}_n qn ON qn.id = q.id LEFT JOIN {vname}_n vn ON vn.id = v.id
        LEFT JOIN {qname}_{vname}_dot x ON x.qid = q.id AND x.vid = v.id)"""


def dense(metric: str, a: str = "a.embedding", b: str = "b.embedding") -> str:
    if metric == "l2":
        return f"list_sum([ (p[1]::DOUBLE - p[2]::DOUBLE) ^ 2 for p in list_zip({a}, {b}) ])"
    dot = f"list_sum([ p[1]::DOUBLE * p[2]::DOUBLE for p in list_zip({a}, {b}) ])"
    na = f"sqrt(list_sum([ x::DOUBLE * x::DOUBLE for x in {a} ]))"
    nb = f"sqrt(list_sum([ x::DOUBLE * x::DOUBLE for x in {b} ]))"
    return f"greatest(1 - {dot} / ({na} * {nb}), 0)"


def knn_sql(metric: str, k: int, where: str = "TRUE") -> str:
    return f"""
SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {dense(metric)} AS d
FROM embeddings a CROSS JOIN embeddings b WHERE {where}
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(d, 9), b.vec_id) <= {k}"""


def knn_ranked(metric: str, k: int, where: str = "TRUE") -> str:
    return f"""
SELECT query_id, vec_id,
       row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id)::INTEGER AS rank, d
FROM ({knn_sql(metric, k, where)})"""


def cos_sql(a: str, b: str) -> str:
    """dot / (|a| |b|) in double, 0 when a norm is zero."""
    return (f"coalesce(list_sum([ p[1]::DOUBLE * p[2]::DOUBLE for p in list_zip({a}, {b}) ]) / "
            f"nullif(sqrt(list_sum([ x::DOUBLE * x::DOUBLE for x in {a} ])) * "
            f"sqrt(list_sum([ x::DOUBLE * x::DOUBLE for x in {b} ])), 0), 0)")


def overlap(q: str, c: str) -> str:
    qw = f"list_distinct({words(q)})"
    cw = f"list_distinct({words(c)})"
    return f"(len(list_intersect({qw}, {cw}))::DOUBLE / greatest(len({qw}), 1))"


QA_HEAD = ("'### Instructions: ' || chr(10) || 'Based on the provided context, answer the question.'"
           " || chr(10) || chr(10) || 'Context:' || chr(10)")
MCQ_HEAD = ("'### Instructions: ' || chr(10) || 'Based on the provided context, select the correct "
            "answer from the choices given. Provide your answer in the following format: option "
            "Number: Answer.' || chr(10) || chr(10) || 'Context:' || chr(10)")


def qa_text(ctx: str, q: str, expl: str | None = None) -> str:
    s = (f"{QA_HEAD} || coalesce({ctx}, '') || {NL} || {NL} || 'Question:' || {NL} || "
         f"coalesce({q}, '') || {NL} || {NL} || '### Answer:'")
    if expl is not None:
        s += f" || {NL} || coalesce({expl}, '') || {NL}"
    return s


def mcq_text(ctx: str, q: str, opts: str, ans: str | None = None, expl: str | None = None) -> str:
    s = (f"{MCQ_HEAD} || coalesce({ctx}, '') || {NL} || {NL} || 'Question:' || {NL} || "
         f"coalesce({q}, '') || {NL} || 'Choices:' || {NL} || {opts} || {NL} || '### Answer:'")
    if ans is not None:
        s += (f" || {NL} || coalesce({ans}, '') || {NL} || '### Explanation:' || {NL} || "
              f"coalesce({expl}, '') || {NL}")
    return s


def reorder_pos(rank: str = "rank", part: str = "question_id", n: str = "n") -> str:
    """R7 written as the ordering rule (independent of the closed form used in Spark);
    ``n`` is the list length, computed in an inner query."""
    return (f"row_number() OVER (PARTITION BY {part} ORDER BY ({n} - {rank}) % 2, "
            f"CASE WHEN ({n} - {rank}) % 2 = 0 THEN {rank} ELSE -{rank} END)")


# ---------------------------------------------------------------------------

RETRIEVE_SQL = f"""
WITH win0 AS (
  SELECT doc_id, unnest(generate_series(1, length(text), 362)) AS s, text
  FROM documents WHERE length(text) > 0),
win AS (
  SELECT doc_id, ((s - 1) // 362)::INTEGER AS chunk_index, substring(text, s, 512) AS content
  FROM win0),
chunks AS (SELECT sha256(concat_ws('|', doc_id::VARCHAR, chunk_index::VARCHAR, content)) AS chunk_id,
                  content FROM win),
q AS (SELECT item_id AS id, text FROM benchmark),
{hvec('qv', 'benchmark', 'item_id', 'text')[1:]},
{hvec('cv', 'chunks', 'chunk_id', 'content')[1:]},
cids AS (SELECT DISTINCT chunk_id AS id FROM chunks),
{sparse_l2('qv', 'cv', 'q', 'cids')[1:]},
top AS (SELECT qid, vid, d FROM qv_cv_d
        QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), vid) <= 10),
hits AS (SELECT t.qid AS question_id, t.vid AS chunk_id, c.content,
                row_number() OVER (PARTITION BY t.qid ORDER BY round(t.d, 9), t.vid) AS rank
         FROM top t JOIN (SELECT DISTINCT chunk_id, content FROM chunks) c ON c.chunk_id = t.vid),
dedup AS (SELECT * FROM hits
          QUALIFY row_number() OVER (PARTITION BY question_id, {strip('content')} ORDER BY rank) = 1),
dedup2 AS (SELECT question_id, chunk_id, content,
                  row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank FROM dedup),
scored AS (SELECT d.*, {overlap('b.text', 'd.content')} AS score
           FROM dedup2 d JOIN benchmark b ON b.item_id = d.question_id),
best AS (SELECT question_id, content,
                row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) AS rank
         FROM scored
         QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) <= 4),
re AS (SELECT question_id, content, {reorder_pos()} AS pos
       FROM (SELECT *, count(*) OVER (PARTITION BY question_id) AS n FROM best)),
ctx AS (SELECT question_id, replace(string_agg(content, ' ' ORDER BY pos), {NL}, '. ') AS context,
               count(*) AS n_hits FROM re GROUP BY question_id)
SELECT b.item_id AS question_id, {qa_text('ctx.context', 'b.text')} AS prompt,
       coalesce(ctx.n_hits, 0)::BIGINT AS n_hits
FROM benchmark b LEFT JOIN ctx ON ctx.question_id = b.item_id
"""

_WIN = f"""
win0 AS (
  SELECT doc_id, unnest(generate_series(1, length(text), 362)) AS s, text
  FROM documents WHERE length(text) > 0),
win AS (
  SELECT doc_id, ((s - 1) // 362)::INTEGER AS chunk_index, substring(text, s, 512) AS content
  FROM win0),
chunks AS (SELECT sha256(concat_ws('|', doc_id::VARCHAR, chunk_index::VARCHAR, content)) AS chunk_id,
                  content FROM win)"""

# T1 as a recursive query over the pieces of a text: lines (each with its leading
# break), or the words of a line of 512 characters and more. ``cs`` holds the running
# lengths of one run of pieces; a step ends a chunk at the first piece that does not
# fit and drops pieces until at most 150 characters overlap. It covers texts without
# blank lines and without words of 512 characters, as the driver's are.
T1 = """
ln AS (SELECT doc_id, text, k, CASE WHEN k = 1 THEN parts[1] ELSE chr(10) || parts[k] END AS p
       FROM (SELECT doc_id, text, parts, unnest(range(1, len(parts) + 1)) AS k
             FROM (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents
                   WHERE length(text) > 0))),
ln2 AS (SELECT doc_id, k, p, length(p) AS n,
               (sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k) - length(p))::BIGINT AS at0,
               length(p) >= 512 OR NOT contains(text, chr(10)) AS wide FROM ln),
ln3 AS (SELECT *, count_if(wide) OVER (PARTITION BY doc_id ORDER BY k) - wide::INT AS before
        FROM ln2 WHERE p <> ''),
piece AS (SELECT doc_id, 2 * before AS run, k AS ord, n,
                 min(at0) OVER (PARTITION BY doc_id, before) AS at0 FROM ln3 WHERE NOT wide
          UNION ALL
          SELECT doc_id, 2 * before + 1, j, CASE WHEN j = 1 THEN length(w[1]) ELSE 1 + length(w[j]) END, at0
          FROM (SELECT doc_id, before, at0, w, unnest(range(1, len(w) + 1)) AS j
                FROM (SELECT doc_id, before, at0, string_split(p, ' ') AS w FROM ln3 WHERE wide))),
run AS (SELECT doc_id, run, any_value(at0) AS at0, list_prepend(0::BIGINT, list(c ORDER BY ord)) AS cs
        FROM (SELECT doc_id, run, at0, ord, (sum(n) OVER (PARTITION BY doc_id, run ORDER BY ord))::BIGINT AS c
              FROM piece WHERE n > 0) GROUP BY doc_id, run),
rec AS (SELECT doc_id, run, at0, cs, len(cs) - 1 AS n, 0::BIGINT AS s, -1::BIGINT AS ip, 0 AS seq,
               0::BIGINT AS a, 0::BIGINT AS b, FALSE AS done FROM run
        UNION ALL
        SELECT doc_id, run, at0, cs, n,
               CASE WHEN e IS NULL THEN s ELSE list_min(list_filter(range(s, e + 1), lambda t:
                    cs[e + 1] - cs[t + 1] <= 150
                    AND (cs[e + 2] - cs[t + 1] <= 512 OR t = e))) END,
               coalesce(e, n), seq + 1, s, coalesce(e, n), e IS NULL
        FROM (SELECT *, list_min(list_filter(range(greatest(ip, s) + 1, n),
                                             lambda j: cs[j + 2] - cs[s + 1] > 512)) AS e
              FROM rec WHERE NOT done)),
cut AS (SELECT r.doc_id, d.source, run, seq,
               trim(substr(d.text, r.at0 + cs[a + 1] + 1, cs[b + 1] - cs[a + 1]),
                    chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)) AS content
        FROM rec r JOIN documents d ON d.doc_id = r.doc_id WHERE seq > 0),
t1 AS MATERIALIZED (SELECT doc_id, source, content,
              (row_number() OVER (PARTITION BY doc_id ORDER BY run, seq) - 1)::INTEGER AS chunk_index
       FROM cut WHERE content <> '')"""

RETRIEVE_MMR_SQL = f"""
WITH RECURSIVE {_WIN[1:]},
q AS (SELECT item_id AS id, text FROM benchmark),
{hvec('qv', 'benchmark', 'item_id', 'text')[1:]},
{hvec('cv', 'chunks', 'chunk_id', 'content')[1:]},
cids AS (SELECT DISTINCT chunk_id AS id FROM chunks),
{sparse_l2('qv', 'cv', 'q', 'cids')[1:]},
cand AS MATERIALIZED (SELECT qid, vid, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), vid) AS pos
         FROM qv_cv_d QUALIFY pos <= 20),
qdot AS (SELECT c.qid, c.vid, c.pos,
                coalesce(x.dot, 0) / nullif(sqrt(qn.ss) * sqrt(vn.ss), 0) AS cq
         FROM cand c LEFT JOIN qv_cv_dot x ON x.qid = c.qid AND x.vid = c.vid
         LEFT JOIN qv_n qn ON qn.id = c.qid LEFT JOIN cv_n vn ON vn.id = c.vid),
cs AS (SELECT qid, vid, pos, coalesce(cq, 0) AS sq FROM qdot),
pairs AS MATERIALIZED (SELECT a.qid, a.vid AS a, b.vid AS b FROM cand a JOIN cand b USING (qid)),
px AS MATERIALIZED (SELECT p.qid, p.a, p.b, x.dim, x.w FROM pairs p JOIN cv x ON x.id = p.a),
pdot AS (SELECT p.qid, p.a, p.b, sum(p.w::DOUBLE * y.w::DOUBLE) AS dot
         FROM px p JOIN cv y ON y.id = p.b AND y.dim = p.dim
         GROUP BY ALL),
cc AS (SELECT p.qid, p.a, p.b,
              coalesce(coalesce(d.dot, 0) / nullif(sqrt(na.ss) * sqrt(nb.ss), 0), 0) AS s
       FROM pairs p LEFT JOIN pdot d ON d.qid = p.qid AND d.a = p.a AND d.b = p.b
       LEFT JOIN cv_n na ON na.id = p.a LEFT JOIN cv_n nb ON nb.id = p.b),
m(qid, picked, step) AS (
  SELECT qid, [vid], 1 FROM cs
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sq DESC, pos) = 1
  UNION ALL
  SELECT qid, list_append(picked, vid), step + 1 FROM (
    SELECT m.qid, m.picked, m.step, c.vid, c.pos, 0.5 * c.sq - 0.5 * max(cc.s) AS score
    FROM m JOIN cs c ON c.qid = m.qid AND NOT list_contains(m.picked, c.vid)
           JOIN cc ON cc.qid = m.qid AND cc.a = c.vid AND list_contains(m.picked, cc.b)
    WHERE m.step < 10
    GROUP BY m.qid, m.picked, m.step, c.vid, c.pos, c.sq)
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) = 1),
mmr AS (SELECT qid, unnest(picked) AS vid, generate_subscripts(picked, 1) AS rank
        FROM m WHERE step = (SELECT max(step) FROM m m2 WHERE m2.qid = m.qid)),
merged AS (SELECT qid, vid, pos AS rank, 0 AS src FROM cand WHERE pos <= 10
           UNION ALL SELECT qid, vid, rank, 1 FROM mmr),
hits AS (SELECT h.qid AS question_id, h.vid AS chunk_id, c.content,
                row_number() OVER (PARTITION BY h.qid ORDER BY h.rank, h.src) AS rank
         FROM merged h JOIN (SELECT DISTINCT chunk_id, content FROM chunks) c ON c.chunk_id = h.vid),
dedup AS (SELECT * FROM hits
          QUALIFY row_number() OVER (PARTITION BY question_id, {strip('content')} ORDER BY rank) = 1),
dedup2 AS (SELECT question_id, chunk_id, content,
                  row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank FROM dedup),
scored AS (SELECT d.*, {overlap('b.text', 'd.content')} AS score
           FROM dedup2 d JOIN benchmark b ON b.item_id = d.question_id),
best AS (SELECT question_id, content,
                row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) AS rank
         FROM scored
         QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) <= 5),
re AS (SELECT question_id, content, {reorder_pos()} AS pos
       FROM (SELECT *, count(*) OVER (PARTITION BY question_id) AS n FROM best)),
ctx AS (SELECT question_id, replace(string_agg(content, ' ' ORDER BY pos), {NL}, '. ') AS context,
               count(*) AS n_hits FROM re GROUP BY question_id)
SELECT b.item_id AS question_id, {qa_text('ctx.context', 'b.text')} AS prompt,
       coalesce(ctx.n_hits, 0)::BIGINT AS n_hits
FROM benchmark b LEFT JOIN ctx ON ctx.question_id = b.item_id
"""

RERANK_OVERLAP = f"""
WITH q AS (SELECT item_id AS id FROM benchmark),
dids AS (SELECT doc_id AS id FROM documents),
{hvec('qv', 'benchmark', 'item_id', 'text')[1:]},
{hvec('dv', 'documents', 'doc_id', 'text')[1:]},
{sparse_l2('qv', 'dv', 'q', 'dids')[1:]},
top AS (SELECT qid, vid, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), vid) AS rank
        FROM qv_dv_d QUALIFY rank <= 20),
scored AS (SELECT t.qid, t.vid, t.rank, {overlap('b.text', 'd.text')} AS score
           FROM top t JOIN benchmark b ON b.item_id = t.qid JOIN documents d ON d.doc_id = t.vid)
SELECT qid AS item_id, vid AS doc_id,
       row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank)::INTEGER AS rank,
       round(score, 6) AS score
FROM scored QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) <= 5
"""

HASH_EMBED = f"""
WITH src AS (SELECT 'documents' AS kind, doc_id AS id, text FROM documents
             UNION ALL SELECT 'benchmark', item_id, text FROM benchmark),
t AS (SELECT kind, id, unnest({words('text')}) AS tok FROM src),
c AS (SELECT kind, id, (('0x' || substr(md5(tok), 1, 8))::BIGINT % 256)::INTEGER AS dim,
             count(*) AS n FROM t GROUP BY ALL)
SELECT kind, id, dim,
       round(((n / sqrt(sum(n * n) OVER (PARTITION BY kind, id)))::FLOAT)::DOUBLE, 6) AS w
FROM c
"""

MERGE_DEDUP = f"""
WITH a AS ({knn_ranked('l2', 5, 'b.label < 6')}),
b AS ({knn_ranked('cosine', 5, 'b.label > 3')}),
m AS (SELECT query_id, vec_id, rank, 0 AS src FROM a UNION ALL
      SELECT query_id, vec_id, rank, 1 FROM b),
m2 AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, src) AS rank
       FROM m),
d AS (SELECT * FROM m2
      QUALIFY row_number() OVER (PARTITION BY query_id, {strip('vec_id::VARCHAR')} ORDER BY rank) = 1)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS rank
FROM d
"""

LONG_CONTEXT = f"""
WITH md AS ({MERGE_DEDUP})
SELECT query_id, vec_id, ({reorder_pos('rank', 'query_id')})::INTEGER AS rank
FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM md)
"""

FALLBACK = f"""
WITH p AS (SELECT query_id, vec_id, rank, 'primary' AS retriever, d
           FROM ({knn_ranked('l2', 3, 'b.label < 3')}) WHERE d <= 1.3),
miss AS (SELECT vec_id AS query_id FROM embeddings
         WHERE vec_id NOT IN (SELECT query_id FROM p)),
b AS (SELECT query_id, vec_id, rank, 'backup' AS retriever, d
      FROM ({knn_ranked('cosine', 1)}) WHERE query_id IN (SELECT query_id FROM miss))
SELECT query_id, vec_id, rank, retriever, round(d, 4) AS distance FROM p
UNION ALL SELECT query_id, vec_id, rank, retriever, round(d, 4) FROM b
"""

ACCURACY = f"""
WITH nn AS (SELECT * FROM ({knn_ranked('l2', 6)}) WHERE query_id <> vec_id
            QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5),
votes AS (SELECT nn.query_id, e.label, count(*) AS n FROM nn JOIN embeddings e USING (vec_id)
          GROUP BY ALL),
pred AS (SELECT query_id::VARCHAR AS qid, label::VARCHAR AS ans FROM votes
         QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) = 1),
j AS (SELECT p.qid, p.ans, t.label::VARCHAR AS act, t.vec_id IS NOT NULL AS m
      FROM pred p LEFT JOIN embeddings t ON t.vec_id::VARCHAR = p.qid)
SELECT count(*) AS n_pred, count(*) FILTER (WHERE m) AS n_matched,
       count(*) FILTER (WHERE ans = act) AS n_correct,
       CASE WHEN count(*) FILTER (WHERE m) > 0 THEN
         round(count(*) FILTER (WHERE ans = act) / count(*) FILTER (WHERE m), 6) END AS accuracy
FROM j
"""

RETRIEVE_PROMPT = (
    RETRIEVE_MMR_SQL.replace(_WIN[1:], T1 + """,
chunks AS MATERIALIZED (SELECT sha256(doc_id::VARCHAR || '|' || chunk_index::VARCHAR || '|' || content) AS chunk_id,
                  content FROM t1)""")
    .replace(qa_text('ctx.context', 'b.text'), mcq_text('ctx.context', 'b.text', "''")))

_CONV_Q = f"""
u AS (SELECT u.conv_id, u.conv_id::VARCHAR || '-' || u.turn::VARCHAR AS question_id,
             u.text AS question, a.turn AS a_turn, a.text AS a_text
      FROM conversations u LEFT JOIN conversations a
        ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
      WHERE u.role = 'user'),
near AS (SELECT u.question_id, u.question, c.turn, c.role, c.text
         FROM u JOIN conversations c ON c.conv_id = u.conv_id
         WHERE c.turn > u.a_turn),
z AS (SELECT question_id, arg_max(text, turn) AS explanation FROM near
      WHERE role = 'assistant' GROUP BY question_id),
q AS (SELECT u.question_id, u.question,
             coalesce(list_filter(list_transform(string_split(a_text, {NL}), lambda x: {strip('x')}),
                                  lambda x: x <> ''), []) AS lines,
             z.explanation
      FROM u LEFT JOIN z USING (question_id)),
q2 AS (SELECT *, CASE WHEN len(lines) > 0 THEN 'option 1: ' || lines[1] END AS answer,
              array_to_string([ 'option ' || i::VARCHAR || ': ' || lines[i] || {NL}
                                for i in range(1, len(lines) + 1) ], '') AS opts
       FROM q),
later AS (SELECT question_id, turn, text, {overlap('question', 'text')} AS score FROM near),
best AS (SELECT question_id, text,
                row_number() OVER (PARTITION BY question_id ORDER BY score DESC, turn) AS pos
         FROM later
         QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, turn) <= 3),
ctx AS (SELECT question_id, replace(string_agg(text, ' ' ORDER BY pos), {NL}, '. ') AS context
        FROM best GROUP BY question_id)"""

MCQ_TRAIN = f"""
WITH {_CONV_Q[1:]}
SELECT q2.question_id,
       {mcq_text('ctx.context', 'q2.question', 'q2.opts', 'q2.answer', 'q2.explanation')} AS prompt,
       q2.answer, q2.explanation
FROM q2 LEFT JOIN ctx USING (question_id)
"""

MCQ_INFER = f"""
WITH {_CONV_Q[1:]}
SELECT q2.question_id, {mcq_text('ctx.context', 'q2.question', 'q2.opts')} AS prompt
FROM q2 LEFT JOIN ctx USING (question_id)
"""

QA_PROMPT = f"""
WITH {_CONV_Q[1:]}
SELECT q2.question_id, {qa_text('ctx.context', 'q2.question', 'q2.explanation')} AS prompt,
       q2.answer
FROM q2 LEFT JOIN ctx USING (question_id)
"""

_TOK = "(('0x' || substr(md5(t), 1, 6))::BIGINT % 50000)::INTEGER"
_TOKENS = f"""
WITH p AS ({MCQ_TRAIN}),
tk AS (SELECT question_id,
              [ {_TOK} for t in list_filter(regexp_split_to_array(prompt, '[ \\t\\n\\r\\f\\x0B]+'),
                                             lambda x: x <> '') ] AS ids FROM p),
ml AS (SELECT least(max(len(ids)), 128) AS m FROM tk),
tr AS (SELECT question_id,
              CASE WHEN least(m, len(ids)) > 0 THEN ids[len(ids) - least(m, len(ids)) + 1:]
                   ELSE [] END AS ids
       FROM tk CROSS JOIN ml)"""

TOKEN_TRUNCATE = f"""
{_TOKENS[1:]}
SELECT question_id, len(ids)::INTEGER AS n_tokens, array_to_string(ids, ',') AS ids FROM tr
"""

COPY_LABELS = f"""
{_TOKENS[1:]}
SELECT question_id, array_to_string(ids, ',') AS labels FROM tr
"""

COMPLETION_MASK = f"""
{_TOKENS[1:]},
mk AS (SELECT [ {_TOK} for t in ['###', 'Answer:'] ] AS mk),
pos AS (SELECT question_id, ids, len(mk.mk) AS m,
               list_filter(range(1, greatest(len(ids), 1) + 1),
                           lambda p: ids[p:p + len(mk.mk) - 1] = mk.mk)[1] AS pos
        FROM tr CROSS JOIN mk),
lab AS (SELECT question_id,
               CASE WHEN pos IS NULL THEN [ -100 for x in ids ]
                    ELSE [ CASE WHEN i <= pos - 1 + m THEN -100 ELSE ids[i] END
                           for i in range(1, len(ids) + 1) ] END AS labels
        FROM pos)
SELECT question_id, len(list_filter(labels, lambda x: x = -100))::INTEGER AS n_masked,
       array_to_string(labels, ',') AS labels
FROM lab
"""

TURN_MASK = _TOKENS.replace("least(max(len(ids)), 128)", "least(max(len(ids)), 400)") + f""",
mk AS (SELECT [ {_TOK} for t in ['###', 'Answer:'] ] AS r, [ {_TOK} for t in ['###', 'Instructions:'] ] AS a),
pos AS (SELECT question_id, ids,
               list_filter(range(0, len(ids)), lambda p: ids[p + 1:p + len(mk.r)] = mk.r) AS rs,
               list_filter(range(0, len(ids)), lambda p: ids[p + 1:p + len(mk.a)] = mk.a) AS asked,
               len(mk.r) AS m FROM tr CROSS JOIN mk),
pair AS (SELECT question_id, ids, [ x + m for x in rs ] AS ends, len(rs) > 0 AND len(asked) > 0 AS ok,
                CASE WHEN asked[1] > rs[1] THEN [0::BIGINT] || asked ELSE asked END AS asks FROM pos),
lab AS (SELECT question_id, [ CASE WHEN NOT ok
                  OR len(list_filter(range(1, least(len(asks), len(ends)) + 1), lambda k:
                         i - 1 >= CASE WHEN k = 1 THEN 0 ELSE asks[k] END AND i - 1 < ends[k])) > 0
                  OR (len(ends) < len(asks) AND i - 1 >= asks[-1]) THEN -100 ELSE ids[i] END
                for i in range(1, len(ids) + 1) ] AS labels FROM pair)
SELECT question_id, len(list_filter(labels, lambda x: x = -100))::INTEGER AS n_masked,
       array_to_string(labels, ',') AS labels
FROM lab
"""

MULTI_QUERY = f"""
WITH u AS (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS question_id, text
           FROM conversations WHERE role = 'user'),
l AS (SELECT question_id, list_filter(list_transform(string_split(text, {NL}), lambda x: {strip('x')}),
                                      lambda x: x <> '') AS lines, text FROM u),
v AS (SELECT question_id, unnest(list_append(lines, text)) AS question,
             generate_subscripts(list_append(lines, text), 1) AS variant_no FROM l),
vk AS (SELECT question_id || '#' || variant_no::VARCHAR AS vid, question_id, variant_no, question
       FROM v),
dids AS (SELECT doc_id AS id FROM documents),
vq AS (SELECT vid AS id FROM vk),
{hvec('qv', 'vk', 'vid', 'question')[1:]},
{hvec('dv', 'documents', 'doc_id', 'text')[1:]},
{sparse_l2('qv', 'dv', 'vq', 'dids')[1:]},
top AS (SELECT qid, vid AS doc_id,
               row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), vid) AS rank
        FROM qv_dv_d QUALIFY rank <= 3),
h AS (SELECT vk.question_id, vk.variant_no, top.doc_id, top.rank FROM top JOIN vk ON vk.vid = top.qid
      QUALIFY row_number() OVER (PARTITION BY vk.question_id, top.doc_id
                                 ORDER BY vk.variant_no, top.rank) = 1)
SELECT question_id, doc_id,
       row_number() OVER (PARTITION BY question_id ORDER BY variant_no, rank)::INTEGER AS rank
FROM h
"""

SOURCE_METADATA = f"""
WITH p AS (
  SELECT doc_id, '/data/' || source || '/' ||
         CASE WHEN lang = 'en' THEN 'rel_' || (n_chars % 20)::VARCHAR || '.docx'
              WHEN lang = 'fr' THEN 'rel_' || lang || '.docx'
              ELSE source || '.docx' END AS path
  FROM documents),
b AS (SELECT doc_id, path, string_split(path, '/')[-1] AS source FROM p),
y AS (SELECT *, CASE WHEN starts_with(source, 'rel_') THEN
        TRY_CAST({strip("split_part(split_part(source, '_', 2), '.', 1)")} AS INTEGER) END AS year
      FROM b)
SELECT doc_id, path, source, year, '3GPP Release ' || year::VARCHAR AS tag FROM y
"""

GRAPH_EDGES = f"""
WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[.!?\\n]+')) AS sent
           FROM documents),
sid AS (SELECT doc_id, sent, row_number() OVER () AS sid FROM s),
e AS (SELECT doc_id, sid,
             list_transform(list_filter(list_filter(regexp_split_to_array(sent, '[^\\p{{L}}\\p{{N}}]+'),
                                                    lambda t: t <> ''),
                                        lambda t: regexp_matches(t, '^\\p{{Lu}}')),
                            lambda t: lower(t)) AS ents
      FROM sid),
p AS (SELECT doc_id, unnest([ {{'src': ents[i], 'dst': ents[i + 1]}} for i in range(1, len(ents)) ]) AS x
      FROM e WHERE len(ents) > 1)
SELECT x.src AS src, x.dst AS dst, 'NEXT_TO' AS type, count(DISTINCT doc_id) AS n_chunks
FROM p GROUP BY ALL
"""

# R2 as a recursive CTE: candidates = 20 nearest by l2; greedy picks of
# 0.5 * cos(q, c) - 0.5 * max cos(c, picked), ties to the nearer candidate.
MMR = f"""
WITH RECURSIVE
cand AS (
  SELECT a.vec_id AS qid, b.vec_id AS vid, a.embedding AS qe, b.embedding AS ve, {dense('l2')} AS d
  FROM embeddings a CROSS JOIN embeddings b
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(d, 9), b.vec_id) <= 20),
cs AS (SELECT qid, vid, ve, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), vid) AS pos,
              {cos_sql('qe', 've')} AS sq FROM cand),
cc AS (SELECT x.qid, x.vid AS a, y.vid AS b, {cos_sql('x.ve', 'y.ve')} AS s
       FROM cs x JOIN cs y USING (qid)),
m(qid, picked, step) AS (
  SELECT qid, [vid], 1 FROM cs
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sq DESC, pos) = 1
  UNION ALL
  SELECT qid, list_append(picked, vid), step + 1 FROM (
    SELECT m.qid, m.picked, m.step, c.vid, c.pos, 0.5 * c.sq - 0.5 * max(cc.s) AS score
    FROM m JOIN cs c ON c.qid = m.qid AND NOT list_contains(m.picked, c.vid)
           JOIN cc ON cc.qid = m.qid AND cc.a = c.vid AND list_contains(m.picked, cc.b)
    WHERE m.step < 5
    GROUP BY m.qid, m.picked, m.step, c.vid, c.pos, c.sq)
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) = 1)
SELECT qid AS query_id, unnest(picked) AS vec_id, generate_subscripts(picked, 1)::INTEGER AS rank
FROM m WHERE step = 5
"""

SQL: dict[str, str] = {
    "mmr": MMR,
    "retrieve_mmr_sql": RETRIEVE_MMR_SQL,
    "retrieve_sql": RETRIEVE_SQL,
    "source_metadata": SOURCE_METADATA,
    "dedup_corpus": f"""
SELECT doc_id, source FROM documents
QUALIFY row_number() OVER (PARTITION BY {strip('text')} ORDER BY doc_id) = 1
""",
    "duplicate_count": f"""
SELECT count(*) AS n_rows, count(DISTINCT {strip('text')}) AS n_unique,
       count(*) - count(DISTINCT {strip('text')}) AS n_duplicates
FROM documents
""",
    "hash_embed": HASH_EMBED,
    "recursive_chunks": f"""
WITH RECURSIVE {T1}
SELECT doc_id, chunk_index, length(content) AS n_chars, md5(content) AS content_md5 FROM t1
""",
    "chunk_stats": f"""
WITH RECURSIVE {T1}
SELECT source, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs,
       max(length(content)) AS max_chars, sum(length(content))::BIGINT AS total_chars
FROM t1 GROUP BY source
""",
    "incremental_ingest": f"""
WITH RECURSIVE {T1}
SELECT doc_id, chunk_index,
       sha256(doc_id::VARCHAR || '|' || chunk_index::VARCHAR || '|' || content) AS chunk_id FROM t1
""",
    "retrieve_prompt": RETRIEVE_PROMPT,
    "knn_codes": f"SELECT query_id, vec_id, rank, round(d, 4) AS distance FROM ({knn_ranked('l2', 10)})",
    "knn_l2": f"SELECT query_id, vec_id, rank, round(d, 4) AS distance FROM ({knn_ranked('l2', 10)})",
    "knn_ivf": f"SELECT query_id, vec_id, rank, round(d, 4) AS distance FROM ({knn_ranked('l2', 10)})",
    "knn_cosine": ("SELECT query_id, vec_id, rank, round(d, 4) AS distance FROM "
                   f"({knn_ranked('cosine', 10)})"),
    "knn_filtered": ("SELECT query_id, vec_id, rank, round(d, 4) AS distance FROM "
                     f"({knn_ranked('l2', 5, 'b.label < 5')})"),
    "merge_dedup": MERGE_DEDUP,
    "rerank_overlap": RERANK_OVERLAP,
    "long_context_order": LONG_CONTEXT,
    "fallback_hits": FALLBACK,
    "multi_query": MULTI_QUERY,
    "mcq_prompt_train": MCQ_TRAIN,
    "mcq_prompt_infer": MCQ_INFER,
    "qa_prompt": QA_PROMPT,
    "token_truncate": TOKEN_TRUNCATE,
    "copy_labels": COPY_LABELS,
    "completion_mask": COMPLETION_MASK,
    "turn_mask": TURN_MASK,
    "exact_split": """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('123:' || doc_id::VARCHAR), doc_id)
                         <= ceil(0.1 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
FROM documents
""",
    "split_sizes": """
WITH s AS (SELECT CASE WHEN row_number() OVER (ORDER BY md5('123:' || doc_id::VARCHAR), doc_id)
                            <= ceil(0.1 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
           FROM documents)
SELECT split, count(*) AS n_rows FROM s GROUP BY split
""",
    "sample_n": "SELECT doc_id FROM documents ORDER BY md5('123:' || doc_id::VARCHAR), doc_id LIMIT 25",
    "reverse_order": "SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS position FROM documents",
    "answer_parse": f"""
SELECT conv_id, turn, {strip("right(split_part(coalesce(text, ''), ':', 1), 1)")} AS answer
FROM conversations
""",
    "accuracy": ACCURACY,
    "line_list": f"""
WITH l AS (SELECT conv_id, turn,
                  list_filter(list_transform(string_split(text, {NL}), lambda x: {strip('x')}),
                              lambda x: x <> '') AS lines FROM conversations)
SELECT conv_id, turn, generate_subscripts(lines, 1)::INTEGER AS line_no, unnest(lines) AS line FROM l
""",
    "strip_tokens": """
SELECT conv_id, turn, replace(replace(replace(replace(replace(text, '</s>', ''), '<|system|>', ''),
       '<|ed|>', ''), '<|eot_id|>', ''), '<|assistant|>', '') AS text
FROM conversations
""",
    "stop_truncate": f"""
SELECT conv_id, turn, {strip(f"split_part(split_part(text, '.', 1), {NL}, 1)")} AS text
FROM conversations
""",
    "batches": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch_id FROM documents",
    "shards": """
SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // ((count(*) OVER ()) // 8 + 1) AS shard_id
FROM documents
""",
    "graph_edges": GRAPH_EDGES,
}
