"""A sparse lexical retriever (BM25) over a distributed inverted index.

``build_index`` turns chunks into three tables below a folder: postings (term, chunk id,
frequency, chunk length) written by ranges of the term's hash, terms (term, chunks that
have it) and one row of corpus sizes. ``search`` joins the distinct words of all questions
with the postings of those words, adds the parts of each (question, chunk) and keeps the
best k. Up to ``MAX_QUESTIONS`` questions are told to every task, the postings of their words
are dealt by chunk, and a task keeps the best k of its chunks. More questions are joined with
the postings; a partial sum and a partial top-k run before each shuffle.

In that join a word that a third of all chunks hold has as many postings; they are split over ``salts``
by chunk, and the question words are repeated once a salt, so no word is one task. The
score needs only words that occur in a question, each at most once.

A null text has no words; a question without known words has no hits; chunk ids must be
unique and break ties (ascending)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from .knn import _first_k_per_row

QID = "question_id"
K1, B = 1.2, 0.75
#: Scores are compared and returned with so many digits.
DIGITS = 6
#: Questions, and words of all questions, up to which a task is told all of them; scores held at once.
MAX_QUESTIONS, MAX_ASKED, CELLS = 1 << 12, 1 << 20, 1 << 20


def build_index(chunks: DataFrame, path: str, chunk_id: str = "chunk_id",
                content: str = "content") -> None:
    """Write the index of ``chunks`` below ``path`` (shared storage)."""
    base, spark = path.rstrip("/"), chunks.sparkSession
    words = TX.words(F.coalesce(F.col(content), F.lit("")))
    # texts are dealt by id, so that the words of a chunk are counted where they are cut
    counted = (chunks.select(F.col(chunk_id).alias("chunk_id"), F.col(content).alias("_t"))
               .repartition("chunk_id").select("chunk_id", TX.words(F.coalesce("_t", F.lit(""))).alias("_w"))
               .withColumn("length", F.size("_w"))
               .select("chunk_id", "length", F.explode("_w").alias("term"))
               .groupBy("chunk_id", "length", "term").agg(F.count(F.lit(1)).cast("int").alias("tf")))
    counted.repartitionByRange(F.xxhash64("term"), F.col("chunk_id")).sortWithinPartitions(
        F.xxhash64("term"), "chunk_id").select(
        F.xxhash64("term").alias("h"), "term", "chunk_id", "tf", "length").write.parquet(f"{base}/postings")
    postings = spark.read.schema("h long, term string").parquet(f"{base}/postings")
    postings.groupBy("h", "term").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{base}/terms")
    (chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size(words)), F.lit(0.0)).alias("mean"))
     .write.parquet(f"{base}/sizes"))


def search(questions: DataFrame, path: str, k: int, question: str = "question",
           salts: int | None = None) -> DataFrame:
    """hits(question_id, chunk_id, rank, score): the ``k`` best chunks by BM25 of every
    question. ``salts`` parts per word (default: one per 100,000 postings of the most
    frequent word)."""
    spark = questions.sparkSession
    postings, terms, sizes = (spark.read.parquet(f"{path.rstrip('/')}/{t}")
                              for t in ("postings", "terms", "sizes"))
    total = sizes.first()                                     # one row
    n, mean = total["n"], max(total["mean"], 1e-9)
    asked = (questions.select(QID, F.explode(F.array_distinct(TX.words(F.coalesce(
        F.col(question), F.lit(""))))).alias("term")).withColumn("h", F.xxhash64("term")))
    if salts is None:
        found = _scored_by_chunk(asked, postings, terms, n, mean, k)
        if found is not None:
            return _ranked(found, k)
    if salts is None:
        most = terms.agg(F.max("df")).first()[0] or 0
        salts = max(1, -(-most // 100_000))
    idf = _idf(n)
    asked = (asked.join(terms, ["h", "term"]).select(QID, "h", "term", idf.alias("idf"))
             .withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    dealt = postings.withColumn("s", F.pmod(F.xxhash64("chunk_id"), F.lit(salts)).cast("int"))
    part = _part(mean)
    scored = (asked.join(dealt, ["h", "term", "s"]).select(QID, "chunk_id", part.alias("part"))
              .groupBy(QID, "chunk_id").agg(F.round(F.sum("part"), DIGITS).alias("score")))
    return _ranked(scored, k)


def _idf(n: int):
    return F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))


def _part(mean: float):
    length = F.lit(1 - B) + F.lit(B) * F.col("length") / F.lit(mean)
    return F.col("idf") * F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + F.lit(K1) * length)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy(QID).orderBy(F.desc("score"), "chunk_id")
    return (scored.withColumn("rank", F.row_number().over(best).cast("int"))
            .where(F.col("rank") <= k).select(QID, "chunk_id", "rank", "score"))


def _scored_by_chunk(asked: DataFrame, postings: DataFrame, terms: DataFrame, n: int, mean: float,
                     k: int) -> DataFrame | None:
    """(question_id, chunk_id, score) with the best ``k`` of every question, or None if the
    questions are too many to be told to every task.

    Only postings of words in a question are moved, each once and dealt by chunk, so that a
    task adds up whole scores and keeps k a question and task: what is shuffled does not grow
    with questions times chunks."""
    from pyspark.sql.pandas.types import to_arrow_schema

    limit = asked.limit(MAX_ASKED + 1).count()
    questions = asked.select(QID).distinct().limit(MAX_QUESTIONS + 1).count()
    if limit > MAX_ASKED or questions > MAX_QUESTIONS:
        return None
    spark = asked.sparkSession
    known = asked.select("h", "term").distinct().join(terms, ["h", "term"]).collect()   # at most MAX_ASKED
    at = {(r["h"], r["term"]): i for i, r in enumerate(known)}
    qids, who, what = [], [], []
    seat: dict = {}
    for r in asked.collect():
        i = at.get((r["h"], r["term"]))
        if i is not None:
            who.append(seat.setdefault(r[QID], len(seat)))
            what.append(i)
    qids = list(seat)
    kind = asked.schema[QID].dataType
    schema = T.StructType([T.StructField("_q", T.IntegerType()),
                           T.StructField("chunk_id", postings.schema["chunk_id"].dataType),
                           T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    who, what = np.array(who, np.int64), np.array(what, np.int64)
    order = np.argsort(what, kind="stable")
    start = np.searchsorted(what[order], np.arange(len(known) + 1))
    told = spark.sparkContext.broadcast((start, who[order], len(qids)))
    words = spark.createDataFrame([(r["h"], r["term"], r["df"], i) for i, r in enumerate(known)],
                                  "h long, term string, df long, t int")
    moved = (postings.join(F.broadcast(words), ["h", "term"]).withColumn("idf", _idf(n))
             .select("chunk_id", "t", _part(mean).alias("part")).repartition("chunk_id")
             .sortWithinPartitions("chunk_id"))

    def run(batches):
        start, who, n_q = told.value
        if not n_q:
            return
        best = None             # question, number of the chunk in this task, score; and the ids
        seen, floor = 0, np.full(n_q, -np.inf)
        wide = max(1, CELLS // n_q)

        def whole():
            """Batches cut at the last change of chunk."""
            rest = None
            for b in batches:
                if not b.num_rows:
                    continue
                t = pa.Table.from_batches([b])
                t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
                ids = pc.rank(t.column("chunk_id"), tiebreaker="dense", null_placement="at_start").to_numpy()
                cut = int(np.searchsorted(ids, ids[-1]))
                if cut:
                    yield t.slice(0, cut), ids[:cut].astype(np.int64) - 1
                rest = t.slice(cut)
            if rest is not None and rest.num_rows:
                yield rest, np.zeros(rest.num_rows, np.int64)

        for table, chunk in whole():
            word, part = table.column("t").to_numpy(), table.column("part").to_numpy()
            first = np.searchsorted(chunk, np.arange(chunk[-1] + 2))
            for lo in range(0, len(first) - 1, wide):
                hi = min(len(first) - 1, lo + wide)
                a, z = first[lo], first[hi]
                score, held = np.zeros((hi - lo) * n_q), np.zeros((hi - lo) * n_q, bool)
                step = max(1, CELLS // max(1, n_q))
                for s in range(a, z, step):
                    w = word[s:min(z, s + step)]
                    count = start[w + 1] - start[w]
                    row = np.repeat(np.arange(len(w)), count)
                    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                    cell = (chunk[s + row] - lo) * n_q + who[start[w][row] + place]
                    score += np.bincount(cell, part[s + row], minlength=len(score))
                    held[cell] = True
                f = np.flatnonzero(held)
                value = np.floor(score[f] * 10.0 ** DIGITS + 0.5)
                keep = value > floor[f % n_q]       # a later chunk loses a tie
                f, value = f[keep], value[keep]
                if not len(f):
                    continue
                ids = table.column("chunk_id").take(pa.array(first[lo + f // n_q])).combine_chunks()
                mine = (f % n_q, seen + lo + f // n_q, value, score[f])
                if best is not None:
                    mine = tuple(np.concatenate(x) for x in zip(best[0], mine))
                    ids = pa.concat_arrays([best[1], ids])
                keep = _first_k_per_row(mine[0], [-mine[2], mine[1]], k)
                best = tuple(x[keep] for x in mine), ids.take(pa.array(keep))
                count = np.bincount(best[0][0], minlength=n_q)
                least = np.full(n_q, np.inf)
                np.minimum.at(least, best[0][0], best[0][2])
                floor = np.where(count >= k, least, -np.inf)
            seen += len(first) - 1
        if best is not None and len(best[0][0]):
            yield pa.RecordBatch.from_arrays(
                [pa.array(best[0][0], pa.int32()), best[1], pa.array(best[0][3])], schema=arrow)

    names = spark.createDataFrame([(i, x) for i, x in enumerate(qids)],
                                  T.StructType([T.StructField("_q", T.IntegerType()), T.StructField(QID, kind)]))
    return moved.mapInArrow(run, schema).join(F.broadcast(names), "_q").select(
        QID, "chunk_id", F.round("score", DIGITS).alias("score"))


def retriever(path: str, chunks: DataFrame, k: int):
    """The search as a plug-in: questions -> hits(question_id, chunk_id, content, rank, score,
    distance), the text fetched by id from the (stored) chunk table."""
    def retrieve(questions: DataFrame) -> DataFrame:
        hits = search(questions, path, k)
        return hits.join(chunks.select("chunk_id", "content"), "chunk_id").select(
            QID, "chunk_id", "content", "rank", "score", (-F.col("score")).alias("distance"))

    return retrieve
