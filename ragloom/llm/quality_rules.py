"""Quality rules: base rules and robust multivariate outliers.

Per language and source, location and scatter of transformed statistics are
estimated by minimum covariance determinant: concentration steps, each keeping
the ``h`` share of rows with the smallest Mahalanobis distance, then one
reweighting step. A step is one pass over a small table of statistics: rows are
summed (count, sums, products) by group and distance bin with map-side partial
aggregation, and the bins up to the ``h``-quantile give the next estimate, so no
group meets in one task and nothing but a row per group is ever joined back.

Statistics: mean word length, symbols, capitals, punctuation per character,
repeated lines and repeated words, as differences from the group's median,
shrunk for short texts by sqrt(n / (n + SHRINK)). ``FLOOR`` is added to the
scatter as the smallest spread that counts, so a statistic that hardly varies
in a group rejects nobody for a trifle.

Groups of fewer than ``min_rows`` rows are pooled by language, then all
together; a pool that is still smaller rejects nothing.

Defined results: a null text has no words and fails the base rule; null language
or source are values of their own; repeated rows count as often as they occur;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_small, map_texts, written
from .stats import FIELDS, text_stats

NAMES = ("length", "symbols", "capitals", "punctuation", "lines", "repeats")
P = len(NAMES)
#: Smallest meaningful standard deviation of each statistic, in their order.
FLOOR = (0.5, 0.02, 0.02, 0.03, 0.06, 0.06)
SHRINK = 200
#: Chi-square quantiles with six degrees of freedom: 0.5, 0.975; fixed values.
CHI_HALF, CHI_975 = 5.348, 14.449
#: Rows beyond this squared distance are rejected.
CUTOFF = 18.0
BINS_PER_DOUBLING = 8
COUNTS = FIELDS[:5]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(_id, _lang, _source, counts of ``FIELDS``), read from the whole texts."""
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"),
                      F.col(source_col).cast("string").alias("_source"),
                      F.col(text_col).alias("text"))

    def run(rows, texts):
        got = [text_stats(t) for t in texts]
        return [*rows.columns[:3], *(list(c) for c in zip(*got))]

    return map_texts(src, ["_id", "_lang", "_source"], run,
                     f"_id {kind}, _lang string, _source string, "
                     + ", ".join(f"{f} long" for f in FIELDS))


def _pooled(ok: DataFrame, min_rows: int) -> DataFrame:
    """Adds ``_g``, the group whose estimate a row uses; null if every pool is too small."""
    sizes = ok.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("_n"))
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    small = F.col("_n") < min_rows
    by_lang = Window.partitionBy("_lang", "_small")
    sizes = sizes.withColumn("_small", small).withColumn("_nl", F.sum("_n").over(by_lang))
    sizes = sizes.withColumn("_rest", small & (F.col("_nl") < min_rows))
    sizes = written(sizes, "groups")
    rest = sizes.where("_rest").agg(F.sum("_n")).first()[0] or 0
    keys = sizes.select(
        F.col("_lang").alias("_gl"), F.col("_source").alias("_gs"),
        F.when(~small, F.concat_ws("\x01", text("_lang"), text("_source")))
        .when(~F.col("_rest"), F.concat(F.lit("\x02"), text("_lang")))
        .when(F.lit(rest >= min_rows), F.lit("\x03")).alias("_g"))
    return ok.join(broadcast_small(keys), F.col("_lang").eqNullSafe(F.col("_gl"))
                   & F.col("_source").eqNullSafe(F.col("_gs"))).drop("_gl", "_gs")


def _ratios() -> list[F.Column]:
    words, chars = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1))
    return [F.col("word_chars") / words, F.col("n_symbols") / chars, F.col("n_upper") / chars,
            F.col("n_punctuation") / chars, F.col("n_dup_lines") / F.col("n_lines"),
            F.col("n_repeat_words") / words]


def _distance() -> F.Column:
    """Squared Mahalanobis distance of x0.. from the estimate (_m, _inv) of the row's group."""
    d = [F.col(f"x{i}") - F.col("_m")[i] for i in range(P)]
    return sum(F.col("_inv")[i * P + j] * d[i] * d[j] * (1 if i == j else 2)
               for i in range(P) for j in range(i, P))


_EST = "_g string, _n long, _m array<double>, _inv array<double>, _ratio double"


def _solve(batches):
    """Sums of a group -> its mean and inverse scatter."""
    for pdf in batches:
        out = []
        for r in pdf.to_dict("records"):
            n, s, q = r["w"], np.array(r["s"]), np.array(r["q"]).reshape(P, P)
            mean = s / n
            cov = (q / n - np.outer(mean, mean)) * r["scale"] + np.diag(np.square(FLOOR))
            inv = np.linalg.inv((cov + cov.T) / 2)
            out.append((r["_g"], int(r["total"]), mean.tolist(), inv.ravel().tolist(), r["ratio"]))
        yield pd.DataFrame(out, columns=["_g", "_n", "_m", "_inv", "_ratio"])


def _step(rows: DataFrame, est: DataFrame, share: float | None) -> DataFrame:
    """One concentration step (``share`` of the rows), or the reweighting (None)."""
    with_d = rows.join(est.select("_g", "_m", "_inv", "_ratio"), "_g").withColumn("_d", _distance())
    bin_ = F.floor(F.log2(F.col("_d") + F.lit(1e-9)) * BINS_PER_DOUBLING).cast("int")
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(P)] + [
        F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}")
        for i in range(P) for j in range(i, P)]
    bins = (with_d.groupBy("_g", bin_.alias("_bin"))
            .agg(F.count(F.lit(1)).alias("c"), F.max("_ratio").alias("_ratio"), *sums))
    order = Window.partitionBy("_g").orderBy("_bin")
    bins = (bins.withColumn("_to", F.sum("c").over(order))
            .withColumn("total", F.sum("c").over(Window.partitionBy("_g"))))
    top = F.pow(F.lit(2.0), (F.col("_bin") + 1) / BINS_PER_DOUBLING)
    if share is None:     # rows within the 0.975 quantile of their own scale
        keep, scale = top <= CHI_975 * F.greatest(F.col("_ratio"), F.lit(1.0)), 1.1
    else:
        keep, scale = F.col("_to") - F.col("c") < F.ceil(F.col("total") * share), 1.0
    ratio = F.min(F.when(F.col("_to") >= F.col("total") / 2, top)) / CHI_HALF
    got = (bins.groupBy("_g").agg(
        F.max("total").alias("total"), ratio.alias("ratio"),
        F.sum(F.when(keep, F.col("c"))).alias("w"),
        F.array(*[F.sum(F.when(keep, F.col(f"s{i}"))) for i in range(P)]).alias("s"),
        F.array(*[F.sum(F.when(keep, F.col(f"q{min(i, j)}_{max(i, j)}")))
                  for i in range(P) for j in range(P)]).alias("q"))
        .where(F.col("w") > 0).withColumn("scale", F.lit(scale)))
    return written(got.mapInPandas(_solve, _EST), "scatter")


def mahalanobis(table: DataFrame, share: float = 0.6, steps: int = 3,
                min_rows: int = 60) -> DataFrame:
    """(_id, _lang, _source, counts, base_failed, distance): squared robust distance,
    null where the base rules fail or no pool is large enough."""
    base = ((F.col("n_words") < 20)
            | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    table = table.withColumn("base_failed", base)
    ok = _pooled(table.where("not base_failed"), min_rows)
    raw = ok.withColumns({f"r{i}": r for i, r in enumerate(_ratios())})
    middle = raw.groupBy("_g").agg(F.count(F.lit(1)).alias("_c"), *[
        F.percentile_approx(f"r{i}", 0.5, 1000).alias(f"c{i}") for i in range(P)])
    shrink = F.sqrt(F.col("n_words") / (F.col("n_words") + SHRINK))
    middle = broadcast_small(written(middle.where("_g is not null"), "medians"))
    rows = written(raw.join(middle, "_g").select(
        "_id", "_lang", "_source", *FIELDS, "base_failed", "_g",
        *[((F.col(f"r{i}") - F.col(f"c{i}")) * shrink).alias(f"x{i}") for i in range(P)]),
        "statistics")
    start = np.diag(1 / np.square(FLOOR)).ravel().tolist()
    est = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).select(
        "_g", "_n", F.array(*[F.lit(0.0)] * P).alias("_m"),
        F.array(*map(F.lit, start)).alias("_inv"), F.lit(1.0).alias("_ratio"))
    for _ in range(steps):
        est = _step(rows, est, share)
    est = _step(rows, est, None)
    judged = rows.join(est.select("_g", "_m", "_inv"), "_g", "left").select(
        "_id", "_lang", "_source", *FIELDS, "base_failed", _distance().alias("distance"))
    rest = table.where("base_failed").select(
        "_id", "_lang", "_source", *FIELDS, "base_failed", F.lit(None).cast("double").alias("distance"))
    alone = raw.where("_g is null").select(
        "_id", "_lang", "_source", *FIELDS, "base_failed", F.lit(None).cast("double").alias("distance"))
    return judged.unionByName(rest).unionByName(alone)


def judge_quality(docs: DataFrame, cutoff: float = CUTOFF, id_col: str = "doc_id",
                  text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                  **options) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, distance) for every row."""
    table = written(statistics(docs, id_col, text_col, lang_col, source_col), "text-stats")
    far = F.coalesce(F.col("distance") > cutoff, F.lit(False))
    return mahalanobis(table, **options).select(
        F.col("_id").alias(id_col), *COUNTS, "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"), "distance")
