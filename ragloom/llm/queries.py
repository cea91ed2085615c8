"""One thin query per operator over the driver's tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, jaccard_join, langid, packing, quality_model, quality_rules, repair,
               token_counts, toxicity, url_rules, wavelet, whitening, wrapper)
from .common import remainder

#: Fixed values of the URL query: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"),
             ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
             ("net", "/fr/", "block")]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _held_out(mod: int, value: int):
    return F.coalesce(remainder("doc_id", mod) == value, F.lit(False))


def op1_quality_model(spark, sf):
    scored = quality_model.score_quality(_t(spark, sf, "documents"), _t(spark, sf, "labels"),
                                         remainder("doc_id", 5) != 0)
    return scored.select("doc_id", _held_out(5, 0).alias("held_out"), "score", "predicted")


def op2_url_rules(spark, sf):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(_t(spark, sf, "pages"), rules)


def op3_main_text(spark, sf):
    return wrapper.main_text(_t(spark, sf, "pages"))


def op4_best_fit_packing(spark, sf):
    return packing.pack(_t(spark, sf, "documents"))


def op5_language_id(spark, sf):
    docs = _t(spark, sf, "documents")
    bundles = langid.profiles(docs.where(remainder("doc_id", 4) != 2))
    found = langid.identify(docs, bundles, ["doc_id"])
    return found.select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op6_toxicity(spark, sf):
    scored = toxicity.score_toxicity(_t(spark, sf, "documents"), _t(spark, sf, "labels"),
                                     remainder("doc_id", 4) != 2)
    return scored.select("doc_id", _held_out(4, 2).alias("held_out"), "score", "predicted")


def op7_benchmark_leaks(spark, sf):
    return decontaminate.leaks(_t(spark, sf, "documents"), _t(spark, sf, "benchmark"))


def op8_wavelet_tokens(spark, sf):
    return wavelet.token_files(_t(spark, sf, "documents"))


def op9_ngram_jaccard(spark, sf):
    return jaccard_join.similar_groups(_t(spark, sf, "documents"))


def op10_quality_rules(spark, sf):
    return quality_rules.judge_quality(_t(spark, sf, "documents"))


def op11_conversation_repair(spark, sf):
    turns = _t(spark, sf, "conversations")
    return repair.repair(repair.damaged(turns), turns)


def op12_whitening(spark, sf):
    return whitening.whiten(_t(spark, sf, "embeddings"))


def op13_token_counts(spark, sf):
    return token_counts.count_tokens(_t(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_model, op2_url_rules, op3_main_text, op4_best_fit_packing, op5_language_id,
    op6_toxicity, op7_benchmark_leaks, op8_wavelet_tokens, op9_ngram_jaccard, op10_quality_rules,
    op11_conversation_repair, op12_whitening, op13_token_counts)}

SQL = {
    "op2_url_rules": r"""
WITH rules(rhost, rpath, verdict) AS (VALUES
    ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
    ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (
  SELECT page_id, url, row_number() OVER () AS rid,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
parts AS (
  SELECT page_id, rid,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut),
fits AS (
  SELECT rid, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC,
                            length(rhost) DESC) AS k
  FROM parts JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (rid)
""",
}
