"""URL rules by hashed host-suffix and path-prefix expressions.

Each URL is expanded into the expressions that some rule could have: host
suffixes of the label counts and path prefixes of the lengths that occur among
the rules. Expressions and rules meet by an equi-join on a short prefix of their
SHA-256; the full digest is confirmed after it, and of the rules that fit a URL
the longest wins (then the longer host, then block). Plain DataFrame functions
throughout; one verdict per distinct (host, path), joined back to the rows.

Defined results: a null URL or one without ``://`` has empty host and path; a URL
that no rule fits gets ``default`` and a null rule; repeated rows and ids are
each kept; no rules means ``default`` everywhere; an empty table gives no rows;
columns besides the id and the URL are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of the digest prefix on which URLs and rules are joined.
PREFIX_DIGITS = 8


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _labels(host: F.Column) -> F.Column:
    return F.size(F.split(host, r"\."))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id",
               url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``.

    ``rules``: (host, path, verdict); a rule fits its host and all subdomains if
    the URL's path starts with the rule's path."""
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rules = rules.select(F.concat("host", "path").alias("rule"), "verdict",
                         F.length("host").alias("r_host"), _labels(F.col("host")).alias("r_labels"),
                         F.length("path").alias("r_path"))
    # (label count, path length) pairs among the rules; they don't grow with the URLs
    shapes = sorted(tuple(r) for r in rules.select("r_labels", "r_path").distinct().collect())
    if not shapes:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    rules = rules.withColumn("digest", F.sha2("rule", 256)).withColumn(
        "short", F.substring("digest", 1, PREFIX_DIGITS))
    h, p = F.col("host"), F.col("path")
    expressions = F.filter(F.array(*[
        F.when((_labels(h) >= n) & (F.length(p) >= m),
               F.concat(F.substring_index(h, ".", -n), F.substring(p, 1, m)))
        for n, m in shapes]), lambda e: e.isNotNull())
    wins = F.struct((F.length("rule")).alias("len"), "r_host",
                    (F.col("verdict") == "block").alias("b"), "rule")
    verdicts = (urls.select("host", "path").distinct()
                .select("host", "path", F.explode(expressions).alias("expression"))
                .withColumn("full", F.sha2("expression", 256))
                .join(rules, F.substring("full", 1, PREFIX_DIGITS) == F.col("short"))
                .where(F.col("full") == F.col("digest"))
                .groupBy("host", "path")
                .agg(F.max(F.struct(wins.alias("order"), "rule", "verdict")).alias("best"))
                .select("host", "path", "best.rule", "best.verdict"))
    return (urls.join(verdicts, ["host", "path"], "left")
            .select(id_col, "host", "path", "rule",
                    F.coalesce("verdict", F.lit(default)).alias("verdict")))
