"""Column functions on text. All are built-in Spark expressions (JVM side,
no Python worker), so they stay inside whole-stage codegen where Spark can.

Whitespace: the reference strips with Python ``str.strip()``. Spark's
``trim`` strips spaces only and ``\\s`` differs between Java and RE2, so the
library uses one explicit class everywhere: space, tab, LF, CR, FF, VT.
Other Unicode spaces (NBSP and the like) are kept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the whitespace class used for every strip.
STRIP_CHARS = " \t\n\r\f\x0b"

# Chat markers the document compressor deletes from generated text.
SPECIAL_TOKENS = ("</s>", "<|system|>", "<|ed|>", "<|eot_id|>", "<|assistant|>")

# File-name prefix that carries a release number, and its tag text.
RELEASE_PREFIX = "rel_"
RELEASE_TAG = "3GPP Release "

# Word tokens: maximal runs of Unicode letters and digits (same in Java and RE2).
WORD_SPLIT_PATTERN = r"[^\p{L}\p{N}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python-style strip restricted to ``STRIP_CHARS``."""
    return F.btrim(_col(c), F.lit(STRIP_CHARS))


def basename(path) -> Column:
    """``a/b/c.docx`` -> ``c.docx`` (also strips a ``file:`` URI scheme's folders)."""
    return F.element_at(F.split(_col(path), "/"), -1)


def release_year(source, prefix: str = RELEASE_PREFIX) -> Column:
    """``rel_<n>.<ext>`` -> n; NULL if no prefix or if n is not an int."""
    s = _col(source)
    num = F.btrim(F.split_part(F.split_part(s, F.lit("_"), F.lit(2)), F.lit("."), F.lit(1)),
                  F.lit(STRIP_CHARS))
    return F.when(s.startswith(prefix), num.try_cast("int"))


def release_tag(year, template: str = RELEASE_TAG) -> Column:
    """Year -> ``3GPP Release <n>``; NULL when year is NULL."""
    return F.concat(F.lit(template), _col(year).cast("string"))


def line_list(text) -> Column:
    """Text -> array of stripped, non-empty lines (order kept)."""
    return F.filter(F.transform(F.split(_col(text), "\n"), strip), lambda x: x != F.lit(""))


def strip_special_tokens(text, tokens=SPECIAL_TOKENS) -> Column:
    """Delete each literal marker, in order."""
    out = _col(text)
    for t in tokens:
        out = F.replace(out, F.lit(t), F.lit(""))
    return out


def stop_truncate(text, stops) -> Column:
    """Keep the text before the first occurrence of each stop string,
    applied in the given order, then strip."""
    out = _col(text)
    for s in stops:
        out = F.split_part(out, F.lit(s), F.lit(1))
    return strip(out)


def question_number(key) -> Column:
    """``"question 12"`` -> ``"12"`` (second space-separated field, stripped)."""
    return strip(F.split_part(_col(key), F.lit(" "), F.lit(2)))


def option_entries(record) -> Column:
    """Entries of a MAP<STRING,STRING> whose key starts with ``option``, in map order."""
    return F.filter(F.map_entries(_col(record)), lambda e: e["key"].startswith("option"))


def answer_parse(text) -> Column:
    """Last character before the first ``:`` (whole text if none), stripped."""
    return strip(F.right(F.split_part(F.coalesce(_col(text), F.lit("")), F.lit(":"), F.lit(1)),
                         F.lit(1)))


def words(text) -> Column:
    """Lower-cased word tokens (letters and digits), empty strings removed."""
    return F.filter(F.split(F.lower(_col(text)), WORD_SPLIT_PATTERN), lambda x: x != F.lit(""))


def newline_to_period(text) -> Column:
    """Every ``\\n`` becomes ``". "``."""
    return F.replace(_col(text), F.lit("\n"), F.lit(". "))
