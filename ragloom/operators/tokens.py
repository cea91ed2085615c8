"""Training-set token operators.

The tokenizer is injected as a Column function ``text -> array<int>``. The
shipped default: whitespace tokens (``STRIP_CHARS`` class),
``id = int(md5(token)[0:6], 16) % vocab``, computed over Arrow batches with
a per-batch token cache (``whitespace_tokenizer``); ``whitespace_tokenizer_sql``
is the same rule in built-in expressions. Real subword tokenizers plug in
as a pandas UDF with the same shape (``batch_tokenizer``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import prompts as PR

DEFAULT_VOCAB = 50_000
IGNORE_INDEX = -100
_WS_SPLIT = "[ \\t\\n\\r\\f\\x0B]+"


def whitespace_tokenizer(vocab: int = DEFAULT_VOCAB) -> Callable[[Column], Column]:
    import hashlib
    import re

    split = re.compile(_WS_SPLIT).split

    def ids(texts: list[str]) -> list[list[int]]:
        cache: dict[str, int] = {}
        out = []
        for t in texts:
            row = []
            for w in split(t):
                if w:
                    v = cache.get(w)
                    if v is None:
                        v = cache[w] = int(hashlib.md5(w.encode("utf-8")).hexdigest()[:6], 16) % vocab
                    row.append(v)
            out.append(row)
        return out

    return batch_tokenizer(ids)


def whitespace_tokenizer_sql(vocab: int = DEFAULT_VOCAB) -> Callable[[Column], Column]:
    def tok(text: Column) -> Column:
        parts = F.filter(F.split(F.coalesce(text, F.lit("")), _WS_SPLIT), lambda x: x != F.lit(""))
        return F.transform(parts, lambda t: (F.conv(F.substring(F.md5(t), 1, 6), 16, 10)
                                             .cast("bigint") % F.lit(vocab)).cast("int"))
    return tok


def batch_tokenizer(fn: Callable[[list[str]], list[list[int]]]) -> Callable[[Column], Column]:
    """Wrap a Python batch tokenizer (list of texts -> list of id lists) as a
    Column function (Arrow UDF; the id lists go back as one flat buffer)."""
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def _tok(texts: pa.Array) -> pa.Array:
        rows = fn([t if t is not None else "" for t in texts.to_pylist()])
        offsets = np.zeros(len(rows) + 1, dtype=np.int32)
        np.cumsum([len(r) for r in rows], out=offsets[1:])
        flat = np.fromiter((x for r in rows for x in r), dtype=np.int32, count=int(offsets[-1]))
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
    return _tok


def tokenize(df: DataFrame, tokenizer=None, text_col: str = "prompt") -> DataFrame:
    """D3 part 1: ``input_ids`` and ``attention_mask`` (all ones)."""
    tok = tokenizer or whitespace_tokenizer()
    return (df.withColumn("input_ids", tok(F.col(text_col)))
            .withColumn("attention_mask", F.transform("input_ids", lambda x: F.lit(1))))


def max_token_length(df: DataFrame, context_length: int, ids: str = "input_ids") -> DataFrame:
    """A4: one row, ``max_length = min(longest prompt, context_length)``."""
    return df.agg(F.least(F.max(F.size(ids)), F.lit(context_length)).alias("max_length"))


def truncate_left(df: DataFrame, max_length: Column | int, ids: str = "input_ids",
                  mask: str = "attention_mask") -> DataFrame:
    """D3 part 2 (H14): keep the last ``max_length`` tokens."""
    m = F.lit(max_length) if isinstance(max_length, int) else max_length
    keep = F.least(m, F.size(ids))
    out = df.withColumn(ids, F.when(keep > 0, F.slice(ids, -keep, keep))
                        .otherwise(F.array().cast("array<int>")))
    if mask in df.columns:
        out = out.withColumn(mask, F.transform(ids, lambda x: F.lit(1)))
    return out


def tokenize_truncate(df: DataFrame, context_length: int, tokenizer=None,
                      text_col: str = "prompt", materialize: bool = True) -> DataFrame:
    """D3: tokenize, then truncate all rows to min(longest, context_length).

    The global maximum is one aggregate (partial max per task, one value to
    the driver) and is then applied as a literal. The tokenized table is
    checkpointed first (shared ``spark.checkpoint.dir``) so the upstream
    retrieval and prompt building run once, not once per pass.
    """
    tok = tokenize(df, tokenizer, text_col)
    if materialize:
        from ..session import ensure_checkpoint_dir

        ensure_checkpoint_dir(df.sparkSession)
        tok = tok.checkpoint(eager=True)
    ml = max_token_length(tok, context_length).first()["max_length"]
    return truncate_left(tok, int(ml or 0))


def copy_labels(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    """``labels = input_ids``."""
    return df.withColumn("labels", F.col(ids))


def completion_mask(df: DataFrame, marker_ids: list[int], labels: str = "labels") -> DataFrame:
    """Labels up to and including the first response marker become -100;
    no marker -> every label is -100.

    The marker is found by a string search over the comma-joined ids (no
    per-position lambda), and the mask is ``array_repeat`` + ``slice``.
    """
    lab = F.col(labels)
    m = len(marker_ids)
    if m == 0:
        return df.withColumn(labels, F.array_repeat(F.lit(IGNORE_INDEX), F.size(lab)))
    joined = F.concat(F.lit(","), F.array_join(lab, ","), F.lit(","))
    at = F.instr(joined, "," + ",".join(str(int(x)) for x in marker_ids) + ",")
    head = F.substring(joined, 1, at)
    pos = F.length(head) - F.length(F.replace(head, F.lit(","), F.lit("")))  # 1-based token index
    end = pos - 1 + F.lit(m)
    masked = F.when(at == 0, F.array_repeat(F.lit(IGNORE_INDEX), F.size(lab))).otherwise(
        F.concat(F.array_repeat(F.lit(IGNORE_INDEX), end),
                 F.slice(lab, end + 1, F.greatest(F.size(lab) - end, F.lit(0)))))
    return df.withColumn(labels, masked)


def _marker_starts(lab: Column, marker: list[int]) -> Column:
    """0-based places at which ``marker`` begins, in ascending order."""
    want = F.array(*[F.lit(int(x)) for x in marker])
    last = F.size(lab) - len(marker)
    none = F.array().cast("array<int>")
    if not marker:
        return none
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                                      lambda i: F.slice(lab, i + 1, len(marker)) == want)).otherwise(none)


def turn_mask(df: DataFrame, response_ids: list[int], instruction_ids: list[int],
              labels: str = "labels") -> DataFrame:
    """D5 with both markers: labels from each instruction marker to the end of the
    response marker after it become -100, so only responses count; a row that lacks
    either marker is masked whole (left truncation may have cut the first one).

    Built-in expressions only: places of both markers, paired in order (the first pair
    begins at the row's start), and a fold that counts, token by token, the spans that
    begin and end there. Rows are bounded by the context length."""
    lab = F.col(labels).cast("array<int>")
    starts, asked = _marker_starts(lab, response_ids), _marker_starts(lab, instruction_ids)
    ends = F.transform(starts, lambda i: i + len(response_ids))
    one = F.array(F.lit(0))
    asks = F.when(F.get(asked, F.lit(0)) > F.get(starts, F.lit(0)), F.concat(one, asked)).otherwise(asked)
    masked = F.transform(lab, lambda x: F.lit(IGNORE_INDEX))
    row = F.struct(lab.alias("x"), asks.alias("a"), ends.alias("e"))

    def spans(r):
        pairs = F.least(F.size(r["a"]), F.size(r["e"]))
        paired = F.transform(F.sequence(F.lit(0), pairs - 1), lambda i: F.struct(
            F.when(i == 0, 0).otherwise(F.get(r["a"], i)).alias("lo"), F.get(r["e"], i).alias("hi")))
        open_ = F.struct(F.element_at(r["a"], -1).alias("lo"), F.size(r["x"]).alias("hi"))
        return F.when(F.size(r["e"]) < F.size(r["a"]), F.concat(paired, F.array(open_))).otherwise(paired)

    def mask(r):
        inside = F.transform(F.array(spans(r)), lambda s: F.transform(
            r["x"], lambda x, i: F.when(F.exists(s, lambda p: (p["lo"] <= i) & (i < p["hi"])),
                                        IGNORE_INDEX).otherwise(x)))
        return F.get(inside, F.lit(0))

    # arrays of one element name a value once, so that no place list is computed twice
    out = F.get(F.transform(F.array(row), mask), F.lit(0))
    found = (F.size(starts) > 0) & (F.size(asked) > 0)
    return df.withColumn(labels, F.when(F.col(labels).isNull(), F.lit(None)).when(found, out)
                         .otherwise(masked).cast("array<int>"))


def instruction_marker_ids(spark, tokenizer=None) -> list[int]:
    """Token ids of the instruction marker."""
    return response_marker_ids(spark, tokenizer, PR.INSTRUCTIONS_TAG)


def response_marker_ids(spark, tokenizer=None, marker: str = PR.ANSWER_TAG) -> list[int]:
    """Token ids of the response marker (one tiny job, one row to the driver)."""
    tok = tokenizer or whitespace_tokenizer()
    row = spark.range(1).select(tok(F.lit(marker)).alias("ids")).first()
    return [int(x) for x in (row["ids"] or [])]
