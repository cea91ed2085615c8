"""Model plug-ins as batch functions (E3 cross_score, E4 batch_generate, X4).

Models are not built here. A generator is registered by name with a factory
``make() -> generate(prompts: list[str], max_new_tokens: int) -> list[str]``;
a scorer with ``make() -> score(questions: list[str], texts: list[str]) -> list[float]``.
The factory runs once per Python worker and call of ``generate`` or ``cross_score``
(so two models of one name never mix), and the model is called on
Arrow batches of ``batch_size`` rows, which is where the reference's batch
sizes (512 / 128) go.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_GENERATORS: dict[str, Callable[[], Callable]] = {}
_SCORERS: dict[str, Callable[[], Callable]] = {}
_LOADED: dict[tuple[str, str, str], Callable] = {}


def register_generator(name: str, make: Callable[[], Callable[[list[str], int], list[str]]]) -> None:
    _GENERATORS[name] = make


def register_scorer(name: str, make: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> None:
    _SCORERS[name] = make


def _load(kind: str, name: str, call: str, make: Callable):
    key = (kind, name, call)
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]


def generate(prompt, name: str, max_new_tokens: int = 4, batch_size: int = 128,
             make: Callable | None = None) -> Column:
    """Prompt column -> generated text column, in batches of ``batch_size``.

    ``make`` may be given directly (it is shipped to the workers with the UDF);
    otherwise the name is looked up in the registry on the worker.
    """
    if make is None and name not in _GENERATORS:
        raise ValueError(f"unknown generator {name!r}")
    make, call = make or _GENERATORS[name], uuid.uuid4().hex

    @F.pandas_udf(T.StringType())
    def _gen(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = _load("generator", name, call, make)
        for s in batches:
            texts = s.fillna("").tolist()
            out: list[str] = []
            for i in range(0, len(texts), batch_size):
                out.extend(fn(texts[i:i + batch_size], max_new_tokens))
            yield pd.Series(out, dtype=object)

    return _gen(prompt if isinstance(prompt, Column) else F.col(prompt))


def generate_distinct(df: DataFrame, name: str, prompt: str = "prompt", out: str = "generated",
                      max_new_tokens: int = 4, batch_size: int = 128,
                      make: Callable | None = None) -> DataFrame:
    """E4 over a table: every distinct prompt is generated once, and ``out`` joins each row
    by its prompt's hash. Prompts are dealt by hash and sorted by length, so a batch holds
    prompts of similar length; equal prompts are merged before the shuffle. The generated
    texts are written below ``spark.checkpoint.dir``: a second read asks no model."""
    from ..session import scratch_path

    spark = df.sparkSession
    keyed = df.withColumn("_h", F.sha2(F.coalesce(F.col(prompt), F.lit("")), 256))
    once = (keyed.groupBy("_h").agg(F.first(F.coalesce(F.col(prompt), F.lit(""))).alias("_p"))
            .sortWithinPartitions(F.length("_p"), "_h"))
    texts = once.select("_h", generate(F.col("_p"), name, max_new_tokens, batch_size, make).alias(out))
    path = scratch_path(spark, "generated")
    texts.write.parquet(path)
    return keyed.join(spark.read.schema(texts.schema).parquet(path), "_h").drop("_h")


def cross_score(question, text, name: str, batch_size: int = 256,
                make: Callable | None = None) -> Column:
    """(question, chunk text) -> relevance score from a registered scorer."""
    if make is None and name not in _SCORERS:
        raise ValueError(f"unknown scorer {name!r}")
    make, call = make or _SCORERS[name], uuid.uuid4().hex

    @F.pandas_udf(T.DoubleType())
    def _score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        fn = _load("scorer", name, call, make)
        for q, t in batches:
            qs, ts = q.fillna("").tolist(), t.fillna("").tolist()
            out: list[float] = []
            for i in range(0, len(qs), batch_size):
                out.extend(fn(qs[i:i + batch_size], ts[i:i + batch_size]))
            yield pd.Series(out, dtype="float64")

    q = question if isinstance(question, Column) else F.col(question)
    t = text if isinstance(text, Column) else F.col(text)
    return _score(q, t)


def scorer_fn(name: str, batch_size: int = 256, make: Callable | None = None):
    """Adapter for ``RetrieverConfig.scorer``."""
    return lambda q, c: cross_score(q, c, name, batch_size, make)
