"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1/-1 drawn from its code point; an n-gram
is the product (binding) of its letters' vectors, each rotated (permuted) by its
place; a text is the sum (bundle) of its n-grams, a language the bundle of its
labelled texts. A text goes to the language whose bundle has the largest cosine
with it.

A text's dot product with a bundle is the sum of its n-grams' dot products, and
its own length is the same for all languages, so tasks look n-grams up instead
of building a vector per text; the result is the same. Tasks bundle their own
labelled texts and only those vectors are shuffled: languages x ``DIM`` numbers
a task, summed in two levels.

Defined results: letters are Unicode letters, lower-cased; everything between
letters is one word break; a null text, a text without letters, or no labelled
text at all gives ``und`` with score 0. The score is the best cosine's share of
the two best, 0.5 to 1 (1 if there is one language). Ties go to the language that
sorts first. Repeated rows are each kept; a null id is not held out and not
learned from; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, map_texts, slices

DIM = 2048
SEED = 11
UNKNOWN = "und"
#: n-grams handled at once when vectors are built.
CHUNK = 4096
#: Letter vectors kept in a worker process (2 KB each); letters beyond are made anew.
KEPT_VECTORS = 4096
_STATE: dict = {}


def _letters() -> np.ndarray:
    claim("langid", _STATE.clear)
    if "alpha" not in _STATE:
        _STATE["alpha"] = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _STATE["alpha"]


def _vector(code: int, dim: int) -> np.ndarray:
    """The letter's vector; 0 is the word break."""
    key = (code, dim)
    vec = _STATE.get(key)
    if vec is None:
        rng = np.random.default_rng([SEED, code])
        vec = (rng.integers(0, 2, dim, dtype=np.int8) * 2 - 1).astype(np.int8)
        if len(_STATE) <= KEPT_VECTORS:
            _STATE[key] = vec
    return vec


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct trigrams as rows of code points, index per occurrence, its text)."""
    parts = [t.decode("utf-8", "replace").replace("\0", " ") for t in texts]
    joined = "\0".join(f" {p.lower()} " for p in parts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.cumsum(code == 0)
    code = np.where(_letters()[code], code, 0)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (doc[1:] != doc[:-1])
    code, doc = code[keep], doc[keep]
    if len(code) < 3:
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = np.zeros(0x110000, bool)
    seen[code] = True
    alphabet = np.flatnonzero(seen)
    place = np.zeros(0x110000, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    s, a = place[code], len(alphabet)
    whole = doc[2:] == doc[:-2]
    key = ((s[:-2] * a + s[1:-1]) * a + s[2:])[whole]
    if a ** 3 <= 1 << 23:
        there = np.zeros(a ** 3, bool)
        there[key] = True
        found = np.flatnonzero(there)
        index = np.zeros(a ** 3, np.int64)
        index[found] = np.arange(len(found))
        index = index[key]
    else:
        found, index = np.unique(key, return_inverse=True)
    rows = np.stack([alphabet[found // (a * a)], alphabet[found // a % a], alphabet[found % a]], 1)
    return rows, index, doc[2:][whole]


def bound(rows: np.ndarray, dim: int):
    """n-gram vectors, ``CHUNK`` rows at a time: (first row, int8 array)."""
    if not len(rows):
        return
    alphabet, place = np.unique(rows, return_inverse=True)
    place = place.reshape(rows.shape)
    base = np.stack([_vector(int(c), dim) for c in alphabet])
    second, third = np.roll(base, 1, 1), np.roll(base, 2, 1)
    for at in range(0, len(rows), CHUNK):
        p = place[at:at + CHUNK]
        yield at, third[p[:, 0]] * second[p[:, 1]] * base[p[:, 2]]


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.asarray(v, float) for v in pdf["vec"]], axis=0)
    return pd.DataFrame({"_lang": [pdf["_lang"].iloc[0]], "vec": [total.tolist()]})


def profiles(labelled: DataFrame, dim: int = DIM, text_col: str = "text",
             lang_col: str = "lang") -> dict[str, np.ndarray]:
    """language -> bundle of its texts, each weighted by 1 / sqrt(its n-grams)."""
    src = labelled.select(F.col(lang_col).cast("string").alias("_lang"),
                          F.col(text_col).alias("text")).where("_lang is not null and text is not null")

    def run(batches):
        from pyspark import TaskContext

        sums: dict[str, np.ndarray] = {}
        for rows, texts in slices(batches):
            tri, index, doc = grams(texts)
            names, lang = np.unique(np.array(rows.column(0).to_pylist(), object).astype(str),
                                    return_inverse=True)
            if not len(tri):
                continue
            weight = 1 / np.sqrt(np.maximum(np.bincount(doc, minlength=len(texts)), 1))
            counts = np.bincount(lang[doc] * len(tri) + index, weight[doc],
                                 len(names) * len(tri)).reshape(len(names), -1)
            for at, vectors in bound(tri, dim):
                more = counts[:, at:at + len(vectors)] @ vectors.astype(np.float32)
                for name, v in zip(names, more):
                    sums[name] = sums.get(name, 0) + v
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([task % 64] * len(sums), pa.int32()),
             pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
            names=["_lang", "_part", "vec"])

    kind = "_lang string, vec array<double>"
    got = (src.mapInArrow(run, "_lang string, _part int, vec array<double>")
           .groupBy("_lang", "_part").applyInPandas(lambda k, p: _add(p), kind)
           .groupBy("_lang").applyInPandas(lambda k, p: _add(p), kind))
    # one vector a language
    return {r["_lang"]: np.array(r["vec"]) for r in got.collect()}


def identify(docs: DataFrame, bundles: dict[str, np.ndarray], keep: list[str] | None = None,
             text_col: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred and score for every row."""
    names = sorted(bundles)
    matrix = (np.stack([bundles[n] / max(np.linalg.norm(bundles[n]), 1e-12) for n in names], 1)
              .astype(np.float32) if names else np.zeros((DIM, 0), np.float32))
    dim = len(matrix)
    keep = [c for c in (keep if keep is not None else docs.columns) if c != text_col]

    def run(rows, texts):
        tri, index, doc = grams(texts)
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if len(tri) and names:
            table = np.empty((len(tri), len(names)), np.float32)
            for at, vectors in bound(tri, dim):
                table[at:at + len(vectors)] = vectors.astype(np.float32) @ matrix
            dots = np.stack([np.bincount(doc, table[index, k], len(texts))
                             for k in range(len(names))], 1)
            best = dots.argmax(1)
            first = np.maximum(dots.max(1), 1e-9)
            dots[np.arange(len(texts)), best] = -np.inf
            other = np.maximum(dots.max(1), 0.0)
            found = np.bincount(doc, minlength=len(texts)) > 0
            lang = [names[b] if ok else UNKNOWN for b, ok in zip(best, found)]
            score = np.where(found, first / (first + other), 0.0)
        return [*rows.columns[:len(keep)], lang, score]

    kept = docs.select(*keep, text_col).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields[:-1])
    return map_texts(docs, keep, run, fields + ", lang_pred string, score double", text_col)
