"""Benchmark decontamination: BM25 retrieval with block-max WAND, then overlap.

The benchmark's items are the documents of an inverted index, cut into shards of
at most ``SHARD_ITEMS`` items so that what a task holds is bounded; every training
passage is a query. Passages are windows of 2 S words every S words, S at least the
longest item, so an item in a text lies whole in one window. A score is a share of the
item's score against itself; each item's threshold is the least share that a passage
which passes verification can have (``least_share``), so retrieval loses no hit.
Impacts are divided by it, and one bound serves all items. Per batch, block maxima (blocks of ``BLOCK_ITEMS`` items, kept only where a term occurs) give each
window's best possible score; windows that could reach the threshold are run
through document-at-a-time block-max WAND, which returns every item above it.

A hit is verified on the words themselves: five-word shingles of the passage must
cover at least ``overlap`` of the item's words, in its question (first two thirds)
and in its answer (the rest) alike.

Defined results: words are runs of letters, digits and underscores, lower-cased;
null and wordless texts and items match nothing; items of fewer than five words
match as a whole; repeated rows and ids give one row per document id and item id;
an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

SHARD_ITEMS, BLOCK_ITEMS = 4096, 8
K1, B = 1.2, 0.75
OVERLAP = 0.8
SHINGLE = 5
MIN_STRIDE = 64
#: (window, block) sums that are held at once.
CHUNK = 1 << 20
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Index:
    """Postings by term id, ascending item numbers; an impact is a share of the item's
    self score, divided by the share ``need`` that a verified passage has at least."""

    items: list
    item_words: list[list[str]]
    terms: dict[str, int]
    postings: list[tuple[list[int], list[float]]]
    need: np.ndarray
    blocks: int
    block_at: np.ndarray       # a term's block maxima begin here in the next two
    block_no: np.ndarray
    block_max: np.ndarray
    stride: int

    def maxima(self, term: int) -> dict[int, float]:
        part = slice(self.block_at[term], self.block_at[term + 1])
        return dict(zip(self.block_no[part].tolist(), self.block_max[part].tolist()))


def least_share(item: list[str], share: dict[str, float], overlap: float) -> float:
    """A lower bound of the self score's share that a passage holds if it covers
    ``overlap`` of the item's question and answer.

    A term is lost only if all its places are uncovered, so its share is dealt out over
    them; the places that may be uncovered in each part take the largest ones."""
    count = Counter(item)
    value = np.array([share[w] / count[w] for w in item])
    cut = question_length(item)
    lost = 0.0
    for part in (value[:cut], value[cut:]):
        free = int((1 - overlap) * len(part) + 1e-9)
        lost += np.sort(part)[len(part) - free:].sum()
    return max(1.0 - lost, 0.0)


def question_length(item: list[str]) -> int:
    return -(-2 * len(item) // 3)


def build_index(items: list[tuple], overlap: float = OVERLAP) -> Index | None:
    """``items``: (id, text). None if no item has a word."""
    rows = [(i, w) for i, t in items if (w := words(t or ""))]
    if not rows:
        return None
    n, mean = len(rows), sum(len(w) for _, w in rows) / len(rows)
    post: dict[str, list[tuple[int, int]]] = {}
    for k, (_, w) in enumerate(rows):
        count: dict[str, int] = {}
        for x in w:
            count[x] = count.get(x, 0) + 1
        for x, tf in count.items():
            post.setdefault(x, []).append((k, tf))
    impact = {x: [(k, np.log1p((n - len(p) + 0.5) / (len(p) + 0.5)) * tf * (K1 + 1)
                   / (tf + K1 * (1 - B + B * len(rows[k][1]) / mean))) for k, tf in p]
              for x, p in post.items()}
    own = np.zeros(n)
    for p in impact.values():
        for k, w in p:
            own[k] += w
    shares: list[dict[str, float]] = [{} for _ in rows]
    for x, p in impact.items():
        for k, w in p:
            shares[k][x] = w / own[k]
    # above zero, so that a passage without any of the item's words is never a candidate
    need = np.array([max(least_share(w, shares[k], overlap), 1e-6) for k, (_, w) in enumerate(rows)])
    terms = {x: i for i, x in enumerate(impact)}
    postings, numbers, tops = [], [], []
    for p in impact.values():
        at = np.array([k for k, _ in p])
        share = np.array([w for _, w in p]) / own[at] / need[at]
        postings.append((at.tolist(), share.tolist()))
        begin = np.flatnonzero(np.diff(at // BLOCK_ITEMS, prepend=-1))
        numbers.append(at[begin] // BLOCK_ITEMS)
        tops.append(np.maximum.reduceat(share, begin))
    return Index([i for i, _ in rows], [w for _, w in rows], terms, postings, need,
                 -(-n // BLOCK_ITEMS), np.cumsum([0, *map(len, numbers)]),
                 np.concatenate(numbers), np.concatenate(tops),
                 max(MIN_STRIDE, max(len(w) for _, w in rows)))


def block_max_wand(index: Index, query: list[int], theta: float) -> list[tuple[int, float]]:
    """All (item number, score) with score >= theta for distinct term ids ``query``."""
    lists = [[*index.postings[t], 0, index.maxima(t), max(index.postings[t][1])]
             for t in query]
    out = []
    while lists:
        lists.sort(key=lambda p: p[0][p[2]])
        bound, pivot = 0.0, -1
        for i, p in enumerate(lists):
            bound += p[4]
            if bound >= theta:
                pivot = i
                break
        if pivot < 0:
            break
        item = lists[pivot][0][lists[pivot][2]]
        while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][2]] == item:
            pivot += 1
        block = item // BLOCK_ITEMS
        if sum(p[3].get(block, 0.0) for p in lists[:pivot + 1]) < theta:
            # no item before the block's end, or before the next list begins, can do it
            goal = (block + 1) * BLOCK_ITEMS
            if pivot + 1 < len(lists):
                goal = min(goal, lists[pivot + 1][0][lists[pivot + 1][2]])
            goal = max(goal, item + 1)
            moved = lists[:pivot + 1]
        elif lists[0][0][lists[0][2]] == item:
            score = sum(p[1][p[2]] for p in lists[:pivot + 1])
            if score >= theta:
                out.append((item, score))
            goal, moved = item + 1, lists[:pivot + 1]
        else:
            goal, moved = item, [p for p in lists[:pivot] if p[0][p[2]] < item]
        for p in moved:
            p[2] = bisect_left(p[0], goal, p[2])
        lists = [p for p in lists if p[2] < len(p[0])]
    return out


def covered(item: list[str], passage: list[str]) -> float:
    """The lesser share of the question's and the answer's words that lie in common shingles."""
    k = min(SHINGLE, len(item))
    there = {tuple(passage[i:i + k]) for i in range(len(passage) - k + 1)}
    mark = np.zeros(len(item), bool)
    for i in range(len(item) - k + 1):
        if tuple(item[i:i + k]) in there:
            mark[i:i + k] = True
    cut = question_length(item)
    return float(min(mark[:cut].mean(), mark[cut:].mean() if cut < len(item) else 1.0))


def search(index: Index, texts: list[bytes], overlap: float):
    """(text number, item number, score, overlap) of verified hits, windows apart."""
    theta = 1 - 1e-9
    get, stride, width = index.terms.get, index.stride, len(index.terms)
    every, doc, place, base, first = [], [], [], 0, []
    for i, t in enumerate(texts):
        w = words(t.decode("utf-8", "replace"))
        every.append(w)
        ids = np.array([get(x, -1) for x in w], np.int64)
        at = np.flatnonzero(ids >= 0)
        window = at // stride
        place.append(np.concatenate([(window + base) * width + ids[at],
                                     (window[window > 0] + base - 1) * width + ids[at][window > 0]]))
        windows = max(1, -(-len(w) // stride))
        first.append(base)
        base += windows
    if not base:
        return
    key = np.unique(np.concatenate(place))
    window, term = key // width, key % width
    begins = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]])) if len(key) else []
    first = np.array(first)
    ends = np.append(begins, len(key))
    entries = np.concatenate([[0], np.cumsum(np.diff(index.block_at)[term])])
    step = max(1, CHUNK // index.blocks)
    at = 0
    while at < len(begins):
        # so many windows that neither their sums nor their entries pass the bound
        stop = int(np.searchsorted(entries[ends[1:]], entries[ends[at]] + CHUNK, "right"))
        stop = max(at + 1, min(stop, at + step, len(begins)))
        lo, hi = ends[at], ends[stop]
        many = np.diff(entries[lo:hi + 1])
        from_ = np.repeat(index.block_at[term[lo:hi]] - (entries[lo:hi] - entries[lo]), many)
        entry = from_ + np.arange(len(from_))
        row = np.repeat(np.repeat(np.arange(stop - at), np.diff(ends[at:stop + 1])), many)
        bound = np.bincount(row * index.blocks + index.block_no[entry], index.block_max[entry],
                            (stop - at) * index.blocks).reshape(stop - at, index.blocks)
        for k in np.flatnonzero(bound.max(1) >= theta):
            b, e = ends[at + k], ends[at + k + 1]
            n = int(np.searchsorted(first, window[b], "right")) - 1
            start = int(window[b] - first[n]) * stride
            passage = every[n][start:start + 2 * stride]
            for item, score in block_max_wand(index, term[b:e].tolist(), theta):
                got = covered(index.item_words[item], passage)
                if got >= overlap:
                    yield n, item, min(score * float(index.need[item]), 1.0), got
        at = stop


def leaks(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP,
          id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text") -> DataFrame:
    """(id, item id, score, overlap): documents with a passage that repeats an item."""
    items = benchmark.select(F.col(item_col).alias("_item"), F.col(item_text_col).alias("_words")
                             ).where("_words is not null").distinct()
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, score double, overlap double"
    sc = docs.sparkSession.sparkContext
    n = items.count()
    shard = F.pmod(F.xxhash64("_item", "_words"), F.lit(max(1, -(-n // SHARD_ITEMS))))
    found = None
    for s in range(max(1, -(-n // SHARD_ITEMS))):
        rows = items.where(shard == s).orderBy("_item", "_words").collect()  # one bounded shard
        index = sc.broadcast(build_index([tuple(r) for r in rows], overlap))

        def run(batches, index=index):
            for rows, texts in slices(batches, text_col):
                if index.value is None:
                    return
                hits = list(search(index.value, texts, overlap))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array([h[0] for h in hits], pa.int64())),
                     pa.array([index.value.items[h[1]] for h in hits], items_type),
                     pa.array([h[2] for h in hits], pa.float64()),
                     pa.array([h[3] for h in hits], pa.float64())],
                    names=[id_col, item_col, "score", "overlap"])

        from pyspark.sql.pandas.types import to_arrow_type

        items_type = to_arrow_type(benchmark.schema[item_col].dataType)
        part = docs.select(id_col, text_col).mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found.groupBy(id_col, item_col).agg(F.max("score").alias("score"),
                                               F.max("overlap").alias("overlap"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                   **options) -> DataFrame:
    """The documents without any leak. Rows that share an id, a null one too, go together."""
    gone = written(leaks(docs, benchmark, id_col=id_col, **options)
                   .select(F.col(id_col).alias("_gone")).distinct(), "leaks")
    few = gone.count() <= 1_000_000     # 16 MB; more are joined by a shuffle
    return docs.join(F.broadcast(gone) if few else gone, docs[id_col].eqNullSafe(gone["_gone"]),
                     "left_anti")
