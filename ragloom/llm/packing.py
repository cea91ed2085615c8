"""Best-fit packing by a linear grouping scheme.

Documents become pieces of at most ``capacity`` tokens; how many pieces have
each length is a table of at most ``capacity`` numbers, whatever the corpus.
From it the driver makes a plan: pieces longer than ``epsilon * capacity`` are
ranked by length and cut into ``groups`` groups of equal cardinality, each
rounded up to its longest piece; sequences are configurations of those few
sizes, chosen one after another as the fullest one around the largest size that
is left; then each slot gets actual pieces by rank, and the short pieces go best
fit into what really remains free. The plan is a list of rules "pieces of length
L with ranks [a, b) go to sequences from s on, at offset o", its size depends on
``capacity`` and ``groups`` only, and every task applies it to its own pieces.

Defined results: a null text is empty and is one piece, the end id; repeated
rows are packed as often as they occur; an empty table gives no rows; columns
besides the id and the text are ignored. Ties of length are ranked by id and
piece; which of several equal rows comes first does not matter.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import row_index
from . import tokenize as T
from .common import map_texts, written

PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str,
           text_col: str) -> DataFrame:
    """One row per piece, without the ids themselves."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(rows, texts):
        ids = T.encoder(tokenizer).ids(texts)
        take, piece, start, length, crc = [], [], [], [], []
        for i, raw in enumerate(ids):
            raw += end
            n = len(raw) // 4
            k = -(-n // capacity)
            first = n - (k - 1) * capacity
            at = 0
            for j in range(k):
                m = capacity if j else first
                take.append(i)
                piece.append(j)
                start.append(at)
                length.append(m)
                crc.append(zlib.crc32(raw[4 * at:4 * (at + m)]))
                at += m
        return [rows.column(0).take(pa.array(take, pa.int64())), piece, start, length, crc]

    return map_texts(docs, [id_col], cut, PIECES.format(kind).replace("doc_id", id_col, 1), text_col)


def _fullest(sizes: list[int], counts: list[int], room: int) -> Counter:
    """Which further pieces fill ``room`` best: bounded subset sums as bit masks."""
    reach, steps, goal = 1, [], 1 << room
    keep = (1 << (room + 1)) - 1
    for k, (s, c) in enumerate(zip(sizes, counts)):
        for _ in range(min(c, room // s)):
            more = (reach | (reach << s)) & keep
            if more == reach:
                break
            steps.append((k, s, reach))
            reach = more
            if reach & goal:
                break
        if reach & goal:
            break
    at, used = reach.bit_length() - 1, Counter()
    for k, s, before in reversed(steps):
        if not before >> at & 1:
            used[k] += 1
            at -= s
    return used


def plan(counts: dict[int, int], capacity: int, epsilon: float = 0.25, groups: int = 1024):
    """(rules, number of sequences). A rule is (length, first rank, last rank + 1,
    first sequence, offset); ranks are within the pieces of that length."""
    rules: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}
    bins = 0
    large = sorted((n for n in counts if n > epsilon * capacity and counts[n]), reverse=True)
    total = sum(counts[n] for n in large)
    edges, at = [], 0              # ranks of the large pieces at which the length changes
    for n in large:
        edges.append((at, at + counts[n], n))
        at += counts[n]
    starts = np.array([e[0] for e in edges] or [0])
    per = max(1, -(-total // groups))
    sizes, spans = [], []          # a size and the ranks that are rounded up to it
    for lo in range(0, total, per):
        n = edges[int(np.searchsorted(starts, lo, "right")) - 1][2]
        hi = min(total, lo + per)
        if sizes and sizes[-1] == n:
            spans[-1][1] = hi
        else:
            sizes.append(n)
            spans.append([lo, hi])
    left = [hi - lo for lo, hi in spans]
    k = 0
    while k < len(sizes):
        if not left[k]:
            k += 1
            continue
        left[k] -= 1
        use = _fullest(sizes[k:], left[k:], capacity - sizes[k])
        left[k] += 1
        use = Counter({k + j: m for j, m in use.items()})
        use[k] += 1
        times = min(left[j] // m for j, m in use.items())
        slots = []
        for j, m in use.items():
            for _ in range(m):
                slots.append(spans[j][0])
                spans[j][0] += times
                left[j] -= times
        cuts = {0, times}
        for lo in slots:           # where a slot goes over to the next exact length
            i = int(np.searchsorted(starts, lo, "right"))
            while i < len(starts) and starts[i] < lo + times:
                cuts.add(int(starts[i]) - lo)
                i += 1
        cuts = sorted(cuts)
        for p, q in zip(cuts, cuts[1:]):
            offset = 0
            for lo in slots:
                first, _, n = edges[int(np.searchsorted(starts, lo + p, "right")) - 1]
                rules.append((n, lo + p - first, lo + q - first, bins + p, offset))
                offset += n
            free.setdefault(capacity - offset, []).append((bins + p, q - p))
        bins += times
    for n in sorted((n for n in counts if n <= epsilon * capacity and counts[n]), reverse=True):
        rank, rest = 0, counts[n]
        while rest:
            s = min((s for s in free if s >= n and free[s]), default=0)
            if not s:
                new = -(-rest // (capacity // n))
                free.setdefault(capacity, []).append((bins, new))
                bins += new
                continue
            first, wide = free[s].pop()
            m = min(rest, wide)
            rules.append((n, rank, rank + m, first, capacity - s))
            free.setdefault(s - n, []).append((first, m))
            if m < wide:
                free[s].append((first + m, wide - m))
            rank, rest = rank + m, rest - m
    return rules, bins


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024,
         end_id: int = T.END_ID, epsilon: float = 0.25, groups: int = 1024,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = tokenizer or T.default_path()
    table = written(pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    # at most ``capacity`` rows
    counts = {r["length"]: r["n"] for r in
              table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rules, _ = plan(counts, capacity, epsilon, groups)
    rules.sort()
    base, at = {}, 0
    for n in sorted(counts, reverse=True):
        base[n] = at
        at += counts[n]
    size = np.array([r[0] for r in rules], np.int64)
    low, first, offset = (np.array([r[i] for r in rules], np.int64) for i in (1, 3, 4))
    begins = np.zeros(capacity + 1, np.int64)
    for n, b in base.items():
        begins[n] = b
    key = (size << 44) | low
    ranked = row_index(table, [F.desc("length"), F.col(id_col), F.col("piece"),
                               F.col("ids_crc32")], "_rank")
    out = table.schema.simpleString()[7:-1] + ", sequence_id long, offset long"
    names = table.columns

    def place(batches):
        for b in batches:
            n = b.column(names.index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column(len(names)).to_numpy(zero_copy_only=False) - begins[n]
            i = np.searchsorted(key, (n << 44) | rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(names)], pa.array(first[i] + rank - low[i]),
                 pa.array(offset[i])], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(place, out.replace(":", " "))
