"""Whitening directions of a vector table by a bidiagonal qd solver.

1. Sums: entries become integers; their number and sums per dimension are exact.
2. Blockwise QR: each task centres its rows and folds them, block by block, into one
   upper triangle R; the triangles of the tasks are merged in groups of ``FAN``. The
   covariance is R'R / n, but it is never formed.
3. On the driver, over the d x d triangle alone (d is the dimension): Householder
   reflections make R bidiagonal, dqds finds its singular values to high relative
   accuracy, twisted factorisations of B'B give the directions.
4. Rows are projected; the covariance of the result is merged from per-task means and
   centred cross products.

Results: rows whose vector is null, empty, or holds null or non-finite entries are
dropped, and so are rows whose length is not the most frequent one (the longer one among
equals). Entries are cut at +-2^43 before scaling. Only directions of positive variance
are returned, so a table of equal vectors (or an empty one) gives no rows. ``deviation``
is null where it does not fit a long. Repeated rows and null ids count and stay.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

SCALE, SHIFT = 1024, 100_000
#: Entries beyond this size count as this size (their scaled values are exact doubles).
LARGEST = float(2 ** 43)
#: Task results merged in one group.
FAN = 64
#: Rows folded into the triangle at once.
BLOCK_ROWS = 2048
EPS = np.finfo(float).eps


# ---- rows


def usable(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(_id, _v array<double>): the rows that count, all of one length."""
    v = F.col("_v")
    rows = df.select(F.col(f"`{id_col}`").alias("_id"),
                     F.col(f"`{vec_col}`").cast("array<double>").alias("_v")).where(
        v.isNotNull() & (F.size(v) > 0) & F.forall(
            v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    common = (rows.groupBy(F.size(v).alias("d")).count()
              .orderBy(F.desc("count"), F.desc("d")).limit(1).collect())
    return rows.where(F.size(v) == (common[0]["d"] if common else -1))


def _integers(batch: pa.RecordBatch) -> np.ndarray:
    vecs = column(batch, "_v")
    flat = vecs.flatten().to_numpy(zero_copy_only=False)
    flat = np.floor(SCALE * np.clip(flat, -LARGEST, LARGEST)).astype(np.int64) + SHIFT
    return flat.reshape(batch.num_rows, -1)


def _blocks(batches, rows: int = BLOCK_ROWS):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, _integers(part)


def _numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: long where it fits, Python integers otherwise."""
    top = max(abs(int(x.min())), abs(int(x.max())))
    if n * top + max(abs(s) for s in sums) < 2 ** 62:
        return n * x - np.asarray(sums, np.int64)
    return n * x.astype(object) - np.asarray(sums, object)


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the sum of every dimension, as integers."""
    def run(batches):
        n, total = 0, None
        for _, x in _blocks(batches):
            safe = max(abs(int(x.min())), abs(int(x.max()))) * len(x) < 2 ** 62
            part = (x if safe else x.astype(object)).sum(axis=0).astype(object)
            total = part if total is None else total + part
            n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict(
                {"dim": list(range(-1, len(total))),
                 "value": pa.array([str(n), *map(str, total)])},
                schema=pa.schema([("dim", pa.int32()), ("value", pa.string())]))

    got = (rows.mapInArrow(run, "dim int, value string").groupBy("dim")
           .agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect())
    sums = {r["dim"]: int(r["value"]) for r in got}
    return sums.get(-1, 0), [sums[i] for i in range(len(sums) - 1)]


# ---- per-task results, merged in groups


def _merged(parts: DataFrame, merge) -> np.ndarray | None:
    """One array from (task, value array<double>) rows: groups of FAN tasks, then groups
    of those, until the rest is one group (for up to FAN^4 tasks)."""
    def run(batches):
        held, key = None, None
        for batch in batches:
            for task, value in zip(*(c.to_pylist() for c in batch.columns)):
                value = np.asarray(value)
                if key is not None and task != key:
                    yield _part(key, held)
                    held = None
                held, key = (value if held is None else merge(held, value)), task
        if held is not None:
            yield _part(key, held)

    for _ in range(4):
        parts = (parts.select(F.floor(F.col("task") / FAN).cast("int").alias("task"), "value")
                 .repartition("task").sortWithinPartitions("task")
                 .mapInArrow(run, "task int, value array<double>"))
    got = parts.collect()
    return np.asarray(got[0]["value"]) if got else None


def _part(task: int, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([task], pa.int32()), pa.array([value.ravel().tolist()], pa.list_(pa.float64()))],
        names=["task", "value"])


def triangle(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Upper triangle R with R'R = sum of outer products of the centred rows."""
    d = len(sums)

    def fold(r, block):
        return np.linalg.qr(np.vstack([r, block]), mode="r")

    def run(batches):
        r = None
        for _, x in _blocks(batches):
            r = fold(np.zeros((0, d)) if r is None else r,
                     _numerators(x, n, sums).astype(float) / n)
        if r is not None:
            yield _part(TaskContext.get().partitionId(), r)

    got = _merged(rows.mapInArrow(run, "task int, value array<double>"),
                  lambda a, b: fold(a.reshape(-1, d), b.reshape(-1, d)).ravel())
    r = np.zeros((d, d))
    got = got.reshape(-1, d)
    r[:len(got)] = got
    return r


# ---- the d x d problem


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal a, superdiagonal b, P): R = U B P' with orthogonal U and P."""
    a, d = np.array(r, float), r.shape[1]
    p = np.eye(d)

    def reflector(x):
        v, size = x.copy(), np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            return None
        v[0] += math.copysign(size, x[0])
        return v / np.linalg.norm(v)

    for k in range(d):
        v = reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        v = reflector(a[k, k + 1:]) if k + 2 < d else None
        if v is not None:
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
            p[:, k + 1:] -= 2 * np.outer(p[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def _qd_step(q: list[float], e: list[float], shift: float):
    """One dqds transform, or None where the shift was above the smallest value."""
    n, d = len(q), q[0] - shift
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    for k in range(n - 1):
        if d < 0:
            return None
        new_q[k] = d + e[k]
        t = q[k + 1] / new_q[k] if new_q[k] else 0.0
        new_e[k] = e[k] * t
        d = d * t - shift
    if d < 0:
        return None
    new_q[-1] = d
    return new_q, new_e


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal (a, b), falling, by dqds: shifts
    from the last two rows, taken back when they overshoot, so all stay positive."""
    todo, found = [([x * x for x in a.tolist()], [x * x for x in b.tolist()], 0.0)], []
    while todo:
        q, e, base = todo.pop()
        while q:
            n = len(q)
            if n == 1:
                found.append(base + q[0])
                break
            cut = next((k for k in range(n - 2, -1, -1)
                        if e[k] <= EPS * EPS * (base + min(q[k], q[k + 1])) or e[k] == 0), None)
            if cut is not None:
                todo.append((q[:cut + 1], e[:cut], base))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            # smaller eigenvalue of the last two rows of L D L', as a first shift
            x, y, z = q[-2] + e[-2 if n > 2 else -1] * (n > 2), q[-1] + e[-1], q[-2] * e[-1]
            half = (x + y) / 2
            det = max(x * y - z, 0.0)
            top = half + math.sqrt(max(half * half - det, 0.0))
            shift = 0.99 * det / top if top else 0.0
            done = None
            for _ in range(4):
                done = _qd_step(q, e, shift)
                if done:
                    break
                shift /= 8
            if not done:
                shift, done = 0.0, _qd_step(q, e, 0.0)
            q, e = done
            base += shift
    return np.sort(np.asarray(found))[::-1]


def _twisted(a: np.ndarray, b: np.ndarray, lam: float) -> tuple[np.ndarray, ...]:
    """Factors of B'B - lam from both ends and the twist sizes gamma."""
    d = len(a)
    tiny = np.finfo(float).tiny / EPS
    q = np.maximum(a * a, tiny)
    ell = b * np.where(np.abs(a[:-1]) > 0, a[:-1], tiny) / q[:-1] if d > 1 else np.zeros(0)
    s, low = np.zeros(d), np.zeros(max(d - 1, 0))
    s[0] = -lam
    for i in range(d - 1):
        plus = s[i] + q[i]
        plus = plus if abs(plus) > tiny else tiny
        low[i] = q[i] * ell[i] / plus
        s[i + 1] = low[i] * ell[i] * s[i] - lam
    p, up = np.zeros(d), np.zeros(max(d - 1, 0))
    p[-1] = q[-1] - lam
    for i in range(d - 2, -1, -1):
        minus = q[i] * ell[i] * ell[i] + p[i + 1]
        minus = minus if abs(minus) > tiny else tiny
        t = q[i] / minus
        up[i] = ell[i] * t
        p[i] = p[i + 1] * t - lam
    return low, up, s + p + lam


def directions(a: np.ndarray, b: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Unit eigenvectors (columns) of B'B for the first ``k`` values. Where values are
    close, a vector is made orthogonal to the earlier ones; a twist that leaves nothing
    is replaced by the next one."""
    d, out = len(a), np.zeros((len(a), k))
    for j in range(k):
        low, up, gamma = _twisted(a, b, values[j])
        near = [i for i in range(j) if values[i] - values[j] <= 1e-3 * values[i]]
        best = None
        for twist in np.argsort(np.abs(np.where(np.isfinite(gamma), gamma, np.inf)), kind="stable"):
            z = np.zeros(d)
            z[twist] = 1.0
            for i in range(twist - 1, -1, -1):
                z[i] = -low[i] * z[i + 1]
            for i in range(twist, d - 1):
                z[i + 1] = -up[i] * z[i]
            z /= np.linalg.norm(z)
            for _ in range(2):
                for i in near:
                    z -= (out[:, i] @ z) * out[:, i]
            left = np.linalg.norm(z)
            if best is None or left > 2 * best[0]:
                best = (left, z / left if left else z)
            if left > 0.5:
                break
        out[:, j] = best[1]
    return out


def whitening(r: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(directions as columns, their variances, shares of the total variance) from R."""
    size = float(np.abs(r).max()) if r.size else 0.0
    if size == 0 or n == 0:
        return np.zeros((r.shape[1], 0)), np.zeros(0), np.zeros(0)
    a, b, p = bidiagonal(r / size)
    values = squared_singular_values(a, b)
    positive = values > (len(a) * EPS) ** 2 * values[0] * len(a)
    k = min(k, int(positive.sum()))
    vecs = p @ directions(a, b, values, k)
    vecs /= np.linalg.norm(vecs, axis=0)
    vecs *= np.where(vecs[np.abs(vecs).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    total = float((r / size).ravel() @ (r / size).ravel())
    return vecs, values[:k] * (size * size / n), values[:k] / total


# ---- the whole


def _moments(rows: DataFrame, n: int, sums: list[int], project: np.ndarray) -> np.ndarray:
    """Covariance (divisor n) of the projected rows: count, mean and centred cross
    products of each task, merged pairwise."""
    k = project.shape[1]

    def merge(a, b):
        na, nb = a[0], b[0]
        gap = b[1:1 + k] - a[1:1 + k]
        mean = a[1:1 + k] + gap * (nb / (na + nb))
        cross = a[1 + k:] + b[1 + k:] + np.outer(gap, gap).ravel() * (na * nb / (na + nb))
        return np.concatenate([[na + nb], mean, cross])

    def run(batches):
        held = None
        for _, x in _blocks(batches):
            w = _numerators(x, n, sums).astype(float) / n @ project
            mean = w.mean(axis=0)
            part = np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()])
            held = part if held is None else merge(held, part)
        if held is not None:
            yield _part(TaskContext.get().partitionId(), held)

    got = _merged(rows.mapInArrow(run, "task int, value array<double>"), merge)
    return got[1 + k:].reshape(k, k) / n


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
           components: int = 8) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): one row per
    usable vector and direction, directions numbered from 1 by falling variance."""
    rows = usable(df, vec_col, id_col)
    n, sums = exact_sums(rows)
    kind = rows.schema["_id"].dataType.simpleString()
    schema = (f"_id {kind}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    out = [F.col("_id").alias(id_col), *[p.split()[0] for p in schema.split(", ")[-6:]]]
    if n:
        vecs, values, shares = whitening(triangle(rows, n, sums), n, components)
    if not n or not len(values):
        return df.sparkSession.createDataFrame([], schema).select(*out)
    project = vecs / np.sqrt(values)
    k = len(values)
    error = float(np.abs(_moments(rows, n, sums, project) - np.eye(k)).max())

    def run(batches):
        for part, x in _blocks(batches):
            num = _numerators(x, n, sums)
            top = max(abs(int(num.min())), abs(int(num.max())))
            fits = num.shape[1] * top * top < 2 ** 63
            dev = (num.astype(np.int64) ** 2).sum(axis=1).tolist() if fits else [
                t if t < 2 ** 63 else None
                for t in (sum(int(c) ** 2 for c in line) for line in num)]
            w = num.astype(float) / n @ project
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [column(part, "_id").take(pa.array(each)),
                 pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                 pa.array(np.full(len(each), n), pa.int64()),
                 pa.array(dev, pa.int64()).take(pa.array(each)),
                 pa.array(w.ravel()), pa.array(np.tile(shares, len(x))),
                 pa.array(np.full(len(each), error))],
                names=["_id", "component", "n", "deviation", "whitened", "explained",
                       "identity_error"])

    return rows.mapInArrow(run, schema).select(*out)
