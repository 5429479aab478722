"""Embedding whitening by a bidiagonal qd solver.

* Tasks reduce their blocks of centred rows to a triangle by QR, the triangles meet FAN at a time, and one of the size of
  the dimension is left: only that one, the sums and the directions ever come to the driver.
* Householder reflections make the triangle bidiagonal, dqds finds the squares of its singular values to high relative
  accuracy, twisted factorisations their vectors, which the reflections turn back into whitening directions.

The fit list has each different vector once, so copies, however many, weigh nothing; every row is whitened.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: Vectors are worked on as whole numbers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components returned; rows to a block of QR; triangles that meet in one task; entries larger than this are not finite here.
COMPONENTS, BLOCK, FAN, LARGEST = 16, 4096, 32, 2.0 ** 55
#: Relative distance below which eigenvalues are a cluster, whose vectors are found together.
CLUSTER = 1e-6
EPS = np.finfo(float).eps


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and V of r = U B V' by Householder reflections from both sides."""
    a = np.array(r, float)
    d = len(a)
    v = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray:
        w = x.copy()
        w[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(w)
        return w / size if size else w

    for k in range(d):
        w = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        if k < d - 2:
            w = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ w, w)
            v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _dqds(q: list[float], e: list[float], tau: float) -> tuple[list[float], list[float], list[float]] | None:
    """One differential qd step with a shift; None if the shift was too large."""
    out_q, out_e, ds = [], [], []
    d = q[0] - tau
    for i in range(len(e)):
        if d < 0:
            return None
        ds.append(d)
        new = d + e[i]
        if new <= 0:
            return None
        ratio = q[i + 1] / new
        out_q.append(new)
        out_e.append(e[i] * ratio)
        d = d * ratio - tau
    if d < 0:
        return None
    return [*out_q, d], out_e, [*ds, d]


def singular_squares(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, largest first, by dqds.

    Every shift is a lower bound of what is left: 1 over the trace of the inverse, or the least eigenvalue of the last two
    rows less the coupling to the others. A step whose shift proves too large is done again with the first kind, then with none.
    """
    q, e = (diagonal ** 2).tolist(), (upper ** 2).tolist()
    top = max([*q, *e], default=0.0)
    if not top:
        return np.zeros(len(q))
    tiny = top * 1e-200  # for exact zeros, so that no quotient is undefined
    q, e = [max(x, tiny) for x in q], list(e)
    if q[0] < q[-1]:
        q, e = q[::-1], e[::-1]
    out, sigma = [], 0.0
    while len(q) > 1:
        if e[-1] <= EPS * EPS * (sigma + q[-1]):
            out.append(sigma + q.pop())
            e.pop()
            continue
        plain = _dqds(q, e, 0.0)
        safe = (1 - 8 * EPS * len(q)) / sum(1 / max(d, tiny) for d in plain[2])
        off, a, b = q[-1] * e[-1], q[-2] + e[-1], q[-1]
        half = (a - b) / 2
        least = b - off / (half + np.sqrt(half * half + off)) if half > 0 else 0.0
        bold = least * (1 - 4 * EPS)
        if len(e) > 1 and half > 0:
            bold -= np.sqrt(q[-2] * e[-2] * off) / (a - least)
        for tau in (max(bold, safe), safe):
            step = _dqds(q, e, tau)
            if step:
                sigma += tau
                break
        else:
            step = plain
        q, e = [max(x, tiny) for x in step[0]], step[1]
    out.append(sigma + q[0])
    return np.sort(np.array(out))[::-1]


def twisted_vector(diagonal: np.ndarray, upper: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of B'B for an eigenvalue: of the factorisations from the top and from the bottom, joined where the
    remaining pivot is least."""
    n = len(diagonal)
    pivot, tiny = diagonal ** 2, max(value, 1e-300) * 1e-30
    lower = upper / np.where(diagonal[:-1] == 0, 1e-150, diagonal[:-1])
    down, up = np.zeros(n), np.zeros(n)
    s, p = np.full(n, -value), np.zeros(n)
    for i in range(n - 1):
        plus = s[i] + pivot[i]
        plus = plus if abs(plus) > tiny else tiny
        down[i] = pivot[i] * lower[i] / plus
        s[i + 1] = down[i] * lower[i] * s[i] - value
    p[n - 1] = pivot[n - 1] - value
    for i in range(n - 2, -1, -1):
        minus = pivot[i] * lower[i] ** 2 + p[i + 1]
        minus = minus if abs(minus) > tiny else tiny
        ratio = pivot[i] / minus
        up[i] = lower[i] * ratio
        p[i] = p[i + 1] * ratio - value
    k = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[k] = 1
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def eigenvectors(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray, wanted: int) -> np.ndarray:
    """Orthonormal eigenvectors of B'B as columns, for the first ``wanted`` values. Values closer than CLUSTER share a space:
    the twisted vectors there are completed, turned by inverse iteration and made orthogonal."""
    n = len(diagonal)
    tri = np.diag(diagonal ** 2 + np.append(0.0, upper ** 2)) + np.diag(diagonal[:-1] * upper, 1) + np.diag(diagonal[:-1] * upper, -1)
    found = np.zeros((n, 0))
    at = 0
    while at < wanted:
        end = at + 1
        while end < len(values) and values[end - 1] - values[end] <= CLUSTER * values[0]:
            end += 1
        space = np.stack([twisted_vector(diagonal, upper, v) for v in values[at:end]], axis=1)
        if end - at > 1:
            # Neighbours may share one twisted vector; fixed noise completes the space.
            space = space + 1e-3 * np.random.default_rng(end - at).standard_normal(space.shape)
            moved = tri - (values[at] * (1 + 1e-10) + 1e-300) * np.eye(n)
            for _ in range(3):
                space = np.linalg.lstsq(moved, space, rcond=None)[0] if np.linalg.cond(moved) > 1e18 else np.linalg.solve(moved, space)
                space -= found @ (found.T @ space)
                space = np.linalg.qr(space)[0]
            turn = np.linalg.eigh(space.T @ tri @ space)[1][:, ::-1]
            space = space @ turn
        found = np.hstack([found, space])
        at = end
    return found[:, :wanted]


@dataclass(frozen=True)
class Whitening:
    """What a task needs: vectors of ``n`` different rows had the sums ``sums``; directions are scaled to unit variance."""

    n: int
    sums: list[int]
    directions: np.ndarray  # dimension x components
    explained: list[float]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n: whole part first, so nothing is lost to the size of x."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s - s // self.n * self.n) / self.n for s in self.sums])
        return (x - whole) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - sums)^2, exact; null where a long cannot hold it."""
        largest = max((abs(s) for s in self.sums), default=0) + self.n * int(np.abs(x).max(initial=0))
        if largest < 2 ** 62:
            y = self.n * x - np.array(self.sums, np.int64)
            if float(np.abs(y).max(initial=0)) ** 2 * max(1, y.shape[1]) < 2 ** 62:
                return (y * y).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums)) for row in x]
        return [v if v < 2 ** 63 else None for v in exact]


def numbered(rows: DataFrame, vector: Column) -> DataFrame:
    """The rows whose vector is usable, with x: whole numbers. Vectors of other lengths than most rows' have no place among
    them and go as well (of equally common lengths the longest stays)."""
    fine = vector.isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) <= LARGEST))
    whole = F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long") + F.lit(SHIFT))
    made = rows.filter(F.coalesce(fine, F.lit(False))).withColumn("x", whole)
    size = made.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return made.filter(F.size("x") == (size["size"] if size else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy().reshape(batch.num_rows, -1)


def _bytes_rows(rows: DataFrame, make: Callable[[Iterator[np.ndarray]], np.ndarray | None]) -> DataFrame:
    """part, content: what ``make`` gives for a task's blocks, as the bytes of doubles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make(_matrix(b.slice(at, BLOCK)) for b in batches for at in range(0, b.num_rows, BLOCK))
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array([made.astype(float).tobytes()], pa.binary())], names=["content"])

    return rows.select("x").mapInArrow(run, "content binary").select(F.spark_partition_id().alias("part"), "content")


def _merged(parts: DataFrame, shape: tuple[int, ...], merge: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
    """FAN at a time until one is left."""
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        made = merge([np.frombuffer(c).reshape(shape) for c in pdf["content"]])
        return pd.DataFrame({"part": [key[0]], "content": [made.astype(float).tobytes()]})

    parts = durable(parts)
    while (left := parts.count()) > 1:
        parts = durable(parts.groupBy(F.pmod(F.col("part"), F.lit(-(-left // FAN))).cast("int").alias("part")).applyInPandas(
            run, "part int, content binary"))
    return np.frombuffer(parts.first()["content"]).reshape(shape)


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Rows, and the exact sum of every dimension: halves of the numbers are summed apart, so nothing overflows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = _matrix(batch)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), pa.array([n, *high.tolist()]),
                                          pa.array([0, *low.tolist()])], names=["dim", "high", "low"])

    total = fit.select("x").mapInArrow(run, "dim int, high long, low long").groupBy("dim").agg(
        F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    got = {r["dim"]: (int(r["high"]), int(r["low"])) for r in total.collect()}  # one row a dimension
    return got[-1][0], [(got[i][0] << 32) + got[i][1] for i in range(dims)]


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, float | None]:
    """The whitening of the different vectors among ``rows`` (column x), and its largest error over them: the greatest entry
    of the whitened covariance less the identity. None where there are no rows."""
    distinct = durable(rows.select("x").distinct())
    one = distinct.first()
    if one is None:
        return None, None
    dims = len(one["x"])
    n, sums = _sums(distinct, dims)
    plain = Whitening(n, sums, np.zeros((dims, 0)), [])

    def triangle(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
        held = None
        for x in blocks:
            part = plain.centred(x)
            held = np.linalg.qr(part if held is None else np.vstack([held, part]), mode="r")
        return None if held is None else np.vstack([held, np.zeros((dims - len(held), dims))])

    r = _merged(_bytes_rows(distinct, triangle), (dims, dims), lambda parts: np.linalg.qr(np.vstack(parts), mode="r"))
    diagonal, upper, turn = bidiagonal(r)
    values = singular_squares(diagonal, upper)
    wanted = min(components, int((values > values[0] * (dims * EPS) ** 2 * 16).sum())) if values[0] > 0 else 0
    directions = turn @ eigenvectors(diagonal, upper, values, wanted)
    # A direction's variance as the triangle has it: also right to the last digits where values lie close together.
    spread = (np.linalg.norm(r @ directions, axis=0) ** 2) / n
    model = Whitening(n, sums, directions / np.sqrt(spread), (spread / (values.sum() / n)).tolist())
    return model, _identity_error(distinct, model, wanted) if wanted else None


def _identity_error(distinct: DataFrame, model: Whitening, k: int) -> float:
    def moments(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
        held = None
        for x in blocks:
            w = model.centred(x) @ model.directions
            mean = w.mean(axis=0)
            part = np.vstack([np.full(k, len(w)), mean, (w - mean).T @ (w - mean)])
            held = part if held is None else joined([held, part])
        return held

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        n = sum(p[0, 0] for p in parts)
        mean = sum(p[0, 0] / n * p[1] for p in parts)
        apart = sum(p[2:] + p[0, 0] * np.outer(p[1] - mean, p[1] - mean) for p in parts)
        return np.vstack([np.full(k, n), mean, apart])

    whole = _merged(_bytes_rows(distinct, moments), (k + 2, k), joined)
    return float(np.abs(whole[2:] / whole[0, 0] - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per usable row and component.

    Rows go whose vector is null, empty, of another length than most, or holds a null, a number that is not finite or one
    beyond 2^55. n counts the different vectors; explained is the component's share of the variance. Components number at
    most ``components``, and only as many as the vectors have dimensions that vary; with one different vector, or none, the
    result is empty. Repeated rows and null ids come out like any other; other columns are not read.
    """
    made = numbered(rows.select("vec_id", F.col("embedding").alias("vector")), F.col("vector")).select("vec_id", "x")
    model, error = fit(made, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not model.explained:
        return rows.sparkSession.createDataFrame([], schema)
    k = len(model.explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _matrix(part)
                w = model.centred(x) @ model.directions
                each = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(x) * k, model.n)), pa.array(model.deviations(x), pa.int64()).take(each),
                     pa.array(w.ravel()), pa.array(np.tile(model.explained, len(x))), pa.array(np.full(len(x) * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return made.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, schema)
