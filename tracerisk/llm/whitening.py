"""Whitening of embeddings: blockwise QR, bidiagonal form, qd singular values, twisted factorisations."""

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracerisk.sources import materialize

# Steps per unit of a vector's entry.
GRID = 256
COMPONENTS = 4
# Rows of one QR step, and partial results that one task merges.
BLOCK_ROWS = 4096
FAN_IN = 16
EPS = np.finfo(float).eps

PARTIAL = "part long, n long, parts array<double>"
RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


# Singular values and right vectors of a small square matrix


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and P of r = U B P', by Householder reflections from both sides."""
    a = np.array(r, float)
    d = len(a)
    p = np.eye(d)

    def reflector(x):
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(v)
        return v / size if size > 0 else None

    for k in range(d):
        v = reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k + 2 < d:
            v = reflector(a[k, k + 1 :])
            if v is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
                p[:, k + 1 :] -= 2 * np.outer(p[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def _dqds_step(q: list, e: list, shift: float) -> tuple[list, list, list]:
    """One differential qd transform with a shift; also its d's, all positive if the shift was small enough."""
    new_q, new_e, ds = [], [], []
    d = q[0] - shift
    for i in range(len(e)):
        ds.append(d)
        top = d + e[i]
        if d <= 0 or top <= 0:
            return new_q, new_e, ds
        new_q.append(top)
        t = q[i + 1] / top
        new_e.append(e[i] * t)
        d = d * t - shift
    ds.append(d)
    new_q.append(d)
    return new_q, new_e, ds


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues of B'B, falling, from the squares of B's diagonal (positive) and superdiagonal.

    Shifts never pass the least eigenvalue, so all quantities stay positive and
    every value, the small ones too, keeps its relative accuracy.
    """
    found: list[float] = []
    work = [(list(map(float, q)), list(map(float, e)), 0.0)]
    while work:
        q, e, total = work.pop()
        for _ in range(200 * len(q) + 200):
            while e and e[-1] <= EPS * EPS * (total + q[-1]):
                found.append(q.pop() + total)
                e.pop()
            if not e:
                break
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS * EPS * (total + min(q[i], q[i + 1]))), None)
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], total))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            # Least eigenvalue of the last two rows: no less than the least of all.
            x = q[-2] + (e[-2] if len(e) > 1 else 0.0)
            y, s = q[-1] + e[-1], q[-2] * e[-1]
            half = (x + y) / 2
            det = x * y - s
            shift = max(0.0, det / (half + np.sqrt(max(half * half - det, 0.0)))) * (1 - 4 * EPS)
            for attempt in range(4):
                shift = 0.0 if attempt == 3 else shift
                new_q, new_e, ds = _dqds_step(q, e, shift)
                # A last d of 0 stands for an eigenvalue at the shift.
                if len(ds) == len(q) and ds[-1] >= 0:
                    break
                late = len(ds) == len(q)
                shift = max(0.0, shift + ds[-1]) * (1 - 4 * EPS) if late and attempt == 0 else shift / 4
            q, e, total = new_q, new_e, total + shift
        else:
            raise ArithmeticError("the qd transforms don't converge")
        found.extend(v + total for v in q)
    return np.array(sorted(found, reverse=True))


class Twisted:
    """Twisted factorisation of LDL' - value: from the top and from the bottom, met where the pivot is least."""

    def __init__(self, diagonal: np.ndarray, lower: np.ndarray, value: float):
        m = len(diagonal)
        tiny = EPS * EPS * max(value, np.finfo(float).tiny ** 0.5)
        s, plus, l_plus = np.zeros(m), np.zeros(m), np.zeros(max(m - 1, 0))
        s[0] = -value
        for i in range(m):
            plus[i] = diagonal[i] + s[i]
            if plus[i] == 0:
                plus[i] = tiny
            if i + 1 < m:
                l_plus[i] = diagonal[i] * lower[i] / plus[i]
                s[i + 1] = l_plus[i] * lower[i] * s[i] - value
        p, minus, u_minus = np.zeros(m), np.zeros(m), np.zeros(max(m - 1, 0))
        p[-1] = diagonal[-1] - value
        for i in range(m - 2, -1, -1):
            minus[i + 1] = diagonal[i] * lower[i] ** 2 + p[i + 1]
            if minus[i + 1] == 0:
                minus[i + 1] = tiny
            t = diagonal[i] / minus[i + 1]
            u_minus[i] = lower[i] * t
            p[i] = p[i + 1] * t - value
        pivot = s + p + value
        self.k = int(np.argmin(np.abs(pivot)))
        self.pivot = pivot[self.k] or tiny
        self.plus, self.minus, self.l_plus, self.u_minus = plus, minus, l_plus, u_minus

    def _outward(self, z: np.ndarray) -> np.ndarray:
        for i in range(self.k - 1, -1, -1):
            z[i] -= self.l_plus[i] * z[i + 1]
        for i in range(self.k, len(z) - 1):
            z[i + 1] -= self.u_minus[i] * z[i]
        return z

    def vector(self) -> np.ndarray:
        """Solution of N'z = e_k: the eigenvector, not yet of unit length."""
        z = np.zeros(len(self.plus))
        z[self.k] = 1
        return self._outward(z)

    def solve(self, w: np.ndarray) -> np.ndarray:
        """Solution of (LDL' - value) z = w."""
        z = w.copy()
        for i in range(self.k):
            z[i + 1] -= self.l_plus[i] * z[i]
        for i in range(len(z) - 1, self.k, -1):
            z[i - 1] -= self.u_minus[i - 1] * z[i]
        z[: self.k] /= self.plus[: self.k]
        z[self.k] /= self.pivot
        z[self.k + 1 :] /= self.minus[self.k + 1 :]
        return self._outward(z)


def _unit_vectors(q: np.ndarray, a: np.ndarray, b: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    """Eigenvectors of B'B for its largest `values`; near ones are made orthogonal to each other."""
    diagonal, lower = q, b / a[:-1]
    draw = np.random.default_rng(7)
    out: list[np.ndarray] = []
    for value in values:
        made = Twisted(diagonal, lower, value)
        z = made.vector()
        z /= np.linalg.norm(z)
        for attempt in range(6):
            size = 1.0
            for _ in range(2):
                for other in out:
                    z = z - other * (other @ z)
                size *= np.linalg.norm(z)
                z /= np.linalg.norm(z)
            if size > 0.1:
                break
            # The vector of an equal value again: start from elsewhere.
            z = draw.standard_normal(len(q)) if attempt == 0 else z
            for other in out:
                z = z - other * (other @ z)
            z = made.solve(z / np.linalg.norm(z))
            z /= np.linalg.norm(z)
        out.append(z)
    return out


def whitening_directions(r: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit directions (columns), eigenvalues and trace of r'r / n, for up to `components` positive eigenvalues.

    Singular values under d * eps of the largest are rounding noise and have no direction.
    Of either sign, a direction has its largest entry positive.
    """
    d = len(r)
    scale = np.abs(r).max() if r.size else 0.0
    if scale == 0:
        return np.zeros((d, 0)), np.zeros(0), 0.0
    a, b, p = bidiagonalise(r / scale)
    norm = max(np.abs(a).max(), np.abs(b).max() if d > 1 else 0.0)
    # Below rounding of the largest: a zero would end the qd transforms.
    a = np.where(np.abs(a) < 1e-20 * norm, 1e-20 * norm, a)
    b = np.where(np.abs(b) < 1e-3 * EPS * norm, 0.0, b)
    ends = [0, *(np.flatnonzero(b == 0) + 1), d] if d > 1 else [0, 1]
    found = []
    for low, high in zip(ends, ends[1:]):
        q = a[low:high] ** 2
        values = dqds(q, b[low : high - 1] ** 2)
        values = values[: min(components, high - low)]
        for value, z in zip(values, _unit_vectors(q, a[low:high], b[low : high - 1], values)):
            found.append((value, low, z))
    found.sort(key=lambda x: -x[0])
    found = [f for f in found[:components] if f[0] > (d * EPS) ** 2 * found[0][0]]
    directions = np.stack([p[:, low : low + len(z)] @ z for _, low, z in found], axis=1)
    at = np.abs(directions).argmax(axis=0)
    directions = directions * np.sign(directions[at, np.arange(len(found))])
    values = np.array([f[0] for f in found]) * scale**2 / n
    return directions, values, float(((r / scale) ** 2).sum()) * scale**2 / n


# Spark side


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The column x of a batch, all of one width."""
    column = batch.column(batch.schema.get_field_index("x"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _partial(table: DataFrame, width: int, start: Callable[[], object], step: Callable, end: Callable) -> DataFrame:
    """One row of PARTIAL per task: `step(state, x)` for each block of rows, then `end(state)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, state = 0, start()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                x = _matrix(batch.slice(at, BLOCK_ROWS), width)
                n += len(x)
                state = step(state, x)
        if n:
            parts = pa.array([np.asarray(end(state), float).ravel()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([n], pa.int64()), parts], ["part", "n", "parts"])

    return materialize(table.select("x").mapInArrow(run, PARTIAL).withColumn("part", F.spark_partition_id().cast("long")))


def _reduced(partial: DataFrame, merge: Callable) -> tuple[int, np.ndarray]:
    """All rows of PARTIAL merged, FAN_IN at a time over tasks, the last few here; each is a matrix's size."""
    while partial.count() > FAN_IN:
        group = F.floor(F.col("part") / FAN_IN).alias("part")

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            n, parts = merge([(int(r.n), np.asarray(r.parts)) for r in rows.itertuples()])
            return pd.DataFrame({"part": [rows["part"].iloc[0]], "n": [n], "parts": [parts]})

        partial = materialize(partial.select(group, "n", "parts").groupBy("part").applyInPandas(run, PARTIAL))
    return merge([(r.n, np.asarray(r.parts)) for r in partial.orderBy("part").collect()])


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int], int]:
    """Rows, exact sums per dimension and the largest absolute entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, top, total = 0, 0, [0] * width
        for batch in batches:
            x = _matrix(batch, width)
            # In halves, so that no sum of a batch can overflow.
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            total = [t + (int(h) << 32) + int(v) for t, h, v in zip(total, high, low)]
            top = max(top, -int(x.min(initial=0)), int(x.max(initial=0)))
            n += len(x)
        if n:
            for i, t in enumerate(total or [0]):
                yield pa.RecordBatch.from_pylist([{"dim": i, "n": n, "top": str(top), "total": str(t)}])

    number = F.col("total").cast("decimal(38,0)")
    rows = fit.select("x").mapInArrow(run, "dim long, n long, top string, total string").groupBy("dim").agg(
        F.sum("n").alias("n"), F.max(F.col("top").cast("decimal(38,0)")).alias("top"), F.sum(number).alias("total")
    )
    # One row per dimension.
    found = sorted(rows.collect(), key=lambda r: r.dim)
    if not found:
        return 0, [0] * width, 0
    return found[0].n, [int(r.total) for r in found][:width], int(max(r.top for r in found))


def _deviations(x: np.ndarray, n: int, sums: list[int], top: int) -> list:
    """Exact sum over dimensions of (n x - S)^2; None where it doesn't fit a long."""
    if len(sums) * (2 * n * top) ** 2 < 1 << 62:
        gap = n * x - np.array(sums, np.int64)
        return (gap * gap).sum(axis=1).tolist()
    gap = x.astype(object) * n - np.array(sums, object)
    return [int(v) if v < 1 << 63 else None for v in (gap * gap).sum(axis=1)]


def _merged_moments(rows: list[tuple[int, np.ndarray]], k: int) -> tuple[int, np.ndarray]:
    """Means and centred products of several groups as those of one."""
    n, mean, products = 0, np.zeros(k), np.zeros((k, k))
    for m, parts in rows:
        gap = parts[:k] - mean
        products = products + parts[k:].reshape(k, k) + np.outer(gap, gap) * (n * m / (n + m))
        mean = mean + gap * (m / (n + m))
        n += m
    return n, np.concatenate([mean, products.ravel()])


def whiten(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every vector: one row per vector and component.

    Entries become whole numbers x = floor(256 c). The fit list holds each distinct x
    once: n of them with sums S per dimension. Each task reduces its centred rows
    block by block to one triangular factor; factors are merged a few at a time
    until one is left, whose size is that of one vector squared. Its bidiagonal form
    gives the singular values by dqds and the directions by twisted factorisations.
    Components are numbered by falling eigenvalue e of the covariance of x.

    Returns vec_id, component, n, deviation (sum of (n x - S)^2, exact; null where
    a long can't hold it), whitened ((x - S/n) on the component over sqrt(e)), explained (e over the
    trace) and identity_error (largest absolute entry of the whitened covariance less the identity).

    Vectors that are null or hold null, NaN or infinite entries have no rows. Shorter
    vectors count as followed by zeros. x beyond the range of a long is its end. Repeated rows all
    come out; a null id stays null. There are as many components as positive
    eigenvalues, so none (and no rows) for fewer than two distinct vectors or an
    empty table. Other columns don't matter.
    """
    spark = vectors.sparkSession
    entry = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), entry.alias("x")).filter(F.col("x").isNotNull())
    rows = rows.filter(F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    rows = rows.withColumn("x", F.transform("x", lambda c: F.floor(c * GRID)))
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    missing = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))
    rows = materialize(rows.withColumn("x", F.concat("x", missing)))
    nothing = spark.createDataFrame([], RESULT)
    if not width:
        return nothing

    fit = materialize(rows.select("x").distinct())
    n, sums, top = _sums(fit, width)
    mean = np.array([float(Fraction(s, max(n, 1))) for s in sums])

    def factor(r, x):
        return np.linalg.qr(np.concatenate([r, x - mean]), mode="r")

    def merge(parts):
        stacked = [p.reshape(-1, width) for _, p in parts]
        return sum(m for m, _ in parts), np.linalg.qr(np.concatenate(stacked), mode="r").ravel()

    if n < 2:
        return nothing
    factors = _partial(fit, width, lambda: np.zeros((0, width)), factor, lambda r: r)
    _, flat = _reduced(factors, merge)
    r = np.zeros((width, width))
    r[: len(flat) // width] = flat.reshape(-1, width)
    directions, values, trace = whitening_directions(r, n, components)
    k = len(values)
    if not k:
        return nothing
    transform = directions / np.sqrt(values)

    def moments(state, x):
        y = (x - mean) @ transform
        centre = y.mean(axis=0)
        own = np.concatenate([centre, ((y - centre).T @ (y - centre)).ravel()])
        m, parts = state
        return _merged_moments([(m, parts), (len(y), own)], k) if m else (len(y), own)

    spread = _partial(fit, width, lambda: (0, np.zeros(k + k * k)), moments, lambda s: s[1])
    m, parts = _reduced(spread, lambda rows: _merged_moments(rows, k))
    error = float(np.abs(parts[k:].reshape(k, k) / m - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = _matrix(part, width)
                ids = part.column(part.schema.get_field_index("vec_id"))
                every = pa.array(np.repeat(np.arange(len(x)), k))
                deviation = pa.array(_deviations(x, n, sums, top), pa.int64())
                whitened = ((x - mean) @ transform).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(every),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(whitened), n)),
                        deviation.take(every),
                        pa.array(whitened),
                        pa.array(np.tile(values / trace, len(x))),
                        pa.array(np.full(len(whitened), error)),
                    ],
                    [c.split()[0] for c in RESULT.split(", ")],
                )

    return rows.mapInArrow(run, RESULT)
