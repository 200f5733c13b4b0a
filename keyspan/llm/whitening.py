"""Whitening of embeddings by a bidiagonal qd solver (operator 11).

Entries become whole numbers, so sums are exact. Every task reduces blocks of centred rows to a triangle by QR, triangles are stacked and
reduced again in a tree, and the last one, as wide as a vector, has the singular values of all centred rows. From there the
work has the size of one vector squared: Householder reflections make the triangle bidiagonal, the differential qd iteration finds its
singular values to high relative accuracy, twisted factorisations of the shifted qd arrays give the right singular vectors, and the
reflections turn those back into components. No covariance matrix is formed, so small eigenvalues keep their digits.

Defined cases: a vector that is null, empty, or holds null, NaN or infinite entries is dropped; so is one with an entry beyond ``LARGEST``,
whose whole number has no exact place in a long, and one of another length than most have (of equally common lengths the longest
counts). Rows that share an id, or have none, are rows of their own. A component without variance (fewer vectors than entries, constant
or dependent entries) has null as whitened value, an explained share of 0 (null if nothing varies at all), and takes no part in the identity error.
``deviation`` is null where its exact value doesn't fit a long. Equal eigenvalues have some orthogonal components of their common space.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.llm.staging import staged
from keyspan.operators.frames import quoted

SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 40)
# Rows reduced at once, and triangles that one task stacks.
BLOCK = 4096
FAN_IN = 64
EPS = float(np.finfo(float).eps)


# The small problem: singular values and vectors of one triangle


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, upper diagonal and the reflections from the right of a square matrix, by Householder reflections from both sides."""
    r = np.array(r, float)
    n, reflections = len(r), []
    for k in range(n):
        v = _reflection(r[k:, k])
        r[k:, k:] -= np.outer(2 * v, v @ r[k:, k:])
        w = np.zeros(n)
        if k + 1 < n:
            w[k + 1 :] = _reflection(r[k, k + 1 :])
            r[k:, k + 1 :] -= np.outer(r[k:, k + 1 :] @ w[k + 1 :], 2 * w[k + 1 :])
        reflections.append(w)
    return np.diag(r).copy(), np.diag(r, 1).copy(), reflections


def _reflection(x: np.ndarray) -> np.ndarray:
    """The unit vector v for which x - 2 v (v x) has only a first entry; zeros if x has no others."""
    largest = np.abs(x).max(initial=0.0)
    if len(x) < 2 or not np.any(x[1:]):
        return np.zeros(len(x))
    v = x / largest
    v[0] += math.copysign(np.linalg.norm(v), v[0])
    return v / np.linalg.norm(v)


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential qd step with a shift; None if the shift passes the least value."""
    new_q, new_e, d = [], [], q[0] - shift
    for k in range(len(e)):
        if d < 0:
            return None
        total = d + e[k]
        ratio = q[k + 1] / total if total > 0 else 0.0
        new_q.append(total)
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
    if not d >= 0:
        return None
    return [*new_q, d], new_e


def singular_squares(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling, by dqds."""
    largest = max(np.abs(diagonal).max(initial=0.0), np.abs(upper).max(initial=0.0))
    if largest == 0:
        return np.zeros(len(diagonal))
    q, e = ((diagonal / largest) ** 2).tolist(), ((upper / largest) ** 2).tolist()
    found, waiting = [], [(q, e, 0.0)]
    while waiting:
        q, e, moved = waiting.pop()
        while q:
            if len(q) == 1:
                found.append(moved + q[0])
                break
            # Parts that no longer touch are problems of their own.
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= EPS * EPS * (moved + min(q[k], q[k + 1]))), None)
            if cut is not None:
                waiting.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if e[-1] <= 0.1 * EPS * (moved + q[-1]) * min(1.0, (moved + q[-1]) / (q[-2] + e[-1])):
                found.append(moved + q.pop())
                e.pop()
                continue
            if q[0] < q[-1]:  # the small end last
                q, e = q[::-1], e[::-1]
            # The least eigenvalue of the last two rows, a guess from above; a shift that passes the least value is taken back.
            a, b = q[-1], q[-2] + e[-1]
            guess = a * q[-2] / (0.5 * (a + b + math.sqrt(max((a + b) ** 2 - 4 * a * q[-2], 0.0)))) if a + b > 0 else 0.0
            for shift in (guess * (1 - 1e-3), guess * 0.75, guess * 0.25, 0.0):
                step = _dqds(q, e, shift)
                if step is not None:
                    q, e = step
                    moved += shift
                    break
    return np.sort(np.array(found))[::-1] * largest * largest


def _twisted(d: list[float], low: list[float], value: float) -> np.ndarray:
    """An eigenvector of L D L' for ``value``: factorised from both ends, which meet where the pivot is least."""
    n, tiny = len(d), 1e-290
    s, plus = [-value], []
    for k in range(n - 1):
        pivot = s[k] + d[k] or tiny
        plus.append(d[k] * low[k] / pivot)
        s.append(plus[k] * low[k] * s[k] - value)
    p, minus = [0.0] * n, [0.0] * (n - 1)
    p[n - 1] = d[n - 1] - value
    for k in range(n - 2, -1, -1):
        pivot = d[k] * low[k] * low[k] + p[k + 1] or tiny
        ratio = d[k] / pivot
        minus[k] = low[k] * ratio
        p[k] = p[k + 1] * ratio - value
    meet = min(range(n), key=lambda k: abs(s[k] + p[k] + value))
    z = np.zeros(n)
    z[meet] = 1.0
    for k in range(meet - 1, -1, -1):
        z[k] = -plus[k] * z[k + 1]
    for k in range(meet, n - 1):
        z[k + 1] = -minus[k] * z[k]
    return z / np.linalg.norm(z) if np.isfinite(z).all() else z


def right_vectors(diagonal: np.ndarray, upper: np.ndarray, squares: np.ndarray, most: int) -> np.ndarray:
    """Right singular vectors of the bidiagonal matrix, as columns, for the first ``most`` of ``squares``."""
    n, out = len(diagonal), []
    scale = math.sqrt(squares[0]) if len(squares) and squares[0] > 0 else 1.0
    a = diagonal / scale
    b = upper / scale
    a = np.where(np.abs(a) < 1e-150, 1e-150, a)
    d, low = (a * a).tolist(), (b / a[:-1]).tolist()
    matrix = np.diag(a) + np.diag(b, 1)
    draw = np.random.default_rng(1)
    values = squares / scale**2
    for k in range(min(most, n)):
        # Close values share a space; their vectors are made orthogonal, from another start where nothing is left.
        close = [out[j] for j in range(k) if values[j] - values[k] <= 1e-3 * max(values[0], EPS)]
        with np.errstate(all="ignore"):
            z = _twisted(d, low, float(values[k]))
        z = _without(z, close)
        if z is None:
            z = _inverse_iteration(matrix, float(values[k]), out, draw)
        out.append(z)
    return np.array(out).T.reshape(n, len(out))


def _without(z: np.ndarray, others: list[np.ndarray]) -> np.ndarray | None:
    """``z`` made orthogonal to ``others``, or None if little of it is left."""
    if not np.isfinite(z).all():
        return None
    left = z
    for _ in range(2):
        for other in others:
            left = left - (other @ left) * other
    size = np.linalg.norm(left)
    return left / size if size > 0.5 else None


def _inverse_iteration(matrix: np.ndarray, value: float, others: list[np.ndarray], draw: np.random.Generator) -> np.ndarray:
    """A vector for ``value`` of a matrix with entries of about one, orthogonal to ``others``."""
    n = len(matrix)
    shifted = matrix.T @ matrix - (value - 16 * EPS) * np.eye(n)
    z = draw.normal(size=n)
    for turn in range(5):
        for other in others * 2:
            z = z - (other @ z) * other
        z /= np.linalg.norm(z)
        if turn < 4:
            z = np.linalg.solve(shifted, z)
            z /= np.linalg.norm(z)
    return z


@dataclass
class Whitening:
    """``n`` vectors with sums ``s``; components as columns with their variances, and the variance of all."""

    n: int
    s: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n times the distance to the mean, exact."""
        return self.n * x - self.s

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """One column per component, NaN where it has no variance."""
        some = self.variances > 0
        spread = np.sqrt(np.where(some, self.variances, 1.0))
        return np.where(some, (centred / self.n) @ self.components / spread, np.nan)


def solve(triangle: np.ndarray, n: int, s: np.ndarray, most: int) -> Whitening:
    """From a triangle with the singular values of all centred rows."""
    diagonal, upper, reflections = bidiagonalise(triangle)
    squares = singular_squares(diagonal, upper)
    vectors = right_vectors(diagonal, upper, squares, most)
    for w in reversed(reflections):
        vectors = vectors - np.outer(2 * w, w @ vectors)
    least = (len(triangle) * 8 * EPS) ** 2 * squares[0] if len(squares) else 0.0
    variances = np.where(squares > least, squares, 0.0) / n
    return Whitening(n, s, vectors, variances[: vectors.shape[1]], float(variances.sum()))


# The table


def whole_numbers(flat: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * flat.astype(np.float64)).astype(np.int64) + SHIFT


def usable_rows(vectors: pa.Array) -> np.ndarray:
    """Which vectors are not null, not empty, and hold nothing but finite entries that are not too large."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    present = vectors.is_valid().to_numpy(zero_copy_only=False) & (lengths > 0)
    values = vectors.flatten()
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    good = values.is_valid().to_numpy(zero_copy_only=False) & (np.abs(flat) < LARGEST)
    owner = np.repeat(np.arange(len(vectors)), np.where(vectors.is_valid().to_numpy(zero_copy_only=False), lengths, 0))
    return present & (np.bincount(owner, weights=~good, minlength=len(vectors)) == 0)


def _blocks(batches: Iterator[pa.RecordBatch], size: int | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Usable rows of ``size`` entries (any, one length at a time, if None), with their whole numbers, in blocks."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            part = part.filter(pa.array(usable_rows(part["vector"])))
            lengths = part["vector"].value_lengths().to_numpy(zero_copy_only=False)
            for own in np.unique(lengths).tolist() if size is None else [size]:
                rows = part.filter(pa.array(lengths == own))
                if rows.num_rows:
                    yield rows, whole_numbers(rows["vector"].flatten().to_numpy(zero_copy_only=False)).reshape(-1, own)


def sums(vectors: DataFrame) -> tuple[int, np.ndarray] | None:
    """How many usable vectors of the commonest length there are, and the exact sum of each of their entries."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for rows, x in _blocks(batches, None):
            own = found.setdefault(x.shape[1], [0, 0])
            own[0] += rows.num_rows
            own[1] = own[1] + x.sum(axis=0)
        for size, (n, s) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * size), pa.array(range(size)), pa.array([n] * size), pa.array(s)], names=["size", "at", "n", "s"])

    totals = vectors.mapInArrow(of_task, "size long, at long, n long, s long").groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    first = totals.groupBy("size").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "s"))).alias("sums"))
    found = first.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    return (found[0]["n"], np.array([row["s"] for row in found[0]["sums"]], np.int64)) if found else None


def triangle(vectors: DataFrame, n: int, s: np.ndarray) -> np.ndarray:
    """The triangle of all centred rows: by task, then stacked in a tree of ``FAN_IN`` branches."""
    size = len(s)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, size))
        for batch in batches:
            for row in batch["r"]:
                r = np.linalg.qr(np.vstack([r, np.frombuffer(row.as_py()).reshape(-1, size)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, size))
        for _, x in _blocks(batches, size):
            r = np.linalg.qr(np.vstack([r, (n * x - s) / n]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    triangles = staged(vectors.mapInArrow(of_task, "r binary"))
    left = triangles.count()
    while left > 1:
        parts = -(-left // FAN_IN)
        triangles = staged(triangles.repartition(parts).mapInArrow(reduced, "r binary"))
        left = triangles.count()
    found = np.frombuffer(triangles.collect()[0]["r"]).reshape(-1, size)
    return np.vstack([found, np.zeros((size - len(found), size))])


def fit_whitening(vectors: DataFrame, vector: str = "embedding", most: int = 8) -> Whitening | None:
    """Components of all usable rows; None if there are none."""
    rows = vectors.select(quoted(vector).alias("vector"))
    found = sums(rows)
    return solve(triangle(rows, *found), *found, most) if found else None


def _deviations(centred: np.ndarray) -> list[int | None]:
    largest = int(np.abs(centred).max(initial=0))
    if largest * largest * centred.shape[1] < 1 << 63:
        return (centred * centred).sum(axis=1).tolist()
    exact = [sum(c * c for c in row) for row in centred.tolist()]
    return [total if total < 1 << 63 else None for total in exact]


def project(vectors: DataFrame, fitted: Whitening, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, deviation, whitened`` (an array, one entry per component) per usable row."""
    rows = vectors.select(quoted(vec_id).alias("vec_id"), quoted(vector).alias("vector"))
    id_type = rows.schema["vec_id"].dataType.simpleString()

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, len(fitted.s)):
            centred = fitted.centred(x)
            values = fitted.whitened(centred)
            flat = pa.array(values.reshape(-1), mask=np.isnan(values.reshape(-1)))
            until = pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32())
            columns = [part["vec_id"], pa.array(_deviations(centred), pa.int64()), pa.ListArray.from_arrays(until, flat)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(of_batches, f"vec_id {id_type}, deviation long, whitened array<double>")


def identity_error(projected: DataFrame, fitted: Whitening) -> float | None:
    """The largest entry of the whitened rows' covariance minus the identity, over components with variance."""
    some = [k for k, variance in enumerate(fitted.variances) if variance > 0]
    entries = [(i, j) for i in some for j in some if i <= j]
    if not entries:
        return None
    value = F.col("whitened")
    found = projected.agg(*(F.covar_pop(value[i], value[j]).alias(f"c{i}_{j}") for i, j in entries)).collect()[0]
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in entries)


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = 8) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per usable row and component, the widest spread first."""
    fitted = fit_whitening(vectors, vector, most)
    if fitted is None:
        id_type = vectors.select(quoted(vec_id)).schema[0].dataType.simpleString()
        schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], schema)
    projected = staged(project(vectors, fitted, vec_id, vector))
    error = identity_error(projected, fitted)
    shares = [float(v) / fitted.total if fitted.total > 0 else None for v in fitted.variances]
    return projected.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.lit(shares).cast("array<double>")[F.col("at")].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
