"""Whitening of feature vectors by a bidiagonal qd solver.

The vector records of this project are the users' feature vectors (``user_id``, ``vec``) in fixed point
(``vectors.fixed_point``), so that sums over any number of users are exact. Tasks reduce blocks of centred rows
to triangular factors, which are merged a few at a time; the last factor has one row per dimension. It is brought to
bidiagonal form by Householder reflections, its singular values come from the differential quotient-difference algorithm
with shifts, and each direction from a twisted factorisation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import cut_lineage, unpacked
from .vectors import common_length, usable

# triangular factors merged by one task, and rows reduced at once
FAN_IN, BLOCK_ROWS = 16, 4096
EPS = np.finfo(float).eps


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with exact sums; a unit direction and an eigenvalue of the covariance per component."""

    n: int
    sums: list[int]
    directions: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n with a single rounding: the integer part of the mean is taken off exactly."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(float) - rest


def _triangle(blocks) -> np.ndarray | None:
    """R of all rows of the blocks, one block on top of the last factor at a time."""
    r = None
    for block in blocks:
        if len(block):
            r = np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")
    return r


# ---- driver side: matrices with one row per dimension ----


def _reflector(x: np.ndarray) -> np.ndarray | None:
    """Unit u for which (I - 2uu')x has zeros below its first entry."""
    size = np.linalg.norm(x)
    if size == 0 or not x[1:].any():
        return None
    u = x.copy()
    u[0] += size if x[0] >= 0 else -size
    return u / np.linalg.norm(u)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) with R = U B V'."""
    a = r.copy()
    d = len(a)
    v = np.eye(d)
    for k in range(d):
        if (u := _reflector(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k < d - 2 and (u := _reflector(a[k, k + 1 :])) is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ u, u)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ u, u)
    return a.diagonal().copy(), a.diagonal(1).copy(), v


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential qd step with a shift: new q, new e and the auxiliary d values."""
    n = len(q)
    d, aux, new_q, new_e = q[0] - shift, [], [0.0] * n, [0.0] * (n - 1)
    for k in range(n - 1):
        aux.append(d)
        new_q[k] = d + e[k]
        ratio = q[k + 1] / new_q[k] if new_q[k] else 0.0
        new_e[k] = e[k] * ratio
        d = d * ratio - shift
    new_q[n - 1] = d
    aux.append(d)
    return new_q, new_e, aux


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Eigenvalues of B'B, falling, by dqds: every step keeps all quantities non-negative, so small values keep their digits.

    The shift is 1 / trace of the inverse, read off the d values of the last step: a lower bound of the
    smallest eigenvalue. A value is split off when the last e no longer counts.
    """
    todo = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above], 0.0)]
    values: list[float] = []
    while todo:
        q, e, taken = todo.pop()
        shift = 0.0
        while True:
            n = len(q)
            if n == 1:
                values.append(q[0] + taken)
                break
            if e[-1] <= EPS**2 * (taken + q[-1]) or q[-1] + e[-1] == 0:
                values.append(q.pop() + taken)
                e.pop()
                shift = 0.0
                continue
            cut = next((k for k in range(n - 2, -1, -1) if e[k] <= EPS**2 * (taken + min(q[k], q[k + 1]))), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], taken))
                q, e, shift = q[cut + 1 :], e[cut + 1 :], 0.0
                continue
            if q[0] < q[-1]:  # large values first: the small ones leave at the end; the reversed array has the same values
                q, e = _reversed(q, e)
            new_q, new_e, aux = _sweep(q, e, shift)
            if min(aux) < 0:  # the bound was rounded up
                shift = 0.0
                new_q, new_e, aux = _sweep(q, e, 0.0)
            q, e, taken = new_q, new_e, taken + shift
            least = min(aux)
            shift = (1 - 4 * len(q) * EPS) / sum(1 / x for x in aux) if least > 0 else 0.0
            if taken and shift < EPS * taken:
                shift = 0.0
    return np.sort(np.array(values))[::-1]


def _reversed(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The qd array of the matrix flipped about its antidiagonal."""
    return q[::-1], e[::-1]


def _twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gamma, down, up) of B'B - value: the factor from the top, the one from the bottom, and their sums per place."""
    n = len(diagonal)
    big = np.abs(diagonal).max(initial=0) or 1.0
    a = np.where(np.abs(diagonal) < 1e-150 * big, 1e-150 * big, diagonal)
    dd, low = a**2, np.append(above / a[:-1], 0.0) if n > 1 else np.zeros(1)
    tiny = EPS * max(value, np.finfo(float).tiny)
    s, p = np.empty(n), np.empty(n)
    down, up = np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + dd[i] or tiny
        down[i] = dd[i] * low[i] / pivot
        s[i + 1] = down[i] * low[i] * s[i] - value
    p[n - 1] = dd[n - 1] - value
    for i in range(n - 2, -1, -1):
        pivot = dd[i] * low[i] ** 2 + p[i + 1] or tiny
        t = dd[i] / pivot
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    return s + p + value, down, up


def directions(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of B'B for the given eigenvalues, one per column.

    The vector solves the twisted factorisation from the place of the smallest gamma. Values that
    agree to seven digits form a cluster: its vectors are made orthogonal, from another place where the first gives nothing new.
    """
    n, out = len(diagonal), []
    for j, value in enumerate(values):
        gamma, down, up = _twisted(diagonal, above, value)
        mates = [out[i] for i in range(j) if values[i] - value <= 1e-7 * values[i]]
        best, most = None, -1.0
        for r in np.argsort(np.abs(np.nan_to_num(gamma, nan=np.inf)), kind="stable")[: 1 + 2 * len(mates)]:
            z = np.zeros(n)
            z[r] = 1.0
            for i in range(r - 1, -1, -1):
                z[i] = -down[i] * z[i + 1]
            for i in range(r, n - 1):
                z[i + 1] = -up[i] * z[i]
            z /= np.linalg.norm(z)
            for _ in range(2):
                for m in mates:
                    z = z - (m @ z) * m
            size = np.linalg.norm(z)
            if size > most:
                best, most = z / size if size else z, size
            if size > 0.3:
                break
        out.append(best)
    return np.array(out).T if out else np.zeros((n, 0))


def solve(r: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(directions as rows, eigenvalues, explained) of R'R / n, falling; values lost in rounding are left out."""
    d = r.shape[1]
    square = np.zeros((d, d))
    square[: len(r)] = r[:d]
    diagonal, above, v = bidiagonalise(square)
    values = squared_singular_values(diagonal, above)
    total = values.sum()
    top = values[:components]
    top = top[np.sqrt(top) > 8 * d * EPS * np.sqrt(values[0])] if total > 0 else top[:0]
    found = (v @ directions(diagonal, above, top)).T
    for row in found:
        row /= np.linalg.norm(row)
        row *= np.sign(row[np.argmax(np.abs(row))])
    return found, top / n, top / total if total > 0 else top


# ---- Spark side ----


def _reduce(n: int, sums: list[int], dims: int):
    def emit(batches):
        blocks = (
            _centred(_matrix(b.column(0).slice(at, BLOCK_ROWS), dims), n, sums) for b in batches for at in range(0, b.num_rows, BLOCK_ROWS)
        )
        r = _triangle(blocks)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    return emit


def _merge(dims: int):
    def merge(key, table):
        r = _triangle(np.frombuffer(x.as_buffer(), float).reshape(-1, dims) for x in table.column("r"))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    return merge


def _whitener(n: int, sums: list[int], directions: np.ndarray, eigenvalues: np.ndarray):
    dims, basis = len(sums), directions.T / np.sqrt(eigenvalues)

    def whitened(column: pa.Array) -> np.ndarray:
        return _centred(_matrix(column, dims), n, sums) @ basis

    return whitened


def _product_rows(whitened):
    def emit(batches):
        total = None
        for b in batches:
            w = whitened(b.column(0))
            w = np.hstack([w, np.ones((len(w), 1))])
            total = w.T @ w if total is None else total + w.T @ w
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "s"])

    return emit


def fit_whitening(vectors: DataFrame, vec: str = "vec", components: int = 16) -> Whitening:
    """Centre and directions over the distinct vectors of a column of fixed-point vectors (array of long).

    Every distinct usable vector of the commonest length counts once. Only numbers per dimension and one triangular
    factor reach the driver. ``identity_error`` is measured on the fit list: the largest absolute
    entry of the covariance of the whitened vectors minus the identity.

    Defined results: null vectors and vectors with a null or non-finite entry take no part, nor do those of another
    length; an empty table, empty vectors or one distinct vector give no component; directions without variance
    (below rounding) are left out, so there are at most as many components as dimensions; of equal eigenvalues any orthogonal directions.
    """
    dims = common_length(vectors, vec)
    good = vectors.where(usable(F.col(f"`{vec}`")) & (F.size(f"`{vec}`") == dims)).select(F.col(f"`{vec}`").cast("array<bigint>").alias("vec"))
    if not dims:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0)
    fit = cut_lineage(good.groupBy("vec").agg(F.count("*").alias("_n")).select("vec"))
    stats = fit.agg(F.count("*").alias("n"), *[F.sum(F.get("vec", F.lit(i))).alias(f"s{i}") for i in range(dims)]).first()
    n, sums = stats["n"], [stats[f"s{i}"] for i in range(dims)]
    factors = cut_lineage(fit.mapInArrow(_reduce(n, sums, dims), "part bigint, r binary"))
    while factors.count() > 1:  # numbers of a common range meet, so each round leaves a FAN_IN-th of the range
        factors = cut_lineage(factors.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInArrow(_merge(dims), "part bigint, r binary"))
    r = np.frombuffer(factors.first()["r"], float).reshape(-1, dims)
    found, eigenvalues, explained = solve(r, n, components)
    error = 0.0
    if len(found):
        k = len(found)
        got = fit.mapInArrow(_product_rows(_whitener(n, sums, found, eigenvalues)), "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
        table = np.zeros((k + 1, k + 1))
        for row in got.collect():  # (components + 1) squared numbers
            table[row["i"], row["j"]] = row["s"] / n
        error = float(np.abs(table[:k, :k] - np.outer(table[:k, k], table[k, :k]) - np.eye(k)).max())
    return Whitening(n, sums, found, eigenvalues, explained, error)


def whiten(vectors: DataFrame, model: Whitening, vec: str = "vec") -> DataFrame:
    """All columns and ``whitened``: the centred vector along each direction over the root of its eigenvalue.

    Defined results: every row stays; the result is null for a null vector, one with a null or non-finite entry or of another length than
    the model's, and empty without components; repeated rows get equal results; a column ``whitened`` is replaced.
    """
    dims, k = len(model.sums), len(model.directions)
    df = vectors.select(F.struct("*").alias("row"), F.col(f"`{vec}`").cast("array<bigint>").alias("vec"))
    fits = usable(F.col("vec")) & (F.size("vec") == dims)
    df = df.withColumn("vec", F.when(fits & F.lit(dims > 0), F.col("vec")))
    apply = _whitener(model.n, model.sums, model.directions, model.eigenvalues) if k else None

    def emit(batches):
        for b in batches:
            some = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            w = apply(b.column(1).drop_null()) if k else np.zeros((int(some.sum()), 0))
            offsets = np.concatenate([[0], np.cumsum(some) * k]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(w.ravel()), mask=pa.array(~some))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["row", "whitened"])

    schema = T.StructType([df.schema["row"]]).add("whitened", T.ArrayType(T.DoubleType()))
    return unpacked(df.mapInArrow(emit, schema), whitened="whitened")
