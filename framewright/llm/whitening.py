"""Embedding whitening: vectors projected on the leading components of their covariance, each with variance one.

The covariance is that of the fit list: every distinct vector once, in whole steps of 1/256. The components come from a
pivoted Cholesky factor of the centred scatter: one-sided Jacobi rotations make the columns of the triangular factor
orthogonal, whose norms then give the eigenvalues and whose directions the components.

Spark does what grows with the rows: finding the distinct vectors, their sums, scatter and whitened covariance. The driver
gets sums over all rows only, which are as long as a vector or as a square of it.

Vectors that are null or hold a null or non-finite entry have no result, nor do vectors whose length is not the most
common one among the distinct vectors (the longest of these on ties): they have no covariance with the rest. Components
without variance don't exist, so equal vectors, a single one or an empty table give none. Repeated rows each have a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .store import free_name, stored

#: Steps of a unit.
STEPS = 256
#: Rotations end when no two columns are nearer to each other than this share of their norms.
ORTHOGONAL, SWEEPS = 1e-15, 60

_KINDS = [np.int8, np.int16, np.int32, np.int64]


@dataclass
class Whitening:
    """``n``: distinct vectors; ``sums``: theirs by dimension; ``components``: a row each; ``values``: their eigenvalues of
    the covariance; ``explained``: shares of its trace; ``identity_error``: of the whitened fit list's covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float


def _usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows whose vectors have finite entries only, all their entries, lengths)."""
    lists = column.cast(pa.large_list(pa.float64()))
    sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    entries = lists.flatten().to_numpy(zero_copy_only=False)
    good = np.isfinite(entries)
    bad = np.zeros(len(sizes), np.int64)
    np.add.at(bad, np.repeat(np.arange(len(sizes)), sizes)[~good], 1)
    keep = (bad == 0) & (sizes > 0)
    return np.flatnonzero(keep), entries[np.repeat(keep, sizes)], sizes[keep]


def _stepped(entries: np.ndarray) -> np.ndarray:
    return np.floor(entries * STEPS).astype(np.int64)


def _packed(x: np.ndarray) -> bytes:
    """A vector in the narrowest integers that hold it, so that equal vectors have equal bytes; the first byte tells them."""
    low, high = x.min(), x.max()
    kind = next(k for k, t in enumerate(_KINDS) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return bytes([kind]) + x.astype(_KINDS[kind]).tobytes()


def _unpacked(blobs: list[bytes]) -> np.ndarray:
    return np.array([np.frombuffer(b, _KINDS[b[0]], offset=1) for b in blobs], np.int64)


def _distinct(vectors: DataFrame, column: str) -> DataFrame:
    """(x, d): every distinct vector once, and its length. Repeats within a task go before the shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, entries, sizes = _usable(batch.column(0))
            x = _stepped(entries)
            blobs = [_packed(v) for v in np.split(x, np.cumsum(sizes)[:-1])] if len(sizes) else []
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(sizes.astype(np.int32))], ["x", "d"])

    return vectors.select(F.col(column)).mapInArrow(pack, "x binary, d int").distinct()


def _summed(fit: DataFrame, partial, size: int) -> np.ndarray:
    """Sums over all tasks of the arrays of ``size`` that ``partial`` makes of whole numbers of vectors; integers are exact."""
    kind = partial(np.zeros((0, fit.first()["d"]), np.int64)).dtype
    name = "long" if kind == np.int64 else "double"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for batch in batches:
            if len(batch):
                total += partial(_unpacked(batch.column("x").to_pylist())).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["k", "v"])

    rows = fit.mapInArrow(sums, f"k int, v {name}").groupBy("k").agg(F.sum("v").alias("v"))
    found = rows.toArrow()
    out = np.zeros(size, kind)
    out[found["k"].to_numpy()] = found["v"].to_numpy()
    return out


def cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) of a symmetric matrix without negative eigenvalues: ``a[order][:, order]`` is L times its transpose. Each
    step takes the largest diagonal entry left; it ends when what is left is rounding."""
    a, d = a.copy(), len(a)
    order, factor = np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(a.diagonal().max(initial=0.0), 0.0)
    left = a.diagonal().copy()
    for k in range(d):
        p = k + int(np.argmax(left[k:]))
        if left[p] <= least:
            return factor[:, :k], order
        for rows in (order, left, factor):
            rows[[k, p]] = rows[[p, k]]
        factor[k, k] = np.sqrt(left[k])
        below = slice(k + 1, d)
        factor[below, k] = (a[order[below], order[k]] - factor[below, :k] @ factor[k, :k]) / factor[k, k]
        left[below] -= factor[below, k] ** 2
    return factor, order


def rotated(factor: np.ndarray) -> np.ndarray:
    """One-sided Jacobi: the factor times a rotation that makes its columns orthogonal. Each turn of a round robin takes
    pairs of columns that have none in common, all at once."""
    u, r = factor.copy(), factor.shape[1]
    if r < 2:
        return u
    seats = list(range(r)) + ([-1] if r % 2 else [])  # -1 sits out
    for _ in range(SWEEPS):
        worst, half = 0.0, len(seats) // 2
        for _ in range(len(seats) - 1):
            pairs = [(min(i, j), max(i, j)) for i, j in zip(seats[:half], reversed(seats[half:])) if i >= 0 and j >= 0]
            p, q = (np.array(side) for side in zip(*pairs))
            left, right = u[:, p], u[:, q]
            a, b, c = (left * left).sum(0), (right * right).sum(0), (left * right).sum(0)
            size = np.sqrt(a * b)
            share = np.divide(np.abs(c), size, out=np.zeros_like(c), where=size > 0)
            worst = max(worst, share.max())
            turn = share > ORTHOGONAL
            half_cot = np.divide(b - a, 2 * c, out=np.zeros_like(c), where=turn)
            t = np.where(half_cot < 0, -1.0, 1.0) / (np.abs(half_cot) + np.hypot(1.0, half_cot))
            t = np.where(turn, t, 0.0)
            cos = 1 / np.hypot(1.0, t)
            u[:, p], u[:, q] = cos * (left - t * right), cos * (right + t * left)
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if worst <= ORTHOGONAL:
            break
    return u


def components(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as rows) of a scatter matrix, those without variance left out. Of each
    vector's two signs the one whose largest entry is positive."""
    factor, order = cholesky(scatter)
    if not factor.shape[1]:
        return np.empty(0), np.empty((0, len(scatter)))
    turned = rotated(factor)
    norms = np.sqrt((turned * turned).sum(0))
    falling = np.argsort(-norms, kind="stable")
    vectors = np.empty((len(falling), len(scatter)))
    vectors[:, order] = (turned[:, falling] / norms[falling]).T
    largest = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)]
    return norms[falling] ** 2, vectors * np.sign(largest)[:, None]


def fit_whitening(vectors: DataFrame, column: str = "embedding", most: int = 4) -> Whitening | None:
    """The whitening of a table of vectors with up to ``most`` components; None without a usable vector."""
    every = stored(_distinct(vectors, column))
    lengths = every.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return None
    d, n = lengths["d"], lengths["n"]
    fit = every.filter(F.col("d") == d)
    sums = _summed(fit, lambda x: x.sum(0, dtype=np.int64), d)
    mean = sums / n

    def scatter(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    total = _summed(fit, scatter, d * d).reshape(d, d)
    squares, found = components((total + total.T) / 2)
    values, found = squares[:most] / n, found[:most]
    explained = values / (total.trace() / n) if len(values) else values
    k = len(values)

    def whitened(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ found.T / np.sqrt(values)
        return np.concatenate([z.sum(0), (z.T @ z).ravel()])

    error = 0.0
    if k:
        moments = _summed(fit, whitened, k + k * k) / n
        off = moments[k:].reshape(k, k) - np.outer(moments[:k], moments[:k]) - np.eye(k)
        error = float(np.abs(off).max())
    return Whitening(n, sums, found, values, explained, error)


def whiten(vectors: DataFrame, model: Whitening | None, column: str = "embedding") -> DataFrame:
    """The usable rows, with ``whitened`` (array of doubles, a component each) and ``deviation`` (the sum over dimensions of
    (n * x - S) squared, exact; null where a long can't hold it). All other columns stay; columns of these two names are
    replaced."""
    kept = vectors.drop("whitened", "deviation")
    if model is None:
        return kept.filter("false").withColumns({"whitened": F.array().cast("array<double>"), "deviation": F.lit(0).cast("long")})
    row = free_name(kept, "_vector")
    mean, d = model.sums / model.n, len(model.sums)
    scaled = model.components.T / np.sqrt(model.values)
    fields = [*kept.schema.fields, StructField("whitened", ArrayType(DoubleType())), StructField("deviation", LongType())]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, entries, sizes = _usable(batch.column(row))
            same = sizes == d
            x = _stepped(entries[np.repeat(same, sizes)]).reshape(-1, d)
            kept_rows = batch.take(pa.array(rows[same])).drop_columns([row])
            z = (x - mean) @ scaled
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
            # of such a size that squares can pass a long: then by Python's own integers
            small = (np.abs((model.n * x.astype(float) - model.sums)).max(initial=0.0) ** 2) * d < 2.0**62
            off = (model.n * x - model.sums) if small else (model.n * x.astype(object) - model.sums)
            squares = [int(s) for s in (off * off).sum(1)]
            deviation = pa.array([s if s < 2**63 else None for s in squares], pa.int64())
            yield pa.RecordBatch.from_arrays([*kept_rows.columns, lists, deviation], [f.name for f in fields])

    return kept.withColumn(row, F.col(column)).mapInArrow(project, StructType(fields))
