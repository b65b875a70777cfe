"""Embedding whitening by matrix-free block Lanczos.

The covariance is never formed: each step of the iteration sends one block of vectors ``Q``
to the tasks, which centre their rows, add up ``Zt (Z Q)`` and pass sums on by a shuffle on
the dimension. The driver holds a basis of at most ``MOST_BASIS`` vectors (or four times the
block and the components, if that is more) and its image. New blocks are reorthogonalised
against the whole basis, twice; a direction that vanishes (breakdown) is replaced by a random
one, so eigenvalues of any multiplicity are met. It ends by the residuals ``|C v - e v|``
themselves, or when the basis spans all dimensions, where they are zero. A basis that is full
is restarted from its best Ritz vectors. The trace comes from the rows' deviations.

The fit list is each distinct integer vector once; it is written to the shared folder, and
every pass reads it there. Rows are centred exactly: by the whole part of the mean in
integers, then by its fraction.

Defined cases: a null vector, or one that holds a null, a NaN or an infinity, is left out; a
vector that is shorter than the longest counts as if zeros followed; ``64 * c`` beyond 2^61
counts as 2^61; a deviation beyond a long is null; null and repeated ids give one result a
row and component; directions in which the fit list has no variance (at most ``RANK_TOL`` of
the largest eigenvalue) are no components, so one distinct vector, or none, gives an empty
result; which basis a tied eigenvalue gets is open, but it is the same for all rows; other
columns are left out, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm.common import discard, materialise, release_memory, ship_package, table

COMPONENTS, BLOCK, MOST_BASIS, RESIDUAL, RANK_TOL = 16, 16, 256, 1e-13, 1e-10
#: Fixed values of the integer vectors: x = floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
_MOST = 1 << 61
#: Rows that are centred at once.
_ROWS = 1024


@dataclass
class Whitening:
    """What a fit gives: the fit list's size and sums, eigenvalues by falling size, components as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0
    passes: int = 0

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``vec_id`` and ``x`` of every row whose vector is whole, all ``x`` of one length."""
    thin = rows.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    whole = thin.filter("e is not null and not exists(e, c -> c is null or isnan(c) or abs(c) = double('infinity'))")
    x = whole.select("vec_id", F.expr(f"transform(e, c -> least(greatest(floor({scale}D * c), -{_MOST}L), {_MOST}L) + {offset}L)").alias("x"))
    longest = x.agg(F.max(F.size("x"))).first()[0] or 0
    return x.withColumn("x", F.expr(f"concat(x, array_repeat({offset}L, {longest} - size(x)))"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _summed(fit: DataFrame, add: Callable[[np.ndarray, np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of what ``add(total, x)`` adds to a matrix of ``shape``, for blocks ``x`` of rows."""
    ship_package(fit.sparkSession)
    n_rows, n_cols = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            x = _matrix(batch.column(0))
            for k in range(0, len(x), _ROWS):
                total = add(total, x[k : k + _ROWS])
        cells = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), n_cols).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_rows, dtype=np.int32)), cells], names=["row", "cells"])
        release_memory()

    parts = fit.select("x").mapInArrow(run, "row int, cells array<double>")
    found = parts.groupBy("row").agg(*[F.sum(F.col("cells")[k]).alias(f"c{k}") for k in range(n_cols)]).collect()
    out = np.zeros(shape)
    for r in found:
        out[r["row"]] = r[1:]
    return out


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """How many rows there are, and the exact sum of each dimension."""
    sums = fit.agg(F.count(F.lit(1)), *[F.sum(F.col("x")[k].cast("decimal(38,0)")) for k in range(width)]).first()
    return sums[0], [int(s or 0) for s in sums[1:]]


def centring(n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """Rows minus the mean, as doubles."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    part = np.array([(s % n) / n for s in sums])
    return lambda x: (x - whole).astype(np.float64) - part


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """For each row the exact sum over dimensions of ``(n * x - S) ** 2``."""
    whole, rest = np.array([s // n for s in sums], dtype=np.int64), np.array([s % n for s in sums], dtype=np.int64)
    apart = x - whole
    reach = (float(np.abs(apart).max(initial=0)) + 1) * n
    if reach * reach * max(x.shape[1], 1) < 2.0**62:
        far = apart * n - rest
        return (far * far).sum(axis=1).tolist()
    far = apart.astype(object) * n - rest.astype(object)
    return [int(v) for v in (far * far).sum(axis=1)]


def orthonormal(block: np.ndarray, basis: np.ndarray, width: int, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """``width`` unit vectors that span ``block`` as far as ``basis`` doesn't, and how many of them are random instead."""
    scale, n_random = np.linalg.norm(block, 2) if block.size else 0.0, 0
    out = np.zeros((len(basis), 0))
    while out.shape[1] < width:
        known = np.hstack([basis, out])
        for _ in range(2):
            block = block - known @ (known.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        new = u[:, s > 1e-12 * scale][:, : width - out.shape[1]] if scale > 0 else u[:, :0]
        for _ in range(2):
            new = new - known @ (known.T @ new)
        out = np.hstack([out, np.linalg.qr(new)[0]]) if new.size else out
        if out.shape[1] < width:
            block = rng.standard_normal((len(basis), width - out.shape[1]))
            scale, n_random = np.linalg.norm(block, 2), n_random + block.shape[1]
    return out, n_random


def block_lanczos(multiply: Callable[[np.ndarray], np.ndarray], width: int, k: int, block: int = BLOCK, tol: float = RESIDUAL, most: int = MOST_BASIS, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``k`` largest eigenvalues of a symmetric operator, their unit eigenvectors as columns, and the passes it took."""
    rng = np.random.default_rng(seed)
    most = max(most, 4 * (k + block))
    basis = image = np.zeros((width, 0))
    following, _ = orthonormal(rng.standard_normal((width, block)), basis, min(block, width), rng)
    probed, passes, last = True, 0, np.inf
    while True:
        got = multiply(following)
        passes += 1
        basis, image = np.hstack([basis, following]), np.hstack([image, got])
        small = basis.T @ image
        values, ritz = np.linalg.eigh((small + small.T) / 2)
        values, ritz = values[::-1], ritz[:, ::-1]
        top = min(k, len(values))
        residual = np.linalg.norm(image @ ritz[:, :top] - basis @ ritz[:, :top] * values[:top], axis=0).max()
        room = width - basis.shape[1]
        if room == 0:
            break
        following, n_random = orthonormal(got, basis, min(block, room), rng)
        # After a breakdown one block of random directions is tried before the space counts as closed.
        if len(values) >= k and residual <= tol * max(values[0], 0) and (n_random == 0 or probed):
            break
        probed = n_random > 0
        if basis.shape[1] + block > most:
            if residual > last / 2:  # as small as sums in double precision get
                break
            last, keep = residual, k + block
            basis, image = basis @ ritz[:, :keep], image @ ritz[:, :keep]
    vectors = basis @ ritz[:, :top]
    return values[:top], vectors / np.linalg.norm(vectors, axis=0), passes


def fit(vectors: DataFrame, k: int = COMPONENTS, block: int = BLOCK, tol: float = RESIDUAL, most: int = MOST_BASIS) -> Whitening | None:
    """The whitening of the distinct ``x`` of ``vectors``; None where there is nothing to fit."""
    distinct = materialise(vectors.select("x").distinct())
    first = distinct.first()
    width = len(first["x"]) if first else 0
    if width == 0:
        return None
    n, sums = _sums(distinct, width)
    centre = centring(n, sums)

    def multiply(q: np.ndarray) -> np.ndarray:
        def add(total: np.ndarray, x: np.ndarray) -> np.ndarray:
            z = centre(x)
            return total + z.T @ (z @ q)

        return _summed(distinct, add, (width, q.shape[1])) / n

    spread = _summed(distinct, lambda total, x: total + sum(v / n / n for v in deviations(x, n, sums)), (1, 1))
    trace = float(spread[0, 0]) / n
    values, components, passes = block_lanczos(multiply, width, min(k, width), block, tol, most)
    there = values > max(RANK_TOL * values[0], 0)
    model = Whitening(n, sums, values[there], components[:, there], trace, passes=passes)
    size = len(model.values)
    if size:
        project = model.vectors / np.sqrt(model.values)

        def products(total: np.ndarray, x: np.ndarray) -> np.ndarray:
            w = centre(x) @ project
            return total + np.vstack([w.T @ w, w.sum(axis=0)])

        got = _summed(distinct, products, (size + 1, size)) / n
        model.identity_error = float(np.abs(got[:size] - np.outer(got[size], got[size]) - np.eye(size)).max())
    discard(distinct)
    return model


def whiten(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """A row for each row of ``vectors`` (``vec_id``, ``x``) and component."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    ship_package(vectors.sparkSession)
    size, centre = len(model.values), centring(model.n, model.sums)
    project, explained = model.vectors / np.sqrt(model.values), model.explained

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(k, _ROWS)
                x, m = _matrix(batch.column(1)), batch.num_rows
                away = pa.array([v if v < 1 << 63 else None for v in deviations(x, model.n, model.sums)], pa.int64())
                each = pa.array(np.repeat(np.arange(m), size))
                columns = [
                    batch.column(0).take(each), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), m)), pa.array(np.full(m * size, model.n)), away.take(each),
                    pa.array((centre(x) @ project).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * size, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        release_memory()

    return vectors.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return whiten(vectors, fit(vectors))


#: Eigenvectors can't be written in SQL; tests/llm/test_whitening.py compares with a dense solver.
ORACLE = None
