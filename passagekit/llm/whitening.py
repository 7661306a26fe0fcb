"""Whitening of vectors by Jacobi-Davidson.

The covariance is never formed: a Spark job multiplies it with a few columns
at once, each task summing centred rows times their products, and partial
sums are added up by position.  The driver holds matrices of a vector's
length times a few dozen columns.  Ritz pairs of a growing subspace come by
Rayleigh-Ritz; each unconverged pair adds a correction, from an equation
projected off the converged pairs and itself that MINRES solves; all
corrections share each multiplication.  Pairs are locked from the top once
their residuals are at double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read
from .vectors import block, lists, vectors

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Steps of MINRES for one correction, columns of the search space beyond the wanted ones, and rounds before giving up.
INNER, SPARE, MOST_ROUNDS = 6, 16, 200
#: Of the largest eigenvalue: variance below it is rounding.
NOTHING = 1e-13

Multiply = Callable[[np.ndarray], np.ndarray]


def _whole(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(SCALE * block(batch.column(1), width)) + SHIFT
            if x.size and np.abs(x).max() >= 1 << 53:
                raise ValueError("a component is too large to become a whole number exactly")
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(x.astype(np.int64), pa.int64())], ["vec_id", "x"])

    return run


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact: 64-bit numbers where they fit, else Python's."""
    if x.size and n * int(np.abs(x).max()) + int(np.abs(sums.astype(object)).max()) >= 1 << 62:
        return x.astype(object) * n - sums.astype(object)
    return x * n - sums.astype(np.int64)


def _deviations(y: np.ndarray) -> list[int]:
    """Sums of squares of rows, exact."""
    if y.dtype == object or (y.size and int(np.abs(y).max()) ** 2 * y.shape[1] >= 1 << 62):
        y = y.astype(object)
    return [int(v) for v in (y * y).sum(axis=1)]


def _emitted(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["at", "value"])


def _summed(fit: DataFrame, task: Callable, rows: int, columns: int) -> np.ndarray:
    """The matrix whose entries every task gives a share of."""
    found = fit.mapInArrow(task, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(rows * columns)
    for r in found:  # rows times columns of them, whatever the data
        out[r["at"]] = r["value"]
    return out.reshape(rows, columns)


def covariance_times(fit: DataFrame, n: int, sums: np.ndarray) -> Multiply:
    """The covariance of ``fit`` (x) times a block of columns, as one job; divisor n, rows centred before anything is multiplied."""
    width = len(sums)

    def multiply(columns: np.ndarray) -> np.ndarray:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    c = (centred(block(batch.column(0), width), n, sums) / n).astype(float)
                    part = c.T @ (c @ columns)
                    total = part if total is None else total + part
            yield from _emitted(total)

        return _summed(fit.select("x"), task, width, columns.shape[1]) / n

    return multiply


def _off(basis: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """``columns`` less their part in the orthonormal ``basis``; twice, against rounding."""
    for _ in range(2):
        columns = columns - basis @ (basis.T @ columns)
    return columns


def minres(multiply: Multiply, values: np.ndarray, locked: np.ndarray, ritz: np.ndarray, residuals: np.ndarray, steps: int) -> np.ndarray:
    """Approximate corrections t of P (A - value) P t = -residual, P off ``locked`` and the own Ritz vector: a column each.

    Lanczos with running rotations, all columns in step: one multiplication
    a step for all of them.
    """

    def projected(columns: np.ndarray) -> np.ndarray:
        columns = _off(locked, columns) if locked.shape[1] else columns
        for _ in range(2):
            columns = columns - ritz * (ritz * columns).sum(axis=0)
        return columns

    size = lambda columns: np.sqrt((columns * columns).sum(axis=0))
    over = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
    v = projected(-residuals)
    beta = size(v)
    v, before = over(v, np.broadcast_to(beta, v.shape)), np.zeros_like(v)
    x, d1, d2 = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    c1, s1, c2, s2 = np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    last, eta = np.zeros_like(beta), beta.copy()
    for _ in range(steps):
        w = projected(multiply(v) - v * values) - before * last
        alpha = (v * w).sum(axis=0)
        w = projected(w - v * alpha)
        after = size(w)
        r3, t = s2 * last, c2 * last
        r2, r1_ = c1 * t + s1 * alpha, c1 * alpha - s1 * t
        r1 = np.hypot(r1_, after)
        c, s = over(r1_, np.abs(r1)), over(after, r1)
        d = over(v - d1 * r2 - d2 * r3, np.broadcast_to(r1, v.shape))
        x = x + d * (c * eta)
        eta = -s * eta
        d1, d2, c1, s1, c2, s2 = d, d1, c, s, c1, s1
        before, v, last = v, over(w, np.broadcast_to(after, w.shape)), after
    return x


def _grown(space: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Orthonormal columns that ``columns`` add to the orthonormal ``space``; those that add nothing are left out."""
    kept = space
    for column in columns.T:
        length = np.linalg.norm(column)
        if length == 0 or kept.shape[1] == len(column):
            continue
        rest = _off(kept, column[:, None] / length)
        if (left := np.linalg.norm(rest)) > 1e-8:
            kept = np.hstack([kept, _off(kept, rest / left) / np.linalg.norm(_off(kept, rest / left))])
    return kept[:, space.shape[1] :]


def eigenpairs(multiply: Multiply, width: int, wanted: int, inner: int = INNER, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the ``wanted`` largest eigenvalues, in falling order, by block Jacobi-Davidson.

    A pair is locked when its residual is at most ``width`` units in the last
    place of the largest eigenvalue, or when the search space is the whole
    space, where Rayleigh-Ritz is exact but for rounding.
    """
    wanted = min(wanted, width)
    rng = np.random.default_rng(seed)
    most, extra = min(width, 3 * wanted + SPARE), min(width, wanted + SPARE // 2)
    locked, values = np.zeros((width, 0)), np.zeros(0)
    space = _grown(np.zeros((width, 0)), rng.normal(size=(width, extra)))
    image = multiply(space)
    for _ in range(MOST_ROUNDS):
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, image_ritz = space @ turn, image @ turn
        residuals = _off(locked, image_ritz - ritz * theta) if locked.shape[1] else image_ritz - ritz * theta
        norms, top = np.linalg.norm(residuals, axis=0), max(values.max(initial=0.0), theta[0], 0.0)
        open_ = wanted - locked.shape[1]
        full = locked.shape[1] + space.shape[1] == width
        good = (norms <= width * np.finfo(float).eps * top) | full
        n = int(np.argmin(good[:open_])) if not good[:open_].all() else open_
        locked, values = np.hstack([locked, ritz[:, :n]]), np.concatenate([values, theta[:n]])
        if n == open_:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        space, image, theta = ritz[:, n:], image_ritz[:, n:], theta[n:]
        residuals, norms, open_ = residuals[:, n:], norms[n:], open_ - n
        if space.shape[1] + open_ > most - locked.shape[1] and most < width:
            space, image = space[:, : open_ + SPARE // 2], image[:, : open_ + SPARE // 2]
        at = np.flatnonzero(norms[:open_] > width * np.finfo(float).eps * top)
        t = minres(multiply, theta[at], locked, space[:, at], residuals[:, at], inner)
        base = np.hstack([locked, space])
        fresh = _grown(base, t)
        if not fresh.shape[1]:  # corrections add nothing: a new direction instead
            fresh = _grown(base, rng.normal(size=(width, open_)))
        space, image = np.hstack([space, fresh]), np.hstack([image, multiply(fresh)])
    raise RuntimeError(f"{wanted - locked.shape[1]} eigenpairs did not converge in {MOST_ROUNDS} rounds")


def _projected(n: int, sums: np.ndarray, basis: np.ndarray, scale: np.ndarray) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Exact centred rows of a column of x, and their whitened coordinates."""

    def run(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        y = centred(block(column, len(sums)), n, sums)
        return y, (y / n).astype(float) @ basis / scale

    return run


def identity_error(fit: DataFrame, n: int, project: Callable, count: int) -> float:
    """The largest absolute entry of the covariance of whitened rows less the identity; their mean comes first, and off."""

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = project(batch.column(0))[1].sum(axis=0)
                total = part if total is None else total + part
        yield from _emitted(total)

    middle = _summed(fit.select("x"), mean, 1, count)[0] / n

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                w = project(batch.column(0))[1] - middle
                total = w.T @ w if total is None else total + w.T @ w
        yield from _emitted(total)

    return float(np.abs(_summed(fit.select("x"), product, count, count) / n - np.eye(count)).max())


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component up to ``components``.

    x: the floor of 64 times each entry, plus 1,000,000.  n vectors and their
    sums give the centring, exact in whole numbers; deviation (decimal(38,0))
    is the sum of the squares of n * x - sums.  Components are the covariance's
    eigenvectors by falling eigenvalue, their largest entry positive;
    whitened has no variance but 1 along each.  Where the covariance has no
    variance left (fewer vectors than components, equal vectors), whitened is
    null and explained 0, and identity_error is that of the other components.
    Null vectors and those with null or non-finite entries are left out, and so
    are those of another length than most (of equally many the longest); rows
    that repeat an id, and null ids, are vectors of their own.  No vectors: no
    rows.
    """
    spark = table.sparkSession
    shape = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = vectors(table, id_col, vector_col).filter(F.size("v") > 0)
    lengths = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "width")).alias("m")).first()["m"]
    if lengths is None:
        return spark.createDataFrame([], shape)
    n, width = lengths["n"], lengths["width"]
    fit = cut(rows.filter(F.size("v") == width).mapInArrow(_whole(width), "vec_id long, x array<long>"), "whitening-fit")
    totals = fit.agg(*[F.sum(F.get("x", F.lit(i)).cast("decimal(19,0)")).alias(f"s{i}") for i in range(width)]).first()
    sums = np.array([int(totals[f"s{i}"]) for i in range(width)], object)
    if all(-(1 << 63) <= s < 1 << 63 for s in sums):
        sums = sums.astype(np.int64)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            y = centred(block(batch.column(0), width), n, sums) / n
            total += float((y * y).sum())
        yield from _emitted(np.array([total]))

    trace = _summed(fit.select("x"), squares, 1, 1)[0, 0] / n
    values, basis = eigenpairs(covariance_times(fit, n, sums), width, components)
    basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])] < 0, -1.0, 1.0)
    real = int((values > NOTHING * max(trace, 0.0)).sum()) if trace > 0 else 0
    project = _projected(n, sums, basis[:, :real], np.sqrt(values[:real]))
    error = identity_error(fit, n, project, real) if real else 0.0
    explained = [float(v / trace) if k < real else 0.0 for k, v in enumerate(values)]
    count, decimal = len(values), pa.decimal128(38, 0)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, w = project(batch.column(1))
            m = batch.num_rows
            each = np.full((m, count), np.nan)
            each[:, :real] = w
            white = pa.array(each.ravel(), mask=np.tile(np.arange(count) >= real, m))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), count)))
            deviation = pa.array(_deviations(y), decimal).take(pa.array(np.repeat(np.arange(m), count)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)), pa.array(np.full(m * count, n)), deviation, white, pa.array(np.tile(explained, m)), pa.array(np.full(m * count, error))],
                [c.split()[0] for c in shape.split(", ")],
            )

    return fit.mapInArrow(out, shape)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that no long holds is null."""
    return whiten(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))
