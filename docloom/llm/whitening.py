"""Embedding whitening by Jacobi-Davidson.

Vectors become whole numbers, ``x = floor(64 c) + 1000000``; each distinct one counts once in the fit. The covariance
matrix is never formed: the solver only sees its product with a few columns, one Spark job over the distinct vectors,
which lie packed in blocks of ``BLOCK``. Differences from the mean are ``(n x - S) / n``, exact before the division.

``leading`` finds the largest eigenpairs. A search space holds approximations; Rayleigh-Ritz in it gives the best pairs,
and those whose residual is below ``TOLERANCE`` of the largest eigenvalue are locked and kept out from then on. For the
others, the correction equation ``(I - Q Q')(V - e I)(I - Q Q') t = -r``, with Q the locked and the wanted vectors, is
solved approximately by MINRES; all columns share one product a step. Corrections join the search space, which restarts
from its best vectors when it is full. When enough pairs are locked, a search from random vectors beside them makes sure
that no larger one was missed, and residuals are taken anew from the operator itself.

A product's partial sums are as large as its columns; beyond ``PARTIALS`` parts they are added up by Spark first, so what
reaches the driver does not grow with the data. Dimensions are those of an embedding: a search space of some tens of
columns is small.

Null vectors and those with null, infinite or not-a-number entries are left out, and so are those of another length than
most have (ties: the longer; empty ones never count). Null and repeated vec_ids are rows of their own. Entries beyond
2^62 / 64 saturate; a deviation beyond a long is null. Components of a variance of zero (below rounding) have no rows, so
a table with fewer than two distinct vectors gives none.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, sliced, table

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
BLOCK, PARTIALS = 4_096, 64
#: Columns beside the wanted ones, steps and reduction of an inner solve, and the residual at which a pair is locked.
GUARD, INNER, REDUCTION, TOLERANCE = 4, 12, 1e-3, 32 * np.finfo(float).eps
_SAFE = 1 << 62
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# ---- the solver, on the driver; ``product`` is distributed ----------------------------------------------------------


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int = INNER, reduction: float = REDUCTION) -> np.ndarray:
    """Approximate solutions of ``apply(x) = b``, symmetric for each column by itself."""
    beta = first = np.linalg.norm(b, axis=0)
    v, v_old, x = b / np.where(beta > 0, beta, 1), np.zeros_like(b), np.zeros_like(b)
    w, w_old, eta = np.zeros_like(b), np.zeros_like(b), beta.copy()
    c, s, c_old, s_old = np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    before = np.zeros_like(beta)
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - before * v_old
        beta = np.linalg.norm(p, axis=0)
        delta, upper, top = c * alpha - c_old * s * before, s * alpha + c_old * c * before, s_old * before
        size = np.hypot(delta, beta)
        safe = np.where(size > 0, size, 1)
        c_old, s_old, c, s = c, s, delta / safe, beta / safe
        w, w_old = np.where(size > 0, (v - top * w_old - upper * w) / safe, 0), w
        x = x + c * eta * w
        eta = -s * eta
        v, v_old, before = p / np.where(beta > 0, beta, 1), v, beta
        if (abs(eta) <= reduction * first).all():
            break
    return x


def _orthogonal(columns: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns add to orthonormal bases."""
    size = np.linalg.norm(columns, axis=0)
    columns = columns[:, size > 0] / size[size > 0]
    for _ in range(2):
        for q in bases:
            columns = columns - q @ (q.T @ columns)
    u, s, _ = np.linalg.svd(columns, full_matrices=False)
    u = u[:, s > 1e-10]
    for q in bases:
        u = u - q @ (q.T @ u)
    return np.linalg.qr(u)[0] if u.size else u


def leading(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, seed: int = 0, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of the positive semidefinite operator."""
    random = np.random.default_rng(seed)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    space = _orthogonal(random.standard_normal((d, min(d, wanted + GUARD))))
    image = product(space)
    checked = False
    for _ in range(most):
        ritz, turn = np.linalg.eigh((h := space.T @ image) / 2 + h.T / 2)
        order = np.argsort(-ritz)
        ritz, space, image = ritz[order], space @ turn[:, order], image @ turn[:, order]
        missing = wanted - len(values)
        scale = max([0.0, *abs(ritz[:1]), *values[:1]])
        if checked:  # nothing beside the locked pairs may be larger than they are
            if not (ritz[:GUARD] > values.min() + 1e-9 * scale).any():
                break
            missing = GUARD
        rest = image[:, :missing] - space[:, :missing] * ritz[:missing]
        rest = rest - locked @ (locked.T @ rest)
        done = np.linalg.norm(rest, axis=0) <= TOLERANCE * scale
        if done.any():
            at = np.flatnonzero(done)
            locked, values = np.hstack([locked, space[:, at]]), np.append(values, ritz[at])
            keep = np.setdiff1d(np.arange(len(ritz)), at)
            ritz, space, image, rest = ritz[keep], space[:, keep], image[:, keep], rest[:, ~done]
        if len(values) >= wanted:
            order = np.argsort(-values)
            locked, values = locked[:, order], values[order]
            if len(values) >= d:
                break
            space = _orthogonal(np.hstack([space, random.standard_normal((d, min(GUARD, d - len(values))))]), locked)
            image, checked = product(space), True
            continue
        held = np.hstack([locked, space[:, : rest.shape[1]]])
        shift = ritz[: rest.shape[1]]

        def beside(y: np.ndarray, held=held) -> np.ndarray:
            return y - held @ (held.T @ y)

        correction = minres(lambda v, shift=shift: beside(product(v) - shift * v), -beside(rest))
        if space.shape[1] + correction.shape[1] > min(d - len(values), 3 * wanted):
            space, image = space[:, : rest.shape[1] + GUARD], image[:, : rest.shape[1] + GUARD]
        new = _orthogonal(correction, locked, space)
        if not new.size:
            new = _orthogonal(random.standard_normal((d, GUARD)), locked, space)
        space = np.hstack([space, new])
        image = np.hstack([image, product(new)]) if new.size else product(space)
    if len(values) < wanted:
        raise ArithmeticError(f"{len(values)} of {wanted} eigenpairs after {most} rounds")
    # once more with the operator itself
    image = product(locked)
    ritz, turn = np.linalg.eigh((h := locked.T @ image) / 2 + h.T / 2)
    order = np.argsort(-ritz)[:wanted]
    vectors = locked @ turn[:, order]
    return ritz[order], vectors / np.linalg.norm(vectors, axis=0)


# ---- the covariance as a distributed operator -----------------------------------------------------------------------


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n x - S, exactly: as 64-bit integers where they fit, as Python's else."""
    high = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), max(map(abs, total), default=0) // max(n, 1) + 1)
    if 2 * n * high < _SAFE:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array of longs) of the vectors that take part."""
    number = F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), number.alias("c")).where("c is not null and size(c) > 0")
    rows = rows.where(~F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    limit = F.lit(float(_SAFE))
    return rows.select("vec_id", F.transform("c", lambda c: F.floor(F.greatest(F.least(c * SCALE, limit), -limit)) + F.lit(SHIFT)).alias("x"))


def packed(rows: DataFrame, d: int) -> DataFrame:
    """The distinct vectors x of ``rows`` as blocks of ``BLOCK`` vectors of little-endian longs."""

    def work(batches):
        for b in batches:
            for k in range(0, b.num_rows, BLOCK):
                x = b.column(0).slice(k, BLOCK).flatten().to_numpy(zero_copy_only=False).astype("<i8")
                yield pa.record_batch([pa.array([x.tobytes()], pa.binary()), pa.array([len(x) // d])], ["block", "n"])

    return rows.select("x").distinct().mapInArrow(work, "block binary, n long")


class Fit:
    """Sums over the distinct vectors: ``n``, ``total`` (S, Python integers) and the products with the covariance."""

    def __init__(self, blocks: DataFrame, d: int):
        self.blocks, self.d, self.parts = blocks, d, blocks.rdd.getNumPartitions()
        self.n = int(blocks.agg(F.sum("n")).first()[0] or 0)

        def sums(batches):
            for b in batches:
                for data in b.column(0):
                    x = np.frombuffer(data.as_buffer(), "<i8").reshape(-1, d)
                    x = x if abs(x).max() < 1 << 40 else x.astype(object)
                    yield pa.record_batch([pa.array(range(d), pa.int32()), pa.array([str(t) for t in x.sum(axis=0)])], ["k", "s"])

        parts = blocks.mapInArrow(sums, "k int, s string").groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        found = {r["k"]: int(r["s"]) for r in parts.collect()}  # one row for each dimension
        self.total = [found.get(k, 0) for k in range(d)]

    def summed(self, per_block: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum of ``per_block`` (of centred vectors, as doubles) over all blocks: ``size`` doubles."""
        n, total, d = self.n, self.total, self.d

        def work(batches):
            own = np.zeros(size)
            for b in batches:
                for data in b.column(0):
                    own += per_block(centred(np.frombuffer(data.as_buffer(), "<i8").reshape(-1, d), n, total).astype(float) / n).ravel()
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["part", "sums"])

        def added(batches):
            own = np.zeros(size)
            for b in batches:
                for x in b.column(1):
                    own += np.frombuffer(x.as_py(), float)
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["part", "sums"])

        sums = self.blocks.select("block").mapInArrow(work, "part int, sums binary")
        if self.parts > PARTIALS:
            sums = sums.repartition(PARTIALS).mapInArrow(added, "part int, sums binary")
        return np.sum([np.frombuffer(r["sums"], float) for r in sorted(sums.collect(), key=lambda r: r["part"])], axis=0)

    def product(self, columns: np.ndarray) -> np.ndarray:
        """The covariance times the columns."""
        return self.summed(lambda c: c.T @ (c @ columns), columns.size).reshape(columns.shape) / self.n

    def trace(self) -> float:
        return float(self.summed(lambda c: np.array([(c * c).sum()]), 1)[0]) / self.n

    def covariance(self, columns: np.ndarray) -> np.ndarray:
        """That of the vectors projected on the columns."""
        k = columns.shape[1]
        mean = self.summed(lambda c: (c @ columns).sum(axis=0), k) / self.n

        def centre(c: np.ndarray) -> np.ndarray:
            w = c @ columns - mean
            return w.T @ w

        return self.summed(centre, k * k).reshape(k, k) / self.n


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    spark = vectors.sparkSession
    rows = whole(vectors)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    empty = spark.createDataFrame([], WHITENED)
    if not lengths:
        return empty
    d = lengths["d"]
    rows = rows.where(F.size("x") == d)
    fit = Fit(materialise(packed(rows, d), "whitening-blocks"), d)
    trace = fit.trace()
    if not trace > 0:
        return empty
    values, directions = leading(fit.product, d, min(components, d))
    kept = values > d * np.finfo(float).eps * values[0]
    values, directions = values[kept], directions[:, kept]
    scaled, k = directions / np.sqrt(values), int(kept.sum())
    error = float(abs(fit.covariance(scaled) - np.eye(k)).max())
    explained, n, total = values / trace, fit.n, fit.total

    def work(batches):
        for b in sliced(batches, 8_192):
            x = centred(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d), n, total)
            w = (x.astype(float) / n) @ scaled
            fits = abs(x.astype(float)).max(axis=1, initial=0) ** 2 * d < _SAFE
            deviation = [int((r if ok else r.astype(object)).dot(r)) for r, ok in zip(x, fits)]
            deviation = pa.array([v if v < 1 << 63 else None for v in deviation], pa.int64())
            at, m = np.repeat(np.arange(len(x)), k), len(x) * k
            columns = [b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(m, n)), deviation.take(pa.array(at)), pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(m, error))]
            yield pa.record_batch(columns, [f.split()[0] for f in WHITENED.split(", ")])

    return rows.mapInArrow(work, WHITENED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
