"""Embedding whitening by a block Jacobi-Davidson solver over distributed products.

The covariance is never built. The vectors to fit lie packed in blocks in the shared
folder; each step of the solver is one Spark job that multiplies all centred blocks by a
few columns and adds the results up. Correction equations, projected off the locked and
the present vectors, are solved by inner MINRES steps, all columns in one job a step;
Rayleigh-Ritz in the growing subspace gives new vectors, and those whose residual has
reached double precision are locked.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, small_batches

#: Added to each entry so that vectors of the given scale are positive.
OFFSET = 1_000_000
#: Vectors in a packed block, and bytes of one at most.
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
#: Integers beyond this are not exact in a double; entries of x end there.
MOST = 2**53 - 1
#: Partial sums meet in so many groups before they reach the driver.
GROUPS = 64


def integers(embedding: Column, scale: int = 64) -> Column:
    """``floor(scale * c) + OFFSET`` of each entry, within what doubles hold exactly; null for a null vector or one with a null or non-finite entry."""
    good = embedding.isNotNull() & F.forall(F.coalesce(embedding, F.array()), lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    held = lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-float(MOST))), F.lit(float(MOST))))
    return F.when(good, F.transform(embedding, lambda c: held(c) + OFFSET))


@dataclass
class Fit:
    """What a table's whitening is made of: exact counts and sums, and the components found."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    products: int
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([(s - OFFSET * self.n) / self.n for s in self.sums]) if self.n else np.zeros(0)


class Packed:
    """The distinct vectors of a table, less ``OFFSET``, as blocks in the shared folder."""

    def __init__(self, vectors: DataFrame, column: str = "x"):
        """``vectors`` has distinct arrays of long, all of one length."""
        small_batches(vectors.sparkSession)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=False) - OFFSET
                x = flat.reshape(batch.num_rows, -1)
                rows = min(BLOCK_ROWS, max(1, BLOCK_BYTES // (8 * max(1, x.shape[1]))))
                kind = np.int32 if not x.size or np.abs(x).max() < 2**31 else np.int64
                parts = [x[i : i + rows] for i in range(0, len(x), rows)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(p) for p in parts], pa.int32()), pa.array([kind is np.int64 for p in parts], pa.bool_()), pa.array([p.astype(kind).tobytes() for p in parts], pa.binary())],
                    ["n", "wide", "block"],
                )

        self.blocks = materialize(vectors.select(column).mapInArrow(pack, "n int, wide boolean, block binary"), "vectors")
        self.n, self.sums, squares = 0, [], 0
        for part in self._gather(_exact_sums, None, exact=True):
            n, sums, square = part
            self.n, squares = self.n + n, squares + square
            self.sums = [a + b for a, b in zip(self.sums, sums)] if self.sums else list(sums)
        self.dims = len(self.sums)
        self.mean = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(0)
        self.trace = (self.n * squares - sum(s * s for s in self.sums)) / self.n**2 if self.n else 0.0
        self.sums = [s + OFFSET * self.n for s in self.sums]
        self.products = 0

    def _gather(self, work, argument, exact: bool = False) -> list:
        """``work(blocks, argument)`` of each task; results meet in a bounded number of groups before they reach the driver."""
        spark = self.blocks.sparkSession
        shared = spark.sparkContext.broadcast(argument)

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = (np.frombuffer(b, np.int64 if w else np.int32).reshape(n, -1) for batch in batches for n, w, b in zip(*(c.to_pylist() for c in batch.columns)))
            out = work(blocks, shared.value)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], ["part"])

        parts = self.blocks.mapInArrow(one, "part binary")

        def meet(table: pa.Table) -> pa.Table:
            return pa.table({"part": pa.array([pickle.dumps(_added([pickle.loads(p) for p in table.column("part").to_pylist()]))], pa.binary())})

        met = parts.select("part", (F.spark_partition_id() % GROUPS).alias("g")).groupBy("g").applyInArrow(meet, "part binary")
        found = sorted(bytes(r[0]) for r in met.collect())
        shared.unpersist()
        return [pickle.loads(p) for p in found]

    def product(self, columns: np.ndarray) -> np.ndarray:
        """The covariance times the columns."""
        self.products += 1
        found = self._gather(_centred_product, (self.mean, columns))
        return np.sum([f[0] for f in found], axis=0) / self.n

    def whitened_covariance(self, projection: np.ndarray) -> np.ndarray:
        """Covariance of the centred vectors times ``projection``."""
        found = self._gather(_moments, (self.mean, projection))
        sums, squares = np.sum([f[0] for f in found], axis=0) / self.n, np.sum([f[1] for f in found], axis=0) / self.n
        return squares - np.outer(sums, sums)


def _added(parts: list) -> tuple:
    """Sums of the parts' members; lists are added entry by entry, as Python's integers."""
    total = parts[0]
    for p in parts[1:]:
        total = tuple([x + y for x, y in zip(a, b)] if isinstance(a, list) else a + b for a, b in zip(total, p))
    return total


def _exact_sums(blocks: Iterator[np.ndarray], _) -> tuple | None:
    n, sums, square = 0, None, 0
    for x in blocks:
        n += len(x)
        narrow = x.size and np.abs(x.astype(np.int64)).max() < 2**25  # squares of a block then fit in 64 bits
        wide = x.astype(np.int64) if narrow else x.astype(object)
        part = [int(s) for s in wide.sum(0)]
        sums = part if sums is None else [a + b for a, b in zip(sums, part)]
        square += int((wide * wide).sum())
    return None if sums is None else (n, sums, square)


def _centred_product(blocks: Iterator[np.ndarray], argument) -> tuple | None:
    mean, columns = argument
    total = None
    for x in blocks:
        c = x - mean
        part = c.T @ (c @ columns)
        total = part if total is None else total + part
    return None if total is None else (total,)


def _moments(blocks: Iterator[np.ndarray], argument) -> tuple | None:
    mean, projection = argument
    sums = squares = None
    for x in blocks:
        y = (x - mean) @ projection
        sums, squares = (y.sum(0), y.T @ y) if sums is None else (sums + y.sum(0), squares + y.T @ y)
    return None if sums is None else (sums, squares)


def _orthogonal(columns: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what ``columns`` add to the basis; those that add nothing to it go."""
    size = np.linalg.norm(columns, axis=0)
    columns = columns[:, size > 0] / size[size > 0]
    for _ in range(3):
        columns = columns - basis @ (basis.T @ columns)
    kept: list[np.ndarray] = []
    for c in columns.T:
        for _ in range(2):
            for k in kept:
                c = c - k * (k @ c)
            c = c - basis @ (basis.T @ c)
        if (size := np.linalg.norm(c)) > 1e-8:
            kept.append(c / size)
    return np.stack(kept, 1) if kept else np.zeros((len(basis), 0))


def _minres(times, right: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """MINRES for symmetric systems, one for each column of ``right``, in step: ``times`` multiplies all columns by their own matrices.

    Columns end when their residual has fallen by ``enough``.
    """
    x = np.zeros_like(right)
    beta = np.linalg.norm(right, axis=0)
    first, v_old, v = np.maximum(beta, 1e-300), np.zeros_like(right), right / np.maximum(beta, 1e-300)
    d_old, d_older = np.zeros_like(right), np.zeros_like(right)
    c_old, c = np.ones(len(beta)), np.ones(len(beta))
    s_old, s = np.zeros(len(beta)), np.zeros(len(beta))
    eta, along = beta.copy(), np.zeros(len(beta))
    going = beta > 0
    for _ in range(steps):
        if not going.any():
            break
        w = times(v)
        alpha = (v * w).sum(0)
        w = w - alpha * v - along * v_old
        after = np.linalg.norm(w, axis=0)
        # the column of the tridiagonal matrix, turned by the last two rotations and a new one
        top, mid = s_old * along, c_old * along
        mid, low = c * mid + s * alpha, -s * mid + c * alpha
        size = np.maximum(np.hypot(low, after), 1e-300)
        c_old, s_old = c, s
        c, s = low / size, after / size
        d = (v - mid * d_old - top * d_older) / size
        x = np.where(going, x + c * eta * d, x)
        eta = -s * eta
        going &= (np.abs(eta) > enough * first) & (after > 1e-13 * size)
        d_older, d_old = d_old, d
        v_old, v, along = v, w / np.maximum(after, 1e-300), after
    return x


def jacobi_davidson(product, dims: int, wanted: int, size: float, *, inner: int = 5, guard: int = 4, most: int = 0, rounds: int = 300, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix with their vectors and residual norms, falling.

    ``product`` multiplies the matrix, whose trace is ``size``, by columns. A vector is
    locked, the largest first, when its residual is within rounding of the products: 32
    units of the last place of the largest eigenvalue. If a round brings the residuals no
    lower, that round's vectors are at the limit of the arithmetic and are locked within
    64 times as much; an error otherwise.
    """
    wanted = min(wanted, dims)
    if not wanted or size <= 0:
        return np.zeros(0), np.zeros((dims, 0)), np.zeros(0)
    block = min(dims, wanted + guard)
    most = max(most or 4 * block, block + wanted)
    basis = _orthogonal(np.random.default_rng(seed).normal(size=(dims, block)), np.zeros((dims, 0)))
    image = product(basis)
    locked, values, residuals = np.zeros((dims, 0)), np.zeros(0), np.zeros(0)
    best, stalled = np.inf, 0
    for _ in range(rounds):
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        rest = image - basis * theta
        rest = rest - locked @ (locked.T @ rest)
        norm = np.linalg.norm(rest, axis=0)
        unit = np.finfo(float).eps * max(float(np.max(theta, initial=0)), float(np.max(values, initial=0)))
        need, whole = wanted - len(values), locked.shape[1] + basis.shape[1] >= dims
        now = float(norm[:need].max())
        stalled = stalled + 1 if now > best / 2 else 0
        best = min(best, now)
        bound = 32 * unit * (64 if stalled >= 3 else 1)
        done = 0
        while done < need and done < len(norm) and norm[done] <= bound:
            done += 1
        if done:
            locked, values, residuals = np.concatenate([locked, basis[:, :done]], 1), np.concatenate([values, theta[:done]]), np.concatenate([residuals, norm[:done]])
            basis, image, theta, rest = basis[:, done:], image[:, done:], theta[done:], rest[:, done:]
            best, stalled = np.inf, 0
        if len(values) == wanted:
            break
        if whole:  # the subspace is the whole space: only rounding is left, so one more look at fresh products
            image = product(basis)
            continue
        if basis.shape[1] > most - block:
            basis, image = basis[:, : block + need], image[:, : block + need]
        need = min(wanted - len(values), basis.shape[1])
        target, shift = basis[:, :need], theta[:need]
        outer = locked

        def project(t: np.ndarray) -> np.ndarray:
            t = t - outer @ (outer.T @ t)
            return t - target * (target * t).sum(0)

        def shifted(t: np.ndarray) -> np.ndarray:
            t = project(t)
            return project(product(t) - t * shift)

        fresh = _orthogonal(_minres(shifted, project(-rest[:, :need]), inner, 1e-4), np.concatenate([locked, basis], 1))
        if not fresh.shape[1]:
            fresh = _orthogonal(np.random.default_rng(seed + len(values)).normal(size=(dims, block)), np.concatenate([locked, basis], 1))
        basis, image = np.concatenate([basis, fresh], 1), np.concatenate([image, product(fresh)], 1)
    else:
        raise ArithmeticError(f"{wanted - len(values)} of {wanted} components have not converged")
    order = np.argsort(-values, kind="stable")
    return values[order], locked[:, order], residuals[order]


def fit(vectors: DataFrame, components: int = 16, column: str = "x") -> Fit:
    """Fit on each distinct vector of ``column`` once; all have one length.

    Components whose variance is nothing but rounding (rank deficient tables, a single
    vector) are left out, so fewer than ``components`` may be found; none for an empty table.
    """
    packed = Packed(vectors.select(column).distinct(), column)
    values, found, residuals = jacobi_davidson(packed.product, packed.dims, components, packed.trace)
    real = values > packed.dims * np.finfo(float).eps * (values.max() if len(values) else 0) * 64
    values, found, residuals = values[real], found[:, real], residuals[real]
    error = 0.0
    if len(values):
        error = float(np.abs(packed.whitened_covariance(found / np.sqrt(values)) - np.eye(len(values))).max())
    return Fit(packed.n, packed.sums, packed.trace, values, found, residuals, packed.products, error)


def whiten(embeddings: DataFrame, components: int = 16, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: its id, ``component`` from 1, ``n`` (vectors fitted), ``deviation`` (decimal of
    38 digits: sum over dimensions of ``(n*x-S)^2``, null beyond them), ``whitened``, ``explained`` and ``identity_error``.

    Rows whose vector is null, empty or holds a null or non-finite entry go; so do those
    whose length is not the most frequent one (of equally frequent ones the longest).
    Entries of ``x`` end at 2^53. Rows that repeat stay repeated, null ids stay null;
    other columns are not looked at. A table without two different vectors has no
    components and so no rows.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_col).alias("id"), integers(F.col(vector_col)).alias("x")).where("size(x) > 0")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    schema = f"{id_col} {embeddings.schema[id_col].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not lengths:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == lengths[0]["d"])
    found = fit(rows, components)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        k = len(own.values)
        mean, projection = own.mean, own.vectors / np.sqrt(own.values)
        sums = np.array([s - OFFSET * own.n for s in own.sums], object)
        explained, number = own.values / own.trace, np.arange(1, k + 1, dtype=np.int32)
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(start, BLOCK_ROWS)
                m = batch.num_rows
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(m, -1) - OFFSET
                y = (x - mean) @ projection
                deviation = _deviations(x, own.n, sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(number, m)),
                        pa.array(np.full(m * k, own.n, np.int64)),
                        pa.array(deviation, pa.string()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(y.reshape(-1)),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, own.identity_error)),
                    ],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    out = rows.select("id", "x").mapInArrow(run, schema.replace("decimal(38,0)", "string"))
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[str | None]:
    """Sums of ``(n*x-S)^2`` over the dimensions, as digits; None beyond 38 of them."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums))) * 2
    if most**2 * x.shape[1] < 2**63:
        d = x.astype(np.int64) * n - sums.astype(np.int64)
        return [str(v) for v in (d * d).sum(1).tolist()]
    d = x.astype(object) * n - sums
    return [str(v) if v < 10**38 else None for v in (d * d).sum(1)]
