"""Embedding whitening: leading eigenvectors of the covariance by a block Jacobi-Davidson method.

Rows are kept as packed blocks of integers ``x = floor(64 c) + 1000000`` in the
shared folder.  The covariance matrix is never formed: it is applied to a block
of vectors by one pass over the rows, ``V Q = sum (x - S/n) ((x - S/n) Q) / n``,
each task centring its rows (exactly, ``n x - S`` in integers) before it
multiplies.  Partial products are summed in buckets, so that the driver gets a
bounded number of them.

The method keeps a search space with its products.  Rayleigh-Ritz gives the
leading Ritz pairs; pairs whose residual has reached double precision, counted
from the largest on, are locked; for the others the correction equations
``(I - QQ')(V - t I)(I - QQ') z = -r`` are solved by MINRES, all columns at once,
so a step of all of them is one pass.  The corrections extend the space, which
restarts from its Ritz vectors when it is full.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import register, stored, table

SCALE, OFFSET = 64, 1_000_000
#: Entries beyond this are not representable as exact integers and count as not finite.
LARGEST = float(1 << 40)
#: Components asked for, and Ritz pairs carried beyond them.
COMPONENTS, SPARE = 32, 8
#: Steps of the inner solver, and how far it reduces the residual.
INNER_STEPS, INNER_FALL = 6, 1e-3
#: A residual has reached double precision at so many roundings of the largest eigenvalue (times the root of the dimension).
ROUNDINGS = 16
#: Outer steps after which the method gives up with an error.
MOST_STEPS = 200
#: Partial products that the driver gets from one pass.
BUCKETS = 64
#: Vectors of a packed block.
BLOCK_ROWS = 2048
EXACT = pa.decimal128(38, 0)
PACKED = "vec_ids array<long>, x binary"

Apply = Callable[[np.ndarray], np.ndarray]


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, c (array<double>) of the rows that are whitened.

    Left out are null vectors and those with a null or non-finite entry (an
    entry beyond ``LARGEST`` counts as such).
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("c"))
    return rows.where(F.col("c").isNotNull() & F.forall("c", lambda v: F.coalesce(F.abs(v) <= LARGEST, F.lit(False)) & ~F.isnan(v)))


def blocks(rows: DataFrame, d: int) -> DataFrame:
    """``rows`` as packed blocks of whole 64-bit integers."""

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                c = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)
                x = np.floor(SCALE * c).astype(np.int64) + OFFSET
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([x.astype("<i8").tobytes()], pa.binary())], names=["vec_ids", "x"])

    return rows.select("vec_id", "c").mapInArrow(pack, PACKED)


def unpack(raw: bytes, d: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(-1, d)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly, as int64 where it fits or else as Python integers."""
    if n * max(int(np.abs(x).max(initial=0)), 1) < 1 << 62:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


class Rows:
    """The packed rows, their dimension, number and exact sums, and sums over passes."""

    def __init__(self, packed: DataFrame, d: int):
        self.packed, self.d = packed, d
        self.many = packed.rdd.getNumPartitions() > BUCKETS

        def first(x):
            return [np.array([len(x)], np.int64), x.sum(axis=0)]

        n, self.sums = self.summed(first, [(1,), (d,)], np.int64, raw=True)
        self.n = int(n[0])

    def summed(self, part: Callable[[np.ndarray], list[np.ndarray]], shapes: list[tuple], kind=np.float64, raw: bool = False) -> list[np.ndarray]:
        """Sums over all blocks of the arrays that ``part`` makes of a block's centred rows (or its ``raw`` ones)."""
        d, n, sums = self.d, getattr(self, "n", 0), getattr(self, "sums", None)

        def each(batches):
            from pyspark import TaskContext

            total = None
            for batch in batches:
                for x in batch.column(0):
                    x = unpack(x.as_py(), d)
                    got = part(x if raw else centred(x, n, sums).astype(np.float64) / n)
                    total = got if total is None else [a + b for a, b in zip(total, got, strict=True)]
            if total is not None:
                number = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([number % BUCKETS], pa.int32()), pa.array([number], pa.int32()), pa.array([np.concatenate([a.ravel() for a in total]).tobytes()], pa.binary())], names=["bucket", "number", "raw"])

        def together(group: pa.Table) -> pa.Table:
            order = np.argsort(group.column("number").to_numpy())
            parts = group.column("raw").to_pylist()
            total = sum(np.frombuffer(parts[i], kind) for i in order)
            return pa.table({"bucket": group.column("bucket").slice(0, 1), "number": pa.array([0], pa.int32()), "raw": pa.array([total.tobytes()], pa.binary())})

        schema = "bucket int, number int, raw binary"
        rows = self.packed.select("x").mapInArrow(each, schema)
        if self.many:
            rows = rows.groupBy("bucket").applyInArrow(together, schema)
        flat = np.zeros(sum(math.prod(s) for s in shapes), kind)
        for r in sorted(rows.collect(), key=lambda r: (r.bucket, r.number)):  # at most BUCKETS rows
            flat += np.frombuffer(bytes(r.raw), kind)
        cuts = np.cumsum([0, *(math.prod(s) for s in shapes)])
        return [flat[a:b].reshape(s) for a, b, s in zip(cuts[:-1], cuts[1:], shapes, strict=True)]

    def product(self, q: np.ndarray) -> np.ndarray:
        """V Q by one pass over the rows."""
        q = np.ascontiguousarray(q)
        return self.summed(lambda y: [y.T @ (y @ q)], [q.shape])[0] / self.n


def orthonormal(z: np.ndarray, against: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """An orthonormal basis of the columns of ``z`` without their parts in ``against``; what vanishes is left out."""
    room = len(z) - against.shape[1]
    kept = []
    for col in z.T:
        base = np.column_stack([against, *kept]) if kept else against
        size = np.linalg.norm(col)
        if not size or len(kept) >= room:
            continue
        col = col / size
        for _ in range(3):
            col = col - base @ (base.T @ col)
        size = np.linalg.norm(col)
        if size > 1e-10:
            col = col / size
            kept.append(col - base @ (base.T @ col))
            kept[-1] /= np.linalg.norm(kept[-1])
    return np.column_stack(kept) if kept else np.zeros((len(z), 0))


def minres(apply: Apply, b: np.ndarray, steps: int, fall: float) -> np.ndarray:
    """Approximate solutions of ``A z = b`` for all columns, A symmetric, perhaps indefinite, by MINRES from zero.

    Each column has its own Lanczos recurrence; ``apply`` takes all columns at once.
    """
    z = np.zeros_like(b)
    beta = np.linalg.norm(b, axis=0)
    alive = beta > 0
    v_old, v = np.zeros_like(b), np.divide(b, beta, out=np.zeros_like(b), where=alive)
    w_old, w = np.zeros_like(b), np.zeros_like(b)
    c_old, c, s_old, s = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    eta, rest, beta = beta.copy(), beta.copy(), np.zeros_like(beta)
    goal = fall * rest
    for _ in range(steps):
        p = apply(v, alive)
        alpha = np.sum(v * p, axis=0)
        p = p - alpha * v - beta * v_old
        beta_new = np.linalg.norm(p, axis=0)
        # the two rotations before, then the one that clears beta_new
        delta = c * alpha - c_old * s * beta
        high = np.hypot(delta, beta_new)
        mid = s * alpha + c_old * c * beta
        top = s_old * beta
        alive &= high > 0
        safe = np.where(high > 0, high, 1)
        c_new, s_new = delta / safe, beta_new / safe
        w_new = (v - top * w_old - mid * w) / safe
        z = z + np.where(alive, c_new * eta, 0) * w_new
        rest = rest * np.abs(s_new)
        eta = -s_new * eta
        alive &= (rest > goal) & (beta_new > 1e-14 * np.maximum(np.abs(alpha), 1e-300))
        if not alive.any():
            break
        v_old, v = v, np.divide(p, beta_new, out=np.zeros_like(p), where=alive)
        w_old, w, beta = w, w_new, beta_new
        c_old, c, s_old, s = c, c_new, s, s_new
    return z


def jacobi_davidson(apply: Apply, d: int, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors of a positive semidefinite operator.

    Residuals are at most ROUNDINGS * sqrt(d) roundings of the largest eigenvalue.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    b = min(d, k + SPARE)
    most = min(d, 4 * b)
    space = orthonormal(rng.standard_normal((d, b)), np.zeros((d, 0)), rng)
    image = apply(space)
    locked = 0
    for _ in range(MOST_STEPS):
        h = space.T @ image
        values, coords = np.linalg.eigh((h + h.T) / 2)
        coords = coords[:, ::-1][:, : min(b, space.shape[1])]
        values = values[::-1][: coords.shape[1]]
        q, vq = space @ coords, image @ coords
        values = np.sum(q * vq, axis=0) / np.sum(q * q, axis=0)
        r = vq - q * values
        goal = ROUNDINGS * math.sqrt(d) * np.finfo(float).eps * max(abs(values[0]), np.finfo(float).tiny)
        fine = np.linalg.norm(r, axis=0) <= goal
        locked = int(np.argmin(fine)) if not fine.all() else len(fine)
        if locked >= k:
            order = np.argsort(-values[:k], kind="stable")
            return values[:k][order], (q[:, :k] / np.linalg.norm(q[:, :k], axis=0))[:, order]
        if space.shape[1] == d or space.shape[1] + 1 > most:  # full: begin again from the Ritz vectors
            space = orthonormal(q, np.zeros((d, 0)), rng)
            image = apply(space)
            if space.shape[1] + 1 > d:
                continue
        open_ = np.flatnonzero(~fine)[: max(1, most - space.shape[1])]
        base = orthonormal(q, np.zeros((d, 0)), rng)  # locked pairs and all that are sought

        def projected(v, alive, shift=values[open_], base=base):
            v = v - base @ (base.T @ v)
            out = np.zeros_like(v)
            if alive.any():
                out[:, alive] = apply(v[:, alive]) - shift[alive] * v[:, alive]
            return out - base @ (base.T @ out)

        rhs = -(r[:, open_] - base @ (base.T @ r[:, open_]))
        z = minres(projected, rhs, INNER_STEPS, INNER_FALL) if base.shape[1] < d else np.zeros_like(rhs)
        new = orthonormal(np.column_stack([z, r[:, open_]])[:, : max(1, most - space.shape[1])], space, rng)
        if not new.shape[1]:
            new = orthonormal(rng.standard_normal((d, 1)), space, rng)
        if not new.shape[1]:
            space = orthonormal(q, np.zeros((d, 0)), rng)
            image = apply(space)
            continue
        space, image = np.column_stack([space, new]), np.column_stack([image, apply(new)])
    raise ArithmeticError(f"{locked} of {k} eigenpairs reached double precision in {MOST_STEPS} steps")


def whiten(vectors: DataFrame, k: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding", dimension: int | None = None) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors of another length than ``dimension`` (by default the commonest
    length, of equally common ones the longest) are left out too; null and
    repeated ids stay as they are.  Components whose eigenvalue is within 2e-11
    of nothing beside the largest have no whitened values and are left out, so
    fewer than two different vectors, or none, give no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    if dimension is None:
        top = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dimension = top["d"] if top else 0
    d = dimension
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not d:
        return spark.createDataFrame([], schema)
    packed = stored(blocks(rows.where(F.size("c") == d), d), "vectors")
    there = Rows(packed, d)
    n, sums = there.n, there.sums
    if n < 2:
        return spark.createDataFrame([], schema)
    trace = float(there.summed(lambda y: [np.array([np.sum(y * y)])], [(1,)])[0][0]) / n
    values, found = jacobi_davidson(there.product, d, min(k, d)) if trace else (np.zeros(0), np.zeros((d, 0)))
    enough = values > 1e5 * np.finfo(float).eps * max(values[0], 0) if len(values) else np.zeros(0, bool)
    values, found = values[enough], found[:, enough]
    m = len(values)
    if not m:
        return spark.createDataFrame([], schema)
    axes = found / np.sqrt(values)
    mean = there.summed(lambda y: [np.sum(y @ axes, axis=0)], [(m,)])[0] / n

    def second(y):
        w = y @ axes - mean
        return [w.T @ w]

    error = float(np.abs(there.summed(second, [(m, m)])[0] / n - np.eye(m)).max())
    explained = values / trace

    def out(batches):
        for batch in batches:
            for ids, raw in zip(batch.column(0), batch.column(1), strict=True):
                ids = ids.values
                y = centred(unpack(raw.as_py(), d), n, sums)
                largest = int(np.abs(y).max(initial=0))
                if largest * largest * d < 1 << 62:
                    square = pa.array((y * y).sum(axis=1)).cast(pa.decimal128(19, 0)).cast(EXACT)
                else:
                    square = pa.array([Decimal(int(v)) for v in (y.astype(object) ** 2).sum(axis=1)], EXACT)
                w = (y.astype(np.float64) / n) @ axes
                for at in range(0, len(ids), 256):
                    some = len(ids[at : at + 256])
                    each = pa.array(np.repeat(np.arange(at, at + some), m))
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(each), pa.array(np.tile(np.arange(1, m + 1), some), pa.int32()), pa.array(np.full(some * m, n), pa.int64()),
                            square.take(each), pa.array(w[at : at + some].ravel()), pa.array(np.tile(explained, some)), pa.array(np.full(some * m, error)),
                        ],
                        names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    return packed.mapInArrow(out, schema)


@register("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    # null where it passes 64 bits
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))
