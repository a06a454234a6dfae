"""Whitening of embeddings by Chebyshev-filtered subspace iteration over distributed passes.

A component c counts as the integer x = floor(64 c) + 1000000. The fit list is each distinct vector once: n vectors with sums S. All
sums over it are of (n x - S) / n, whose numerator is an exact integer, so that nothing is lost by centring. V, the covariance, is never
made: one pass over the fit list gives V Q for a block Q of a few columns, as sums of each task's share, and tasks' shares are summed on
executors before the rest comes to the driver: a matrix of a vector's length by Q's columns, whatever the input.

A few Lanczos steps bound the spectrum. Each cycle applies a Chebyshev polynomial of V, by its three-term recurrence over such passes, that
is small on the unwanted part of the spectrum and grows beyond it; QR and Rayleigh-Ritz follow. The wanted pairs are certified once their
residuals are as small as double precision lets them be and a fresh block, filtered apart from them, shows no eigenvalue above theirs;
what it shows joins the subspace, and cycles go on.

Defined results: rows whose vector is null, or holds a null, NaN or infinite entry, are dropped; rows with equal or null ids each keep
their own rows; shorter vectors end in c = 0; directions without variance (eigenvalue under 1e-12 of the largest) give no component, so
that fewer than two distinct vectors give no rows; an empty table gives no rows; a deviation beyond 64 bits is null; columns
other than the two named are not read. An entry times 64 beyond a 64-bit integer is an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged

SCALE, SHIFT = 64, 1_000_000
#: Columns of the subspace beyond the wanted ones; degree of the polynomial; steps of Lanczos; cycles at most.
GUARD, DEGREE, STEPS, CYCLES = 16, 10, 8, 60
#: Residuals count as nothing below this share of the largest eigenvalue; so does an eigenvalue.
SMALL, NOTHING = 2e-14, 1e-12
#: A residual that no longer halves is as small as it gets, if it is below this share.
STALLED = 1e-10
#: Integers of the fit list in one row of bytes.
AT_ONCE = 1 << 20

Apply = Callable[[np.ndarray], np.ndarray]


def entries(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and x of the rows that have a finite vector."""
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    finite = rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    return finite.select("id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


@dataclass
class FitList:
    """Distinct vectors as rows of bytes, their number and sums, and the parts that sums are made in."""

    packed: DataFrame
    n: int
    sums: np.ndarray  # of 64-bit integers
    parts: int

    @property
    def width(self) -> int:
        return len(self.sums)

    def _total(self, share: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """The sum of ``share`` over all centred vectors, a batch at a time."""
        n, sums, width = self.n, self.sums, self.width

        def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for b in batches:
                for rows in b.column(0):
                    x = np.frombuffer(rows.as_buffer(), np.int64).reshape(-1, width)
                    total += share((n * x - sums) / n)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["share"])

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for b in batches:
                for s in b.column(0):
                    total += np.frombuffer(s.as_buffer()).reshape(shape)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["share"])

        shares = self.packed.mapInArrow(of_task, "share binary")
        if self.parts > 4:
            shares = shares.repartition(math.isqrt(self.parts)).mapInArrow(merged, "share binary")
        return sum((np.frombuffer(r[0]).reshape(shape) for r in shares.collect()), np.zeros(shape))

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q, by one pass."""
        return self._total(lambda c: c.T @ (c @ q), q.shape) / self.n

    def trace(self) -> float:
        return float(self._total(lambda c: np.array([[np.square(c).sum()]]), (1, 1))[0, 0]) / self.n

    def covariance_of(self, w: np.ndarray) -> np.ndarray:
        """The covariance of the vectors projected on the columns of ``w``, by one pass."""

        def share(c: np.ndarray) -> np.ndarray:
            y = c @ w
            return y.T @ y

        return self._total(share, (w.shape[1], w.shape[1])) / self.n


def fit_list(rows: DataFrame) -> FitList:
    """From ``rows`` (x): each distinct vector once, all at the width of the longest."""
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    whole = F.when(F.size("x") < width, F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(width) - F.size("x")))).otherwise(F.col("x"))
    distinct = rows.select(whole.alias("x")).distinct()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = max(1, AT_ONCE // max(1, width))
        for b in batches:
            for s in range(0, len(b), many):
                part = b.slice(s, many)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(part), width)
                # sums as two halves: each stays exact however many rows follow
                halves = [(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes()], pa.binary()), pa.array([len(part)], pa.int64()), pa.array([np.abs(x).max(initial=0)], pa.int64()), *[pa.array([h], pa.list_(pa.int64())) for h in halves]],
                    ["rows", "n", "largest", "high", "low"],
                )

    packed = staged(distinct.mapInArrow(pack, "rows binary, n long, largest long, high array<long>, low array<long>"), "fit-list")
    sums = np.zeros(width, np.int64)
    of_place = packed.select(F.posexplode(F.arrays_zip("high", "low")).alias("at", "s")).groupBy("at").agg(F.sum("s.high"), F.sum("s.low"))
    for at, high, low in of_place.collect():
        sums[at] = (high << 32) + low
    n, largest = packed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("largest"), F.lit(0))).first()
    if n * largest >= 1 << 62:
        raise OverflowError("n x does not fit 64 bits")
    only = packed.select("rows")
    return FitList(only, n, sums, only.rdd.getNumPartitions())


def lanczos_bounds(apply: Apply, width: int, steps: int, rng: np.random.Generator) -> tuple[float, float]:
    """A low and a high bound of the spectrum, by a few steps from a random vector; the low one is at least 0."""
    steps = min(steps, width)
    q = rng.standard_normal((width, 1))
    q /= np.linalg.norm(q)
    basis, t = [q], np.zeros((steps, steps))
    beta = 0.0
    for k in range(steps):
        w = apply(basis[k])
        t[k, k] = float((basis[k].T @ w)[0, 0])
        done = np.hstack(basis)
        for _ in range(2):
            w = w - done @ (done.T @ w)
        beta = float(np.linalg.norm(w))
        if k + 1 < steps and beta > NOTHING * abs(t[0, 0]):
            t[k, k + 1] = t[k + 1, k] = beta
            basis.append(w / beta)
        else:
            break
    ritz = np.linalg.eigvalsh(t[: len(basis), : len(basis)])
    return max(0.0, float(ritz[0]) - beta), float(ritz[-1]) + beta


def filtered(apply: Apply, q: np.ndarray, vq: np.ndarray, low: float, cut: float, top: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of V on ``q``: within [low, cut] at most 1 in size, scaled to 1 at ``top``. ``vq`` is V q."""
    half, centre = (cut - low) / 2, (cut + low) / 2
    sigma = half / (top - centre)
    tau = 2 / sigma
    before, now = q, (vq - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (tau - sigma)
        before, now = now, (2 * following / half) * (apply(now) - centre * now) - (sigma * following) * before
        sigma = following
    return now


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, falling, their vectors, and V times these."""
    h = q.T @ vq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, vq @ turn


def leading(apply: Apply, width: int, wanted: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of V, falling, and their unit eigenvectors as columns."""
    wanted = min(wanted, width)
    columns = min(width, wanted + GUARD)
    rng = np.random.default_rng(seed)
    low, _ = lanczos_bounds(apply, width, STEPS, rng) if columns < width else (0.0, 0.0)
    q, _ = np.linalg.qr(rng.standard_normal((width, columns)))
    values, q, vq = _ritz(q, apply(q))
    worst, probed = math.inf, columns == width
    for _ in range(CYCLES):
        residual = float(np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max(initial=0.0))
        largest = max(float(values[0]), 0.0)
        if residual <= SMALL * largest or largest == 0 or (residual <= STALLED * largest and residual > worst / 2):
            if probed:
                return values[:wanted], q[:, :wanted]
            probed = True
            extra = _probe(apply, q[:, :wanted], values, low, rng)
            if extra is None:
                return values[:wanted], q[:, :wanted]
            # what was missed takes the place of the last guard columns
            q, _ = np.linalg.qr(np.hstack([q[:, : columns - extra.shape[1]], extra]))
            values, q, vq = _ritz(q, apply(q))
            worst, probed = math.inf, False
            continue
        worst = residual
        cut = float(values[-1])
        if cut <= low:  # what lies below the bound has come up: the bound was too high
            low = 0.0
        if cut <= low or cut >= largest:
            q, _ = np.linalg.qr(vq)
        else:
            q, _ = np.linalg.qr(filtered(apply, q, vq, low, cut, largest, DEGREE))
        values, q, vq = _ritz(q, apply(q))
    raise ArithmeticError(f"not certified after {CYCLES} cycles: residual {residual}")


def _probe(apply: Apply, found: np.ndarray, values: np.ndarray, low: float, rng: np.random.Generator) -> np.ndarray | None:
    """Directions apart from ``found`` with larger Ritz values than its last, from a fresh filtered block; none if there are none."""
    width, wanted = found.shape

    def apart(m: np.ndarray) -> np.ndarray:
        return m - found @ (found.T @ m)

    q, _ = np.linalg.qr(apart(rng.standard_normal((width, min(4, width - wanted)))))
    beside = lambda m: apart(apply(m))
    last, cut = float(values[wanted - 1]), float(values[-1])
    if not low < cut < last:
        low, cut = 0.0, last / 2
    q, _ = np.linalg.qr(apart(filtered(beside, q, beside(q), low, cut, last, DEGREE)))
    shown, q, _ = _ritz(q, beside(q))
    over = shown > last * (1 + NOTHING)
    return q[:, over] if over.any() else None


@dataclass
class Whitening:
    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray  # a column for each component
    trace: float
    identity_error: float


def fit(rows: DataFrame, wanted: int = 16) -> Whitening:
    """Components of ``rows`` (x)."""
    fitted = fit_list(rows)
    width = fitted.width
    trace = fitted.trace() if fitted.n > 1 and width else 0.0
    if not trace:
        return Whitening(fitted.n, fitted.sums, np.zeros(0), np.zeros((width, 0)), 0.0, 0.0)
    values, vectors = leading(fitted.times, width, wanted)
    kept = values > NOTHING * values[0]
    values, vectors = values[kept], vectors[:, kept]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    spread = fitted.covariance_of(vectors / np.sqrt(values))
    return Whitening(fitted.n, fitted.sums, values, vectors, trace, float(np.abs(spread - np.eye(len(values))).max()))


def _squares(d: np.ndarray) -> list[int | None]:
    """Sums of squares of rows of integers, exact; none beyond 64 bits."""
    largest = int(np.abs(d).max(initial=0))
    if largest * largest * max(1, d.shape[1]) < 1 << 63:
        return np.square(d).sum(axis=1).tolist()
    sums = np.square(d.astype(object)).sum(axis=1)
    return [s if s < 1 << 63 else None for s in sums]


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """For each of ``rows`` (id, x) and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    n, sums, width, k = model.n, model.sums, len(model.sums), len(model.values)
    project = model.vectors / np.sqrt(model.values)
    explained = model.values / model.trace if k else model.values

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, len(b), 4096):
                part = b.slice(s, 4096)
                vectors = part.column(1)
                x = np.full((len(part), width), SHIFT, np.int64)
                lengths = np.diff(vectors.offsets.to_numpy())
                place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                x[np.repeat(np.arange(len(part)), lengths), place] = vectors.flatten().to_numpy(zero_copy_only=False)
                d = n * x - sums
                y = (d / n) @ project
                at = pa.array(np.repeat(np.arange(len(part)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))), pa.array(np.full(len(part) * k, n, np.int64)),
                        pa.array(_squares(d), pa.int64()).take(at), pa.array(y.ravel()), pa.array(np.tile(explained, len(part))),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.select("id", "x").mapInArrow(turned, f"id {kind}, component int, n long, deviation long, whitened double, explained double")
    return out.withColumn("identity_error", F.lit(model.identity_error))


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = 16) -> DataFrame:
    """``whitened`` of all rows of ``table`` that have a finite vector, by components fitted on their distinct vectors."""
    rows = staged(entries(table, id_col, vector_col), "integer-vectors")
    model = fit(rows.select("x"), wanted)
    return whitened(rows, model).withColumnRenamed("id", id_col)
