"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

A vector's entries become integers, and the sums S and the trace of the covariance V are exact. V itself is never built: a pass
over the rows gives V Q = X'X Q / n for a block Q of ``k + GUARD`` columns, with X centred before it is multiplied; tasks add up
their rows in numpy, and the partial products are summed by cell. A round applies a Chebyshev polynomial of V to the block by a
three-term recurrence of such passes, which damps the eigenvalues below the block's and lifts the wanted ones; QR and a
Rayleigh-Ritz step then turn the block into approximate eigenvectors. Leading pairs that are done are locked, and the filter works
beside them. Lanczos steps, which ride along in the first round, bound
the spectrum from below. It ends when the residuals of the ``k`` wanted pairs are at the level of rounding, which certifies them;
a block that does not get there in ``ROUNDS`` rounds is doubled, up to the whole space, where one step is exact. A last pass
measures the covariance of the whitened rows.

The driver holds blocks of ``dim * (k + GUARD)`` numbers, whatever the number of rows; rows are read where they lie and not
shuffled.

Rows take part if the vector is neither null nor empty and holds no null, NaN or infinite entry, nor one beyond ``LARGEST``. Vectors of
different lengths are whitened apart, each length as a table of its own. Repeated rows count each; a null id stays null. There
are ``min(k, dim)`` components. Equal eigenvalues leave their components free to turn among themselves. A component without
variance (fewer distinct rows than dimensions, a single row) has ``whitened`` null, and does not count in ``identity_error``;
``explained`` is null if nothing varies. ``deviation`` is null where it does not fit a long. An empty table gives no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import give_back, materialize, scratch_dir, table

K, GUARD, ROUNDS, SEED = 32, 8, 16, 23
#: A round's polynomial lifts the last wanted eigenvalue so many times; the first stays within what doubles tell apart; steps at most.
LIFT, APART, DEGREE = 1e4, 1e8, 24
SCALE, SHIFT = 64, 1_000_000
#: Bound of an entry's magnitude: integers up to here are exact as doubles.
LARGEST = float(2**46)
#: Residuals below this share of the largest eigenvalue are certified; those below ``STALLED`` if they do not fall any more.
CERTIFIED, STALLED = 2e-14, 1e-11
#: Eigenvalues below this share of the largest are none.
RANK = 1e-12
#: Rows that a task holds as doubles at once hold about so many bytes.
HELD = 8 << 20


@dataclass(frozen=True)
class Moments:
    """Number of rows, sums by dimension, and the trace of the covariance; exact."""

    n: int
    sums: list[int]
    trace: Fraction

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the whole part of the mean is taken off as an integer."""
        whole, rest = self._mean()
        return (x - whole).astype(float) - rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S) ** 2, for each row."""
        whole, rest = self._mean()
        apart = x - whole
        largest = self.n * (int(np.abs(apart).max(initial=0)) + 1)
        if largest**2 * x.shape[1] < 2**62:
            return ((apart * self.n - rest) ** 2).sum(1).tolist()
        wide = ((apart.astype(object) * self.n - rest.astype(object)) ** 2).sum(1)
        return [int(v) if v < 2**63 else None for v in wide]

    def _mean(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array([s // self.n for s in self.sums]), np.array([s % self.n for s in self.sums])


def integers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, dim, x): the rows that take part, their entries as integers."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.size("v") > 0)
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)))
    return rows.select("id", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * SCALE) + SHIFT).alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer rows, about ``HELD`` bytes at once."""
    step = max(1, HELD // (8 * dim))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            some = batch.slice(at, step)
            yield some.column(0), some.column(1).flatten().to_numpy().reshape(-1, dim)
    give_back()


def _added(rows: DataFrame, dim: int, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part`` over blocks of rows: a task gives its own sum cell by cell, cells are summed by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, x in _blocks(batches, dim):
            total += part(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "value"])

    out = np.zeros(shape[0] * shape[1])
    for r in rows.select("id", "x").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r.cell] = r.value
    return out.reshape(shape)


def moments(rows: DataFrame, dim: int) -> Moments:
    """One pass; sums are kept as integers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(dim, object), 0
        for _, x in _blocks(batches, dim):
            y = x - SHIFT
            largest = int(np.abs(y).max(initial=0))
            if largest**2 * y.size >= 2**62:
                y = y.astype(object)
            n, sums, squares = n + len(y), sums + y.sum(0).astype(object), squares + int((y * y).sum())
        if n:
            cells = [n, *sums, squares]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cells))), pa.array([str(c) for c in cells])], ["cell", "value"])

    got = {r.cell: int(r.value) for r in rows.select("id", "x").mapInArrow(run, "cell long, value string").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}
    n, sums, squares = got[0], [got[i + 1] for i in range(dim)], got[dim + 1]
    return Moments(n, [s + SHIFT * n for s in sums], Fraction(squares, n) - sum(Fraction(s, n) ** 2 for s in sums))


def applied(rows: DataFrame, m: Moments) -> Callable[[np.ndarray], np.ndarray]:
    """The map Q -> V Q, one pass each."""
    dim = len(m.sums)

    def times(q: np.ndarray) -> np.ndarray:
        shared = rows.sparkSession.sparkContext.broadcast(q)  # dim * (k + GUARD) numbers

        def part(x: np.ndarray) -> np.ndarray:
            c = m.centred(x)
            return c.T @ (c @ shared.value)

        out = _added(rows, dim, q.shape, part) / m.n
        shared.unpersist()
        return out

    return times


@dataclass
class _Lanczos:
    """Lanczos steps on one vector; the least Ritz value less its residual bounds the spectrum from below."""

    v: np.ndarray
    done: list[np.ndarray]
    alpha: list[float]
    beta: list[float]

    def step(self, w: np.ndarray) -> None:
        """Takes ``V v`` and moves on to the next vector."""
        self.done.append(self.v)
        self.alpha.append(float(self.v @ w))
        basis = np.column_stack(self.done)
        for _ in range(2):
            w = w - basis @ (basis.T @ w)
        size = float(np.linalg.norm(w))
        self.beta.append(size)
        self.v = w / size if size > 0 else w

    def least(self) -> float:
        t = np.diag(self.alpha) + np.diag(self.beta[:-1], 1) + np.diag(self.beta[:-1], -1)
        values, vectors = np.linalg.eigh(t)
        return float(max(values[0] - self.beta[-1] * abs(vectors[-1, 0]), 0.0))


def _degree(low: float, high: float, wanted: float, top: float) -> int:
    """So many steps as lift the last wanted value ``LIFT`` times above the unwanted ones, but ``top`` not beyond what doubles tell apart."""
    middle, half = (low + high) / 2, (high - low) / 2
    rate, most = (math.acosh(max((v - middle) / half, 1 + 1e-9)) for v in (wanted, top))
    return max(2, min(math.ceil(math.acosh(LIFT) / rate), math.floor(math.acosh(APART) / most), DEGREE))


def _filtered(times: Callable[[np.ndarray], np.ndarray], beside: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, low: float, high: float, wanted: float, top: float) -> np.ndarray:
    """T(V) q for the Chebyshev polynomial that is small on [low, high] and one at ``top``; V q is known. ``beside`` takes off what
    rounding brings in of locked vectors."""
    middle, half = (low + high) / 2, (high - low) / 2
    if half <= RANK * top or top <= high:  # nothing to damp but one value: a power step
        return vq - (middle if top > high else 0) * q
    first = sigma = half / (top - middle)
    before, y = q, beside(vq - middle * q) * (sigma / half)
    for _ in range(_degree(low, high, wanted, top) - 1):
        following = 1 / (2 / first - sigma)
        before, y = y, beside(2 * following / half * (times(y) - middle * y) - sigma * following * before)
        sigma = following
    return y


def eigenpairs(times: Callable[[np.ndarray], np.ndarray], dim: int, k: int, rounds: int = ROUNDS, guard: int = GUARD) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    rng = np.random.default_rng(SEED)
    width = min(dim, k + guard)
    q = np.linalg.qr(rng.standard_normal((dim, width)))[0]
    ride = _Lanczos((v := rng.standard_normal(dim)) / np.linalg.norm(v), [], [], [])

    def riding(y: np.ndarray) -> np.ndarray:
        both = times(np.column_stack([y, ride.v]))
        ride.step(both[:, -1])
        return both[:, :-1]

    while True:
        worst = math.inf
        for number in range(rounds + 1):
            vq = times(q)
            values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            q, vq = q @ turn, vq @ turn
            top = float(values[0])
            if top <= 0:  # nothing varies
                return np.zeros(k), q[:, :k]
            apart = np.linalg.norm(vq - q * values, axis=0) / top
            last, worst = worst, float(apart[:k].max())
            if width == dim or worst <= CERTIFIED or (worst <= STALLED and worst > last / 2):
                return np.maximum(values[:k], 0), q[:, :k]
            if number == rounds:
                break
            done = int(np.argmax(np.r_[apart > 10 * CERTIFIED, True]))  # leading pairs are locked: the filter works beside them
            done = min(done, k - 1)
            locked = q[:, :done]
            beside = lambda y, locked=locked: y - locked @ (locked.T @ y)
            low, high = (ride.least() if ride.done else 0.0), float(values[-1])
            step = times if ride.done else riding
            y = _filtered(step, beside, q[:, done:], vq[:, done:], min(low, high), high, float(values[k - 1]), float(values[done]))
            q = np.linalg.qr(np.column_stack([locked, beside(y)]))[0]
        wider = min(dim, 2 * width)
        q = np.linalg.qr(np.column_stack([q, rng.standard_normal((dim, wider - width))]))[0]
        width = wider


def _one_length(rows: DataFrame, dim: int, k: int, id_col: str) -> DataFrame:
    m = moments(rows, dim)
    k = min(k, dim)
    values, components = eigenpairs(applied(rows, m), dim, k)
    some = values > RANK * max(values[0], 0.0)
    scaled = components[:, some] / np.sqrt(values[some])
    shown = [float(v / m.trace) if m.trace else None for v in map(Fraction, values)]
    error = 0.0
    if some.any():

        def part(x: np.ndarray) -> np.ndarray:
            z = m.centred(x) @ scaled
            return np.vstack([z.T @ z, z.sum(0)])

        found = _added(rows, dim, (int(some.sum()) + 1, int(some.sum())), part) / m.n
        error = float(np.abs(found[:-1] - np.outer(found[-1], found[-1]) - np.eye(int(some.sum()))).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.flatnonzero(some)
        for batch in batches:
            for ids, x in _blocks(iter([batch]), dim):
                z = np.full((len(x), k), np.nan)
                z[:, places] = m.centred(x) @ scaled
                each = pa.array(np.repeat(np.arange(len(x)), k))
                number = np.tile(np.arange(k), len(x))
                yield pa.RecordBatch.from_arrays([
                    ids.take(each), pa.array((number + 1).astype(np.int32)), pa.array(np.full(len(number), m.n)), pa.array(m.deviations(x), pa.int64()).take(each),
                    pa.array(z.ravel(), mask=~some[number]), pa.array(shown, pa.float64()).take(pa.array(number)), pa.array(np.full(len(number), error)),
                ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = rows.select("id", "x").mapInArrow(run, "id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)


def whiten(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component."""
    rows = materialize(integers(vectors, id_col, vec_col), f"{scratch_dir(vectors.sparkSession)}/rows")
    lengths = sorted(r.dim for r in rows.select("dim").distinct().collect())  # a table of embeddings has one or a few
    if not lengths:
        none = F.lit(None)
        return rows.select(F.col("id").alias(id_col), none.cast("int").alias("component"), none.cast("long").alias("n"), none.cast("long").alias("deviation"), *(none.cast("double").alias(c) for c in ("whitened", "explained", "identity_error")))
    out = None
    for dim in lengths:
        own = _one_length(rows.filter(F.col("dim") == dim), dim, k, id_col)
        out = own if out is None else out.unionByName(own)
    return out


def op12_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_chebyshev_whitening": op12_chebyshev_whitening}
ORACLE_SQL: dict[str, str] = {}
