"""Embedding whitening by a block Jacobi-Davidson eigensolver over distributed products.

The covariance V of the vectors is never formed: Spark computes V W for a
narrow block W, each task from its own centred rows, summed per entry.  The
driver holds blocks of ``dim`` rows and at most ``MAX_BASIS`` columns and
nothing that grows with the number of vectors.

Each outer step takes the Ritz pairs of the search subspace, locks the leading
ones whose residuals are at double precision, and widens the subspace by
approximate solutions of the projected correction equations
``(I - QQ')(V - theta I)(I - QQ') t = -r``, solved by a few MINRES steps for
``BLOCK`` open pairs at once (one distributed product a step).  The subspace
starts from more random directions than there are pairs wanted, so that
repeated eigenvalues are found with all their directions.

A row is dropped if its vector is null, empty, holds null or non-finite
entries or entries whose scaled value is no long, or if its length is not the
most frequent one (of equally frequent lengths, the larger).  The rest is the
fit list.  Repeated rows count, and come back, once each; a null ``vec_id``
stays null.  Components with no variance (beyond the rank of the list) are not
returned, so one vector, or copies of one, give no rows, as an empty table.
``deviation`` is null where it exceeds a long.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexis.llm.common import written

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
MAX_BASIS = 160
"""Columns of the search subspace, beyond which it is restarted from its leading Ritz vectors."""

BLOCK = 8
"""Open pairs whose correction equations are solved at once, the leading ones first."""

INNER_STEPS = 6
INNER_TOLERANCE = 0.05
OUTER_STEPS = 200
_EPS = np.finfo(float).eps

WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def scaled(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id, x array<bigint>`` of the rows of the fit list (of any length), x = floor(scale * entry) + shift."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    usable = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) * scale < float(1 << 62)), F.lit(False)))
    rows = rows.filter((F.size("v") > 0) & usable)
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * float(scale)).cast("long") + F.lit(shift).cast("long")).alias("x"))


@dataclass(frozen=True)
class Centring:
    """Count and exact sums of n vectors of ``dim`` entries; what a task needs to centre its rows."""

    n: int
    dim: int
    sums: tuple[int, ...]

    def whole(self) -> np.ndarray:
        """floor(S / n) of each dimension."""
        return np.array([s // self.n for s in self.sums], np.int64)

    def rest(self) -> np.ndarray:
        """S mod n of each dimension."""
        return np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, batch: pa.RecordBatch) -> np.ndarray:
        """x - S/n of the rows of a batch: the whole part exactly, then the fraction."""
        return self.offsets(batch).astype(np.float64) - self.rest() / self.n

    def offsets(self, batch: pa.RecordBatch) -> np.ndarray:
        column = batch.column("x").cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2], np.uint8)[at[0]:at[-1]]
        return np.frombuffer(raw.tobytes(), "<i8").reshape(-1, self.dim) - self.whole()

    def deviations(self, offsets: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2 of the rows; None beyond a long."""
        n, rest = self.n, self.rest()
        top = int(np.abs(offsets).max(initial=0)) * n + n
        if top * top * self.dim < 1 << 63:
            y = offsets * n - rest
            return (y * y).sum(axis=1).tolist()
        y = offsets.astype(object) * n - rest.astype(object)
        return [total if total < 1 << 63 else None for total in (y * y).sum(axis=1).tolist()]


@dataclass(frozen=True)
class Fit:
    """A written table ``vec_id, x`` (packed longs) with its centring."""

    table: DataFrame
    centring: Centring


def fit_list(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> Fit | None:
    """The vectors as a written table with their count and exact sums; None if there is none."""
    def pack(batches):
        for batch in batches:
            column = batch.column("x")
            flat = column.flatten().to_numpy(zero_copy_only=False).astype("<i8")
            size = np.diff(column.offsets.to_numpy())
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer((np.r_[0, np.cumsum(size)] * 8).astype(np.int64)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(size, pa.int32()), data.cast(pa.binary())], names=["vec_id", "dim", "x"])

    packed = written(scaled(df, id_col, vec_col, scale, shift).mapInArrow(pack, "vec_id long, dim int, x binary"), "whitening")
    lengths = packed.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return None
    dim, n = lengths[0]["dim"], lengths[0]["count"]
    table = packed.filter(F.col("dim") == dim).select("vec_id", "x")
    raw = Centring(1, dim, (0,) * dim)

    def add(batches):
        # high and low halves, so that no sum of a batch leaves a long
        high, low = [0] * dim, [0] * dim
        for batch in batches:
            x = raw.offsets(batch)
            high = [a + b for a, b in zip(high, (x >> 32).sum(axis=0).tolist())]
            low = [a + b for a, b in zip(low, (x & 0xFFFFFFFF).sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(high, pa.decimal128(38, 0)), pa.array(low, pa.decimal128(38, 0))], names=["i", "high", "low"])

    sums = table.mapInArrow(add, "i int, high decimal(38,0), low decimal(38,0)").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    sums = {r["i"]: (int(r["high"]) << 32) + int(r["low"]) for r in sums.collect()}
    return Fit(table, Centring(n, dim, tuple(sums[i] for i in range(dim))))


def _summed(fit: Fit, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``part`` (a matrix of ``shape``) of the centred rows, one partial matrix a task."""
    centred = fit.centring.centred

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            total += part(centred(batch))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["cell", "v"])

    cells = fit.table.mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(shape[0] * shape[1])
    out[cells["cell"].to_numpy()] = cells["v"].to_numpy()
    return out.reshape(shape)


def covariance_product(fit: Fit) -> Callable[[np.ndarray], np.ndarray]:
    """W -> V W, one Spark job a call, without V."""
    return lambda w: _summed(fit, w.shape, lambda rows: rows.T @ (rows @ w)) / fit.centring.n


def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to the spaces of ``against``; directions lost to rounding are dropped."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        for other in against:
            block = block - other @ (other.T @ block)
    kept = []
    for column in block.T:
        for _ in range(2):
            for other in kept:
                column = column - other * (other @ column)
            for other in against:
                column = column - other @ (other.T @ column)
        if (length := np.linalg.norm(column)) > 1e-8:
            kept.append(column / length)
    return np.array(kept).T if kept else np.zeros((block.shape[0], 0))


def minres_block(apply: Callable[[np.ndarray], np.ndarray], theta: np.ndarray, q: np.ndarray, b: np.ndarray,
                 steps: int = INNER_STEPS, tolerance: float = INNER_TOLERANCE) -> np.ndarray:
    """MINRES for ``P (V - theta_j) P t_j = b_j`` with ``P = I - QQ'``, one column per pair, products shared.

    Each column runs its own Lanczos recurrence; columns whose residual fell
    below ``tolerance`` times their right side stand still.
    """
    project = lambda w: w - q @ (q.T @ w)
    b = project(project(b))
    beta = np.linalg.norm(b, axis=0)
    target = tolerance * beta
    safe = np.where(beta > 0, beta, 1.0)
    v, v_old = b / safe, np.zeros_like(b)
    t, w, w_old = (np.zeros_like(b) for _ in range(3))
    c, c_old = np.ones(b.shape[1]), np.ones(b.shape[1])
    s, s_old = np.zeros(b.shape[1]), np.zeros(b.shape[1])
    eta, beta_k = beta.copy(), np.zeros(b.shape[1])
    for _ in range(steps):
        live = np.abs(eta) > target
        if not live.any():
            break
        av = np.zeros_like(v)
        av[:, live] = project(apply(v[:, live]) - v[:, live] * theta[live])
        alpha = (v * av).sum(axis=0)
        following = av - v * alpha - v_old * beta_k
        beta_next = np.linalg.norm(following, axis=0)
        # the two earlier rotations, then a new one that removes beta_next
        delta = c * alpha - c_old * s * beta_k
        upper = s * alpha + c_old * c * beta_k
        above = s_old * beta_k
        rho = np.hypot(delta, beta_next)
        live &= rho > 0
        rho = np.where(rho > 0, rho, 1.0)
        c_new, s_new = delta / rho, beta_next / rho
        w_new = (v - w_old * above - w * upper) / rho
        move = lambda old, new: np.where(live, new, old)
        t = t + np.where(live, c_new * eta, 0.0) * w_new
        w_old, w = move(w_old, w), move(w, w_new)
        eta = move(eta, -s_new * eta)
        c_old, s_old, c, s = move(c_old, c), move(s_old, s), move(c, c_new), move(s, s_new)
        v_old, v = move(v_old, v), move(v, following / np.where(beta_next > 0, beta_next, 1.0))
        beta_k = move(beta_k, beta_next)
    return project(t)


def leading_eigenpairs(apply: Callable[[np.ndarray], np.ndarray], dim: int, k: int, seed: int = 7,
                       max_basis: int = MAX_BASIS) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues (falling) of a symmetric operator of ``dim`` rows, and their unit eigenvectors.

    Ends when every residual ``|V u - e u|`` is at most ``16 eps sqrt(dim)``
    times the largest eigenvalue; raises if that is not reached.
    """
    k = min(k, dim)
    max_basis = max(max_basis, 3 * k)
    q, aq = np.zeros((dim, 0)), np.zeros((dim, 0))
    v = _orthonormal(np.random.default_rng(seed).normal(size=(dim, min(dim, k + 8))))
    av = apply(v)
    top = 0.0
    for _ in range(OUTER_STEPS):
        h = v.T @ av
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        v, av = v @ s, av @ s
        top = max(top, abs(theta[0]) if len(theta) else 0.0)
        want = min(k - q.shape[1], v.shape[1])
        residual = av[:, :want] - v[:, :want] * theta[:want]
        closed = np.linalg.norm(residual, axis=0) <= 16 * _EPS * math.sqrt(dim) * top
        lock = int(np.argmin(closed)) if not closed.all() else want
        q, aq = np.hstack([q, v[:, :lock]]), np.hstack([aq, av[:, :lock]])
        v, av, theta, residual, closed = v[:, lock:], av[:, lock:], theta[lock:], residual[:, lock:], closed[lock:]
        if q.shape[1] >= k:
            break
        if v.shape[1] > max_basis - k:
            v, av = v[:, :2 * k], av[:, :2 * k]
        open_ = np.flatnonzero(~closed)[:BLOCK]
        fixed = np.hstack([q, v[:, :len(closed)]])
        wider = -residual[:, open_]
        if q.shape[1] + v.shape[1] + len(open_) < dim:
            wider = minres_block(apply, theta[open_], fixed, wider)
        new = _orthonormal(wider, q, v)
        if q.shape[1] + v.shape[1] + new.shape[1] < min(dim, k) or not new.shape[1]:
            # the subspace cannot be widened by its residuals alone: take fresh directions, as far as there are any
            extra = np.random.default_rng(seed + q.shape[1] + v.shape[1]).normal(size=(dim, k))
            new = np.hstack([new, _orthonormal(extra, q, v, new)])
        if new.shape[1]:
            v, av = np.hstack([v, new]), np.hstack([av, apply(new)])
        else:
            # the whole space is searched: one fresh product removes what rounding the old ones gathered
            v = _orthonormal(v, q)
            av = apply(v)
    else:
        raise ArithmeticError("the residuals did not reach double precision")
    q, _ = np.linalg.qr(q)
    aq = apply(q)
    h = q.T @ aq
    e, s = np.linalg.eigh((h + h.T) / 2)
    return e[::-1][:k], (q @ s)[:, ::-1][:, :k]


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding",
           scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row per remaining vector and component: exact squared deviation, whitened value, explained share.

    ``identity_error`` is the largest absolute entry of the whitened values'
    covariance minus the identity, measured over the fit list.
    """
    fit = fit_list(df, id_col, vec_col, scale, shift)
    nothing = df.sparkSession.createDataFrame([], WHITENED)
    if fit is None:
        return nothing
    own = fit.centring
    e, u = leading_eigenpairs(covariance_product(fit), own.dim, components)
    real = e > own.dim * _EPS * max(e[0], 0.0)
    e, u = e[real], u[:, real]
    if not len(e):
        return nothing
    k, to_unit = len(e), u / np.sqrt(e)

    def moments(rows: np.ndarray) -> np.ndarray:
        white = rows @ to_unit
        return np.vstack([white.T @ white, np.full((1, k), (rows * rows).sum() / k)])

    found = _summed(fit, (k + 1, k), moments) / own.n
    identity_error = float(np.abs(found[:k] - np.eye(k)).max())
    explained = e / found[k].sum()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                rows = part.num_rows
                white = own.centred(part) @ to_unit
                ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k)))
                deviation = pa.array(own.deviations(own.offsets(part)), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k)))
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, own.n), pa.int64()), deviation,
                           pa.array(white.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, identity_error))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in WHITENED.split(", ")])

    return fit.table.mapInArrow(run, WHITENED)
