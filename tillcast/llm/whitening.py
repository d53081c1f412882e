"""Whitening of embeddings by their leading principal components.

Components are found by Jacobi-Davidson without ever forming the covariance:
all that is asked of the data are products of the centred covariance with a few
vectors, each one Spark pass over the packed fit list whose partial sums are
added by key, so the driver gets ``dimension * vectors`` numbers however many
tasks there are.  The subspace's Ritz pairs are corrected by the projected
equation ``(I-QQ')(V-theta)(I-QQ') t = -r``, solved roughly by MINRES (all open
pairs in step, so a pass serves them all); a pair whose residual has reached
double precision is locked.

Results in odd cases: rows whose vector is null or empty, has null or non-finite entries,
or entries too large for a long after scaling, are dropped; so are rows whose
vector has another length than most (of equally frequent lengths the longest
counts).  Repeated vectors count once in the fit and each row is returned;
repeated or null ids stay as they are.  A component whose eigenvalue is zero to
double precision has no whitened value and is not returned, so vectors that
span fewer than ``k`` dimensions give fewer components and equal vectors none.
``deviation`` is exact and null where it exceeds a long.  An empty table gives
no rows.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm.common import staged, task

COMPONENTS = 4
SCALE = 256
#: Vectors packed into a row of the fit list.
PACKED = 2048
#: Residuals, relative to the largest eigenvalue, at which a pair is locked.
TOLERANCE = 256 * np.finfo(float).eps
INNER = 12
OUTER = 200


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id`` and the scaled integer vector ``x`` of every row that has one of the usual length."""
    c = F.col(f"`{vector_col}`").cast("array<double>")
    limit = float(2 ** 62) / SCALE
    sound = F.forall(c, lambda v: F.coalesce(F.abs(v) < limit, F.lit(False)))     # false for NaN too: it is the greatest
    rows = df.select(F.col(f"`{id_col}`").alias("id"), c.alias("c")).filter(F.col("c").isNotNull() & (F.size("c") > 0) & sound)
    sizes = rows.groupBy(F.size("c").alias("d")).agg(F.count(F.lit(1)).alias("rows"))
    usual = sizes.agg(F.max(F.struct("rows", "d")).alias("m")).first()["m"]
    if usual is not None:
        rows = rows.filter(F.size("c") == usual["d"])
    return rows.select("id", F.transform("c", lambda v: F.floor(v * SCALE).cast("long")).alias("x"))


def _matrix(column) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), dtype=np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, PACKED):
            m = np.ascontiguousarray(_matrix(b.column("x").slice(at, PACKED)), dtype="<i8")
            yield pa.RecordBatch.from_pydict({"rows": pa.array([len(m)], pa.int32()), "block": pa.array([m.tobytes()], pa.binary())})


class Fit:
    """The distinct vectors, packed and staged, and sums over them."""

    def __init__(self, vectors: DataFrame):
        # Copies are dropped in each task before the shuffle.
        self.blocks = staged(vectors.select("x").distinct().mapInArrow(task(_pack), "rows int, block binary"), "fit-blocks")
        head = self.blocks.agg(F.sum("rows").cast("long").alias("n"),
                               F.max((F.octet_length("block") / F.col("rows") / 8).cast("int")).alias("d")).first()
        self.n, self.d = head["n"] or 0, head["d"] or 0
        self.sums = self._added(lambda m: m.sum(axis=0, dtype=np.int64), "long", np.int64) if self.n else np.zeros(0, np.int64)
        self.mean = self.sums / max(self.n, 1)

    def _added(self, of: Callable[[np.ndarray], np.ndarray], kind: str = "double", dtype=np.float64) -> np.ndarray:
        """Sum of ``of(vectors)`` over all blocks: every task adds its own, Spark adds theirs by place."""
        d, arrow = self.d, pa.int64() if kind == "long" else pa.float64()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for raw in b.column("block"):
                    part = of(np.frombuffer(raw.as_buffer(), dtype="<i8").reshape(-1, d)).ravel()
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(total), dtype=np.int32)), "v": pa.array(total, arrow)})

        got = self.blocks.select("block").mapInArrow(run, f"i int, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(len(got), dtype=dtype)
        for r in got:
            out[r["i"]] = r["v"]
        return out

    def covariance_times(self, q: np.ndarray) -> np.ndarray:
        """The covariance times the columns of ``q``; vectors are centred first."""
        mean = self.mean

        def of(m: np.ndarray) -> np.ndarray:
            y = m - mean
            return y.T @ (y @ q)

        return self._added(of).reshape(self.d, -1) / self.n

    def trace(self) -> float:
        mean = self.mean
        return float(self._added(lambda m: np.square(m - mean).sum(axis=0)).sum() / self.n)

    def identity_error(self, scaled: np.ndarray) -> float:
        """Largest entry of the whitened vectors' covariance minus the identity."""
        mean, k = self.mean, scaled.shape[1]
        if not k:
            return 0.0
        centre = self._added(lambda m: ((m - mean) @ scaled).sum(axis=0)) / self.n

        def of(m: np.ndarray) -> np.ndarray:
            w = (m - mean) @ scaled - centre
            return w.T @ w

        return float(np.abs(self._added(of).reshape(k, k) / self.n - np.eye(k)).max())


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Columns that span what ``new`` adds to the orthonormal columns of ``against``."""
    kept = np.concatenate([a for a in against if a.size] or [np.zeros((len(new), 0))], axis=1)
    for v in new.T:
        size = np.linalg.norm(v)
        for _ in range(3):
            v = v - kept @ (kept.T @ v)
        left = np.linalg.norm(v)
        if size > 0 and left > 1e-10 * size:
            v = v / left
            v = v - kept @ (kept.T @ v)
            kept = np.concatenate([kept, (v / np.linalg.norm(v))[:, None]], axis=1)
    return kept[:, kept.shape[1] - (kept.shape[1] - sum(a.shape[1] for a in against if a.size)):]


def _minres(times: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, goal: float) -> np.ndarray:
    """Each column of ``b`` solved for by MINRES on its own; one call of ``times`` a step for all."""
    norm = np.linalg.norm(b, axis=0)
    x, safe = np.zeros_like(b), np.where(norm > 0, norm, 1)
    v, v_old = b / safe, np.zeros_like(b)
    d, d_old = np.zeros_like(b), np.zeros_like(b)
    beta, eta = np.zeros(b.shape[1]), norm.copy()
    c, c_old, s, s_old = (np.ones(b.shape[1]), np.ones(b.shape[1]), np.zeros(b.shape[1]), np.zeros(b.shape[1]))
    on = norm > 0
    for _ in range(steps):
        if not on.any():
            break
        p = times(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * v_old
        beta_new = np.linalg.norm(p, axis=0)
        r1, r2, r3 = s_old * beta, s * alpha + c_old * c * beta, c * alpha - c_old * s * beta
        rho = np.hypot(r3, beta_new)
        on &= rho > 0
        rho = np.where(rho > 0, rho, 1)
        c_old, s_old, c, s = c, s, r3 / rho, beta_new / rho
        d, d_old = (v - r2 * d - r1 * d_old) / rho, d
        x = x + np.where(on, c * eta, 0) * d
        eta = -s * eta
        on &= (np.abs(eta) > goal * norm) & (beta_new > 1e-14 * np.abs(alpha))
        v_old, v, beta = v, p / np.where(beta_new > 0, beta_new, 1), beta_new
    return x


def eigenpairs(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors of a symmetric
    positive semidefinite operator of which only products are known."""
    k = min(k, d)
    most = min(d, max(6 * k, 16))
    locked, values = np.zeros((d, 0)), []
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((d, min(d, 2 * k))))
    image = times(basis)
    scale, worst, stalled = 0.0, np.inf, 0
    for _ in range(OUTER):
        theta, s = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        order = np.argsort(-theta)
        theta, s = theta[order], s[:, order]
        basis, image = basis @ s, image @ s
        scale = max(scale, abs(theta[0]))
        need = k - len(values)
        residual = image[:, :need] - basis[:, :need] * theta[:need]
        size = np.linalg.norm(residual, axis=0)
        # In order only: a pair is locked when none before it is open.
        done = 0
        while done < min(need, len(size)) and size[done] <= TOLERANCE * scale:
            done += 1
        stalled = stalled + 1 if size.max() > 0.5 * worst else 0
        worst = size.max() if done else min(worst, size.max())
        if done:
            locked = np.concatenate([locked, basis[:, :done]], axis=1)
            values += theta[:done].tolist()
            basis, image, theta, residual, worst, stalled = basis[:, done:], image[:, done:], theta[done:], residual[:, done:], np.inf, 0
            need = k - len(values)
            if not need:
                break
        if stalled >= 12:
            raise ArithmeticError(f"residual {worst} of {scale} does not fall")
        if basis.shape[1] >= most:
            basis, image = basis[:, :3 * need], image[:, :3 * need]
            basis, image, theta = basis, image, theta[:3 * need]
        wanted, shift = basis[:, :residual.shape[1]], theta[:residual.shape[1]]
        q = np.concatenate([locked, wanted], axis=1)

        def outside(y: np.ndarray) -> np.ndarray:
            return y - q @ (q.T @ y)

        t = _minres(lambda y: outside(times(outside(y)) - outside(y) * shift), -outside(residual), INNER, 0.02) if residual.size else residual
        new = _orthonormal(np.concatenate([t, residual], axis=1), locked, basis)
        if basis.shape[1] + new.shape[1] > d - len(values):
            new = new[:, :d - len(values) - basis.shape[1]]
        if not new.shape[1]:
            new = _orthonormal(np.random.default_rng(seed + 1 + len(values)).standard_normal((d, need + 1)), locked, basis)
            if not new.shape[1]:       # the subspace is whole: its Ritz pairs are the eigenpairs
                locked = np.concatenate([locked, basis[:, :need]], axis=1)
                values += theta[:need].tolist()
                break
        basis, image = np.concatenate([basis, new], axis=1), np.concatenate([image, times(new)], axis=1)
    else:
        raise ArithmeticError("eigenpairs not found")
    return np.array(values), locked


def whiten(df: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row and component: ``id_col``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    rows = integer_vectors(df, id_col, vector_col)
    fit = Fit(rows)
    kind = df.schema[id_col].dataType
    schema = f"id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not fit.n:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    trace = fit.trace()
    values, vectors = eigenpairs(fit.covariance_times, fit.d, k) if trace > 0 else (np.zeros(0), np.zeros((fit.d, 0)))
    real = values > 16 * fit.d * np.finfo(float).eps * (values[0] if len(values) else 1)
    values, vectors = values[real], vectors[:, real]
    scaled = vectors / np.sqrt(values)
    error, share = fit.identity_error(scaled), values / trace if trace > 0 else values
    n, sums, mean, many = fit.n, fit.sums, fit.mean, len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = [int(s) for s in sums]
        for b in batches:
            m = _matrix(b.column("x"))
            if not len(m) or not many:
                continue
            # In integers while no sum can leave a long, else in Python's.
            if (float(np.abs(m).max()) * n + float(np.abs(sums).max())) ** 2 * m.shape[1] < 2.0 ** 62:
                deviation = np.square(m * n - sums).sum(axis=1).tolist()
            else:
                deviation = [sum((n * x - s) ** 2 for x, s in zip(v, exact)) for v in m.tolist()]
                deviation = [v if v < 2 ** 63 else None for v in deviation]
            w = (m - mean) @ scaled
            at = np.repeat(np.arange(len(m)), many)
            tile = lambda v: np.tile(v, len(m))
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(at)), pa.array(tile(np.arange(1, many + 1, dtype=np.int32))), pa.array(np.full(len(at), n)),
                 pa.array(deviation, pa.int64()).take(pa.array(at)), pa.array(w.ravel()), pa.array(tile(share)), pa.array(np.full(len(at), error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(task(run), schema).withColumnRenamed("id", id_col)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: the first four whitened components of every embedding."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
