"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become integers, x = floor(256 c); the model is fitted to every distinct integer vector once. A block of some
thirty orthonormal columns Q is filtered by a Chebyshev polynomial of the covariance: each term of its three-term
recurrence is one distributed pass that returns XᵀXQ of the centred rows, summed in Spark per dimension, so the driver
holds d x b numbers and no covariance. Eigenvalues below the block are damped, those above grow. After each filter
QR and Rayleigh-Ritz give the components and their residuals |Vq - eq|; the iteration ends when all wanted ones are
certified to rounding (``TOLERANCE`` of the largest eigenvalue). A spectrum that will not separate makes the
block grow; a block of all dimensions is exact after one pass.

Defined results: null vectors, and vectors with null or non-finite entries, are dropped; vectors of other lengths than
the most frequent one (the smaller on a tie) cannot share its covariance and are left out too; empty vectors have no
component. Repeated rows are all whitened, and fitted once. Components without variance have null `whitened`, with
`explained` null where nothing varies. `deviation` beyond 64 bits is null. A null vec_id is a value like any other;
an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType

from tapline.llm.common import mapped, saved, table

COMPONENTS = 4
BLOCK = 32
DEGREE = 16
TOLERANCE = 2e-14
#: Below this share of the trace an eigenvalue is rounding.
FLAT = 1e-13


@dataclass
class Model:
    n: int
    sums: np.ndarray  # exact sums per dimension, Python integers
    values: np.ndarray
    vectors: np.ndarray  # one column per component
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return (self.sums / self.n).astype(float)

    @property
    def scale(self) -> np.ndarray:
        """1 / sqrt(e), or not a number where a component has no variance."""
        flat = self.values <= FLAT * max(self.trace, 0.0)
        return np.where(flat, np.nan, 1.0 / np.sqrt(np.where(flat, 1.0, self.values)))


def integers(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x of the rows whose vector is whole."""
    c = F.col(vector)
    whole = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # the cast saturates at 64 bits; adding zero makes -0 a 0
    x = F.transform(c, lambda v: (F.floor(v.cast(DoubleType()) * 256) + 0).cast("long"))
    return df.filter(whole).select("vec_id", x.alias("x"))


def matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    col = batch.column(name)
    return np.asarray(col.flatten()).reshape(batch.num_rows, -1)


def moments(x: DataFrame) -> tuple[int, np.ndarray]:
    """Number of vectors and their exact sums per dimension."""
    def run(batch: pa.RecordBatch) -> dict:
        m = matrix(batch)
        small = len(m) * float(np.abs(m.astype(float)).max()) < 2.0 ** 62
        sums = m.sum(axis=0) if small else m.astype(object).sum(axis=0)
        return {"i": np.arange(m.shape[1]), "n": np.full(m.shape[1], len(m)),
                "s": pa.array([int(v) for v in sums], pa.decimal128(38, 0))}

    rows = mapped(x, run, "i int, n long, s decimal(38,0)").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("s").cast(DecimalType(38, 0)).alias("s")).orderBy("i").collect()
    return rows[0]["n"] if rows else 0, np.array([int(r["s"]) for r in rows], object)


def summed(x: DataFrame, fn, width: int) -> np.ndarray:
    """Sum over all rows of the matrices ``fn(batch matrix)``, added up per matrix row in Spark."""
    cols = [f"c{j}" for j in range(width)]

    def run(batch: pa.RecordBatch) -> dict:
        m = fn(matrix(batch))
        return {"i": np.arange(len(m))} | {c: np.ascontiguousarray(m[:, j]) for j, c in enumerate(cols)}

    rows = mapped(x, run, "i int, " + ", ".join(f"{c} double" for c in cols))
    out = rows.groupBy("i").agg(*[F.sum(c).alias(c) for c in cols]).orderBy("i").toPandas()
    return out[cols].to_numpy()


def applied(x: DataFrame, n: int, mean: np.ndarray, q: np.ndarray) -> np.ndarray:
    """V Q in one pass: rows are centred, then multiplied twice."""
    def fn(m: np.ndarray) -> np.ndarray:
        centred = m - mean
        return centred.T @ (centred @ q)

    return summed(x, fn, q.shape[1]) / n


def filtered(apply, q: np.ndarray, vq: np.ndarray, low: float, cut: float, top: float, degree: int) -> np.ndarray:
    """Scaled Chebyshev polynomial of V times Q, damping [low, cut]; vq = V Q is known."""
    centre, half = (cut + low) / 2, (cut - low) / 2
    first = sigma = half / (top - centre)
    before, now = q, (vq - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (apply(now) - centre * now) * (2 * after / half) - sigma * after * before
        sigma = after
    return now


def components(apply, d: int, k: int, block: int = BLOCK, degree: int = DEGREE, tolerance: float = TOLERANCE,
               rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their vectors, certified by residuals."""
    k, b = min(k, d), min(d, max(block, 2 * k))
    rng = np.random.default_rng(7)
    q = np.linalg.qr(rng.standard_normal((d, b)))[0]
    best = np.inf
    for turn in range(1, rounds + 1):
        vq = apply(q)
        h = q.T @ vq
        values, y = np.linalg.eigh((h + h.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        q, vq = q @ y, vq @ y
        top = max(values[0], 0.0)
        residual = np.linalg.norm(vq[:, :k] - q[:, :k] * values[:k], axis=0).max()
        if b == d or residual <= tolerance * top or top == 0.0 or (residual >= best / 2 and best <= 1e3 * tolerance * top):
            return values[:k], q[:, :k]  # certified, or as exact as the rounding of the sums lets it be
        if residual >= best / 2 and turn % 4 == 0:  # the spectrum does not separate behind the block
            more = min(d, 2 * b)
            q, b = np.linalg.qr(np.hstack([q, rng.standard_normal((d, more - b))]))[0], more
            continue
        best = min(best, residual)
        q = np.linalg.qr(filtered(apply, q, vq, 0.0, max(values[-1], 1e-3 * top), top, degree))[0]
    b = d  # never reached by spectra that separate at all; exact in one pass
    q = np.eye(d)
    values, y = np.linalg.eigh(apply(q))
    return values[::-1][:k], y[:, ::-1][:, :k]


def fit(x: DataFrame, k: int = COMPONENTS) -> tuple[DataFrame, DataFrame, Model | None]:
    """(the vectors of the usual length, the distinct ones, their model)."""
    lengths = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return x, x, None
    x = x.filter(F.size("x") == lengths["d"])
    distinct = saved(x.select("x").distinct(), "whitening", "zstd")
    n, sums = moments(distinct)
    mean = (sums / n).astype(float)
    values, vectors = components(lambda q: applied(distinct, n, mean, q), lengths["d"], k)
    squares = summed(distinct, lambda m: np.array([[((m - mean) ** 2).sum()]]), 1)
    model = Model(n, sums, values, vectors, float(squares[0, 0]) / n)
    return x, distinct, model


def projected(m: np.ndarray, model: Model) -> np.ndarray:
    return (m - model.mean) @ model.vectors * model.scale


def identity_error(x: DataFrame, model: Model) -> float | None:
    """Largest absolute entry of the whitened covariance minus the identity, over the distinct vectors."""
    ok = np.flatnonzero(~np.isnan(model.scale))
    if not len(ok):
        return None

    def fn(m: np.ndarray) -> np.ndarray:
        w = projected(m, model)[:, ok]
        return np.vstack([w.T @ w, w.sum(axis=0)])

    sums = summed(x, fn, len(ok)) / model.n
    return float(np.abs(sums[:-1] - np.outer(sums[-1], sums[-1]) - np.eye(len(ok))).max())


def deviations(m: np.ndarray, model: Model) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, in integers."""
    reach = model.n * float(np.abs(m.astype(float)).max()) + max(abs(int(s)) for s in model.sums)
    if reach * reach * m.shape[1] < 2.0 ** 62:
        return ((model.n * m - model.sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((model.n * m.astype(object) - model.sums) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def whitened(x: DataFrame, model: Model, error: float | None) -> DataFrame:
    """One row per vector and component."""
    k = len(model.values)

    def run(batch: pa.RecordBatch) -> dict:
        m = matrix(batch)
        rows = len(m)
        w = projected(m, model).reshape(-1)
        share = model.values / model.trace if model.trace > 0 else np.full(k, np.nan)
        return {"vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                "component": np.tile(np.arange(1, k + 1, dtype=np.int32), rows), "n": np.full(rows * k, model.n),
                "deviation": pa.array([v for v in deviations(m, model) for _ in range(k)], pa.int64()),
                "whitened": pa.array(w, mask=np.isnan(w)), "explained": pa.array(np.tile(share, rows), mask=np.isnan(np.tile(share, rows))),
                "identity_error": pa.array([error] * (rows * k), pa.float64())}

    return mapped(x, run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(df: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every whole vector on the first k components."""
    x = integers(df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    rows, distinct, model = fit(x, k)
    if model is None:
        return df.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, "
                                                   "explained double, identity_error double")
    error = identity_error(distinct, model)
    return whitened(rows, model, error)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
