"""Whitening of embeddings by shifted CholeskyQR.

The different integer vectors are the rows of a tall matrix A, centred.  A pass over them sums the Gram matrices
of tasks; its Cholesky factor R makes the rows of the next pass, A R^-1 by forward substitution, nearly
orthonormal.  The first factor is of the Gram matrix with a shift, which no rounding can make indefinite; two or
more passes after it bring orthogonality to rounding.  The product of the factors is the R of A = Q R, and its
singular values and right vectors are those of A.  Only R, of the size of one vector squared, is on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.staging import column_or_null, record_batch, small_batches, staged

#: Parts to which the tasks' matrices go to be summed, before one task sums those.
SUM_PARTS = 32
#: Passes after the shifted one, at most; rounding is reached after two unless vectors are linearly dependent.
MOST_PASSES = 5
#: Components whose share of the first one's variance is below this are taken for none.
LEAST_SHARE = 1e-18

_UNIT = np.finfo(float).eps / 2


def finite_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows whose vector holds no null and no entry that is not finite, and has the
    most frequent length (the longer one of two)."""
    kind = dict(embeddings.dtypes).get("embedding", "array<double>")
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = embeddings.select(column_or_null(embeddings, "vec_id", "long").alias("vec_id"), column_or_null(embeddings, "embedding", kind).alias("embedding"))
    whole = rows.filter(F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & (F.size("embedding") > 0))
    most = whole.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return whole.filter(F.size("embedding") == (most["d"] if most else 0))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy().reshape(n, -1).astype(kind, copy=False) if n else np.zeros((0, 0), kind)


_SUMS = pa.schema([("j", pa.int32()), ("high", pa.int64()), ("low", pa.int64()), ("n", pa.int64())])


def _column_sums(batches):
    """Of each dimension, sums of the upper and lower halves of the values: exact for any long values."""
    high = low = None
    n = 0
    for batch in batches:
        x = _matrix(batch.column(0), np.int64)
        if len(x):
            high, low = (np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1], np.int64)) if high is None else (high, low)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
            n += len(x)
    if n:
        yield record_batch(_SUMS, j=np.arange(len(high), dtype=np.int32), high=high, low=low, n=np.full(len(high), n))


_PART = pa.schema([("part", pa.int32()), ("m", pa.binary())])


def _added(batches):
    total, part = None, 0
    for batch in batches:
        for part, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):  # noqa: B007
            own = np.frombuffer(m)
            total = own.copy() if total is None else total + own
    if total is not None:
        yield record_batch(_PART, part=pa.array([part], pa.int32()), m=[total.tobytes()])


def _summed_over(rows: DataFrame, matrix: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of matrix(block) over blocks of the integer vectors, flat: by task, by part, then all."""

    def run(batches):
        total = None
        for batch in batches:
            x = _matrix(batch.column(0), np.int64)
            if len(x):
                own = matrix(x).ravel()
                total = own if total is None else total + own
        if total is not None:
            yield record_batch(_PART, part=pa.array([TaskContext.get().partitionId()], pa.int32()), m=[total.tobytes()])

    ddl = "part int, m binary"
    parts = rows.mapInArrow(run, ddl).repartition(SUM_PARTS, F.pmod("part", F.lit(SUM_PARTS))).mapInArrow(_added, ddl)
    return np.frombuffer(parts.repartition(1).mapInArrow(_added, ddl).first()["m"])


def _solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a r^-1 for upper triangular r, by forward substitution over the columns."""
    q = np.empty_like(a)
    for j in range(a.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _factor(gram: np.ndarray) -> np.ndarray:
    """The upper Cholesky factor, of a shifted matrix where rounding has made it indefinite."""
    shift = 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(100 * shift, len(gram) * _UNIT * np.trace(gram))


@dataclass
class Whitening:
    """What has been learned from n different integer vectors: sums by dimension, unit components with their
    variances by falling variance, the sum of all variances, and the largest entry of the whitened vectors'
    covariance minus the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float


def fit(vectors: DataFrame, components: int) -> Whitening | None:
    """The whitening of the different rows of vectors (x array<bigint>, all of one length); None without rows."""
    distinct = staged(vectors.select("x").distinct(), "whitening-fit")
    sums = distinct.mapInArrow(_column_sums, "j int, high long, low long, n long").groupBy("j").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n"))).orderBy("j").collect()
    if not sums:
        return None
    n, total = int(sums[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in sums]
    d, mean = len(total), np.array([s / n for s in total])
    factors: list[np.ndarray] = []

    def orthogonalised(x: np.ndarray) -> np.ndarray:
        q = x - mean
        for r in factors:
            q = _solved(q, r)
        return q.T @ q

    gram = _summed_over(distinct, orthogonalised).reshape(d, d)
    trace = float(np.trace(gram))
    if trace == 0:
        return Whitening(n, total, np.zeros((0, d)), np.zeros(0), 0.0, 0.0)
    shift = 11 * (n * d + d * (d + 1)) * _UNIT * float(np.linalg.eigvalsh(gram)[-1])
    factors.append(_factor(gram + shift * np.eye(d)))
    for k in range(MOST_PASSES):
        gram = _summed_over(distinct, orthogonalised).reshape(d, d)
        factors.append(_factor(gram))
        if k and np.abs(gram - np.eye(d)).max() <= 64 * d * _UNIT:
            break
    r = factors[0]
    for own in factors[1:]:
        r = own @ r
    _, s, vt = np.linalg.svd(r)
    kept = (np.arange(d) < components) & (s**2 > LEAST_SHARE * s[0] ** 2)
    variances, axes = s[kept] ** 2 / n, vt[kept]

    def moments(x: np.ndarray) -> np.ndarray:
        w = np.column_stack([(x - mean) @ (axes / np.sqrt(variances)[:, None]).T, np.ones(len(x))])
        return w.T @ w

    second = _summed_over(distinct, moments).reshape(len(axes) + 1, -1) / n
    covariance = second[:-1, :-1] - np.outer(second[:-1, -1], second[:-1, -1])
    return Whitening(n, total, axes, variances, trace / n, float(np.abs(covariance - np.eye(len(axes))).max()))


_ROWS = pa.schema([("vec_id", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])


def _whitened(w: Whitening):
    """Each row's exact deviation, n^2 * sum(x^2) - 2 * n * sum(x * S) + sum(S^2), and its components."""

    def run(batches):
        mean = np.array([s / w.n for s in w.sums])
        axes = (w.components / np.sqrt(w.variances)[:, None]).T
        squared, largest = sum(s * s for s in w.sums), max(abs(s) for s in w.sums)
        for batch in batches:
            x = _matrix(batch.column(1), np.int64)
            if not len(x):
                continue
            bound = max(abs(int(x.max())), abs(int(x.min())))
            kind = np.int64 if len(mean) * bound * max(bound, largest) < 1 << 63 else object
            own, sums = x.astype(kind), np.array(w.sums, kind)
            exact = w.n * w.n * (own * own).sum(axis=1).astype(object) - 2 * w.n * (own * sums).sum(axis=1).astype(object) + squared
            deviation = pa.array([Decimal(int(v)) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
            values = (x - mean) @ axes
            offsets = np.arange(len(x) + 1, dtype=np.int32) * axes.shape[1]
            yield record_batch(_ROWS, vec_id=batch.column(0), deviation=deviation, whitened=pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel())))

    return run


def whiten(embeddings: DataFrame, components: int = 4) -> DataFrame:
    """The leading whitened components of each embedding.

    embeddings: vec_id long, embedding array of float or double; other columns are ignored, whatever their
    names.  Entries c become x = floor(256 * c) (long; at its ends where they are beyond them).  The covariance
    is that of the different vectors x, each counted once, with divisor n.  Returns vec_id, component (from 1,
    by falling variance), n, deviation (decimal(38,0): the sum over dimensions of (n * x - S)^2, exact; null
    beyond 38 digits), whitened (the projection of x - S / n on the unit component, over the root of its
    variance), explained (the component's share of all variance) and identity_error (the largest entry of the
    whitened vectors' covariance minus the identity).

    Null vectors and those that hold null or non-finite entries are left out, as are empty ones and those of
    another length than the most frequent one (the longer of two).  A null vec_id is kept as it is, and repeated
    rows give repeated results.  Directions without variance are no components: of one vector, or of none, the
    result is empty.  Components of equal variance are any orthonormal ones of their space, the same for all rows.
    """
    small_batches(embeddings.sparkSession)
    vectors = finite_vectors(embeddings).select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * 256)).alias("x"))
    w = fit(vectors, components)
    if w is None or not len(w.variances):
        w = Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 1.0, 0.0)
        vectors = vectors.limit(0)
    rows = vectors.mapInArrow(_whitened(w), "vec_id long, deviation decimal(38,0), whitened array<double>")
    shares = F.array(*(F.lit(float(e / w.total)) for e in w.variances)).cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(w.identity_error).alias("identity_error"))
