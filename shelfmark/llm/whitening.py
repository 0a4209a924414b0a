"""Whitening of embeddings by shifted CholeskyQR.

The centred rows are a tall matrix that stays in the table. A pass adds up the Gram matrix of what
the rows are after triangular solves with the factors found so far; its Cholesky factor is the next
one. The first factor is of a shifted matrix, so it exists however ill-conditioned the rows are; the
passes after it make the rows orthonormal to rounding. The product of the factors is R of the rows'
QR decomposition, and its singular values and right vectors are those of the rows. Only sums cross
the network: a task sends one d x d matrix, the driver holds a few, and d is the vectors' length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

COMPONENTS = 8
SCALE, OFFSET = 1024.0, 100_000
# Entries of this size or more are too long for exact whole numbers and count as not finite.
LARGEST = 2.0**31
# Passes end when rows are orthonormal to this, by entry: two after the shifted one, as a rule. If
# rows lie in fewer dimensions than they have entries, the rest never are, and the number ends it.
ORTHONORMAL, PASSES = 1e-11, 6
# Entries that a task multiplies at a time.
BLOCK = 1 << 20
_EPS = np.finfo(float).eps


@dataclass
class Whitening:
    """Vectors fitted and their sums by entry; components as columns, their variances and that of
    all entries; passes made; the largest entry of the whitened covariance minus the identity."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    total: float
    passes: int
    identity_error: float


def usable_vectors(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector has finite entries and no others."""
    v = F.col(column)
    held = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & held)


def _blocks(column: pa.Array):
    """Runs of a column of vectors of one length as whole numbers."""
    n = len(column)
    step = max(1, BLOCK // max(1, len(column[0]) if n else 1))
    for s in range(0, n, step):
        part = column.slice(s, step)
        flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield s, np.floor(SCALE * flat).astype(np.int64).reshape(len(part), -1) + OFFSET


def _sum(vectors: DataFrame, of) -> np.ndarray:
    """The sum over all rows of the matrix that ``of`` makes of a block of them.

    A task sends the rows of its sum; partial sums are added in the order of their bytes, so the
    result does not depend on which task ends first.
    """

    def partial(batches):
        held = None
        for batch in batches:
            for _, x in _blocks(batch.column(0)):
                part = of(x)
                held = part if held is None else held + part
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int32()), pa.array([r.tobytes() for r in held], pa.binary())], names=["i", "x"])

    def add(key, rows):
        parts = sorted(rows["x"].to_pylist())
        held = sum(np.frombuffer(p) for p in parts)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "x": pa.array([held.tobytes()], pa.binary())})

    rows = vectors.mapInArrow(partial, "i int, x binary").groupBy("i").applyInArrow(add, "i int, x binary").collect()
    return np.array([np.frombuffer(r.x) for r in sorted(rows)])


def _ranges(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums by entry, which entries differ between rows, and the largest magnitude; all exact."""

    def partial(batches):
        held = None
        for batch in batches:
            for _, x in _blocks(batch.column(0)):
                part = x.sum(axis=0), x.min(axis=0), x.max(axis=0)
                held = part if held is None else (held[0] + part[0], np.minimum(held[1], part[1]), np.maximum(held[2], part[2]))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(held[0])), pa.int32()), *(pa.array(h) for h in held)], names=["i", "s", "low", "high"])

    rows = vectors.mapInArrow(partial, "i int, s long, low long, high long").groupBy("i").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.min("low").alias("low"), F.max("high").alias("high")
    ).orderBy("i").collect()
    sums = np.array([int(r.s) for r in rows], object)
    return sums, np.array([r.low != r.high for r in rows]), max(max(abs(r.low), abs(r.high)) for r in rows)


def _apart(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n*x - S in whole numbers: 64 bits where they do, else numbers of any length."""
    return n * (x if sums.dtype == np.int64 else x.astype(object)) - sums


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, of which only the quotient is rounded."""
    return (_apart(x, n, sums) / n).astype(np.float64)


def _solved(x: np.ndarray, factors: list) -> np.ndarray:
    """The q with q r = x for the product r of upper triangular factors, one solve a factor."""
    for r in factors:
        q = np.empty_like(x)
        for j in range(r.shape[1]):
            q[:, j] = (x[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        x = q
    return x


def _cholesky(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper factor, of a matrix shifted further where rounding leaves it without one."""
    least = _EPS * max(float(np.trace(gram)), np.finfo(float).tiny)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(4 * shift, least)


def _factors(gram_of, n: int) -> tuple[list, float]:
    """Factors of passes over the rows, and the trace of the first Gram matrix."""
    factors, trace = [], 0.0
    for done in range(PASSES):
        gram = gram_of(factors)
        gram = (gram + gram.T) / 2
        d = len(gram)
        if done == 0:
            trace = float(np.trace(gram))
            # the usual shift, which bounds rounding; it must stay small beside the largest variance
            shift = min(11 * (float(n) * d + d * (d + 1)) * _EPS, 1e-3) * float(np.linalg.norm(gram, 2))
        elif np.abs(gram - np.eye(d)).max() <= ORTHONORMAL:
            break
        else:
            shift = 0.0
        factors = [*factors, _cholesky(gram, shift)]
    return factors, trace


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> tuple[Whitening | None, DataFrame]:
    """The whitening of all usable vectors of the commonest length (of equally common ones the
    longest), and the rows that have such a vector; None without any."""
    usable = usable_vectors(vectors, column)
    most = usable.groupBy(F.size(column).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return None, usable
    d, n = most
    usable = usable.where(F.size(column) == d)
    only = usable.select(F.col(column).cast("array<double>"))
    sums, differ, largest = _ranges(only)
    if n * largest < 1 << 61:
        sums = sums.astype(np.int64)
    varied = np.flatnonzero(differ)  # an entry without spread has no part in any component
    if not len(varied):
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0, 0.0), usable

    def gram_of(factors):
        def gram(x):
            q = _solved(_centred(x, n, sums)[:, varied], factors)
            return q.T @ q

        return _sum(only, gram)

    factors, trace = _factors(gram_of, n)
    r = factors[0]
    for f in factors[1:]:
        r = f @ r
    _, spread, rows = np.linalg.svd(r)
    count = min(components, len(varied))
    directions = np.zeros((d, count))
    directions[varied] = rows[:count].T
    top = directions[np.abs(directions).argmax(axis=0), range(count)]
    directions *= np.where(top < 0, -1.0, 1.0)
    variances = np.maximum(spread[:count] ** 2 / n, np.finfo(float).tiny)

    def moments(x):
        w = _centred(x, n, sums) @ directions / np.sqrt(variances)
        return np.concatenate((w.sum(axis=0, keepdims=True), w.T @ w))

    # What whitened rows really are; a direction in which rows do not spread shows here, and is none.
    found = _sum(only, moments)
    covariance = found[1:] / n - np.outer(found[0] / n, found[0] / n)
    real = np.flatnonzero(np.logical_and.accumulate(np.abs(np.diag(covariance) - 1) < 0.5))
    error = np.abs(covariance[np.ix_(real, real)] - np.eye(len(real)))
    return Whitening(n, sums, directions[:, real], variances[real], trace / n, len(factors), float(error.max(initial=0.0))), usable


def whitened(usable: DataFrame, model: Whitening, column: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """A row for every vector and component, as ``embedding_whitening`` gives them."""
    n, sums = model.n, model.sums
    turn = model.directions / np.sqrt(model.variances)
    explained = model.variances / (model.total or 1.0)
    k = len(explained)
    kind = usable.schema[id_column].dataType

    def spread(batches):
        for batch in batches:
            for s, x in _blocks(batch.column(1)):
                apart = _apart(x, n, sums)
                w = (apart / n).astype(np.float64) @ turn
                if len(apart) and float(np.abs(apart).max()) ** 2 * apart.shape[1] >= 2.0**62:
                    apart = apart.astype(object)
                far = [v if v < 1 << 63 else None for v in (apart**2).sum(axis=1).tolist()]
                ids = batch.column(0).slice(s, len(x)).take(pa.array(np.repeat(np.arange(len(x)), k)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)),
                     pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(w.ravel()),
                     pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, model.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable.select(F.col(id_column).alias("vec_id"), F.col(column).cast("array<double>")).mapInArrow(spread, _schema(kind))


def _schema(kind: T.DataType) -> T.StructType:
    out = T.StructType().add("vec_id", kind)
    for name, of in (("component", "integer"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")):
        out = out.add(name, of)
    return out


def embedding_whitening(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for every usable
    vector and component, by falling variance from 1.

    An entry c becomes floor(1024 c) + 100000. Vectors that are null or empty, or hold entries that
    are null, not finite or of 2^31 or more, give no row, nor do those of another length than the
    commonest. Repeated rows count each, and a null id is an id. Components without spread are left
    out: equal vectors, one vector or an empty table give no rows. The largest entry of a component
    is positive. ``deviation`` is null where it is beyond 64 bits. Other columns do not count.
    """
    model, usable = fit_whitening(vectors, components, column)
    if model is None or not len(model.variances):
        return vectors.sparkSession.createDataFrame([], _schema(vectors.schema[id_column].dataType))
    return whitened(usable, model, column, id_column)
