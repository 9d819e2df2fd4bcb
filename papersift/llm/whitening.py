"""Embedding whitening by shifted CholeskyQR.

Rows become integer vectors x; the fit list A holds each distinct one once, centred (n * x - S is an exact integer, so
centring costs one rounding).  Every pass over the stored fit list solves A's rows through the triangular factors found
so far, sums their Gram matrix, and gives the next factor: the first Cholesky is shifted so that it always exists, the
next ones remove what the shift left.  A = Q R_k .. R_1 with Q's Gram matrix known, so the singular values and right
vectors of the small factor are those of A: the covariance is never formed for its eigenvectors.

Scale: a task adds its rows up to one Gram matrix; these are added up row by row in a shuffle by matrix row, and the
driver gets one d x d matrix a pass, whatever the number of vectors.  Output is one narrow pass.

Defined results: vectors that are null or hold a null or non-finite entry are dropped; null and repeated ids stay, row by
row; equal vectors count once in the fit; components without variance (singular value below ``d`` roundings of the
largest) don't exist, so fewer than 16 rows a vector, or none, may come; an empty table gives no rows.  Vectors of
different length, and entries too large for exact long results, are errors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersift.llm.common import bounded_batches, column, stored

COMPONENTS, SCALE, OFFSET = 16, 64, 1_000_000
#: Gram passes at most; each takes directions a factor of about 1e9 smaller into Q.
PASSES = 4
_ROUNDING = 2.0**-53
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integer_vectors(table: DataFrame) -> DataFrame:
    """``vec_id`` and ``x`` (array of long) of the rows whose vector is whole and finite."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    x = F.transform("embedding", lambda c: F.floor(SCALE * c.cast("double")) + F.lit(OFFSET).cast("long"))
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(whole).select("vec_id", x.alias("x"))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    values = column(batch, "x").flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.int64, copy=False).reshape(len(batch), width)


def solved(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """``rows @ inv(upper)`` by substitution, column after column."""
    out = np.empty_like(rows)
    for j in range(upper.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


@dataclass
class Centre:
    n: int
    sums: np.ndarray  # of long

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        largest = int(np.abs(x).max(initial=0)) * self.n + int(np.abs(self.sums).max(initial=0))
        if largest >= 2**63:
            raise OverflowError("n * x - S does not fit a long")
        return x * np.int64(self.n) - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        moved = self.scaled(x)
        if int(np.abs(moved).max(initial=0)) ** 2 * max(1, x.shape[1]) < 2**63:
            return (moved * moved).sum(axis=1)
        exact = [sum(v * v for v in row) for row in moved.tolist()]
        if max(exact) >= 2**63:
            raise OverflowError("a deviation does not fit a long")
        return np.array(exact, dtype=np.int64)


def centre(fit: DataFrame, width: int) -> Centre:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(width, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch, width)
            if int(np.abs(x).max(initial=0)) * len(x) >= 2**62 or int(np.abs(sums).max(initial=0)) >= 2**62:
                raise OverflowError("the sums do not fit a long")
            n, sums = n + len(x), sums + x.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(width + 1), pa.int32()), "v": pa.array([n, *sums.tolist()], pa.int64())})

    made = {r.k: r.v for r in fit.mapInArrow(run, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    return Centre(made.get(0, 0), np.array([made.get(k + 1, 0) for k in range(width)], dtype=np.int64))


def gram(fit: DataFrame, at: Centre, made) -> np.ndarray:
    """The Gram matrix of ``made(centred rows)`` over the fit list."""
    width = len(at.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            rows = made(at.centred(_matrix(batch, width)))
            own = rows.T @ rows
            total = own if total is None else total + own
        if total is not None:
            yield _rows(dict(enumerate(total)))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(column(batch, "k").to_pylist(), column(batch, "v")):
                v = v.values.to_numpy()
                total[k] = total[k] + v if k in total else v
        yield _rows(total)

    parts = fit.mapInArrow(run, "k int, v array<double>").repartition("k").mapInArrow(added, "k int, v array<double>").collect()
    return np.array([r.v for r in sorted(parts, key=lambda r: r.k)])


def _rows(rows: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"k": pa.array(list(rows), pa.int32()), "v": pa.array([v.tolist() for v in rows.values()], pa.list_(pa.float64()))})


@dataclass
class Whitening:
    centre: Centre
    directions: np.ndarray  # a column for each component, over the square root of its eigenvalue
    explained: np.ndarray
    identity_error: float


def fit_whitening(fit: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """``fit`` has each distinct vector ``x``, all of ``width`` entries, once."""
    at = centre(fit, width)
    n = at.n
    none = Whitening(at, np.empty((width, 0)), np.empty(0), 0.0)
    if not n or not width:
        return none
    factors: list[np.ndarray] = []

    def through(rows: np.ndarray) -> np.ndarray:
        for r in factors:
            rows = solved(rows, r)
        return rows

    trace, own = 0.0, np.empty((0, 0))
    for k in range(PASSES + 1):
        own = gram(fit, at, through)
        own = (own + own.T) / 2
        if not k:
            trace = float(np.trace(own))
            if trace <= 0:
                return none
        values = np.linalg.eigvalsh(own)
        if k == PASSES or (k and np.abs(own - np.eye(width)).max() <= 32 * width * _ROUNDING):
            break
        shift = 0.0 if k and values[0] > 0.25 else 11 * (n * width + width * (width + 1)) * _ROUNDING * values[-1]
        factors.append(np.linalg.cholesky(own + shift * np.eye(width)).T)
    # A's right singular vectors are those of (Q'Q)^(1/2) R_k .. R_1, and Q'Q is the identity but for missing directions
    values, vectors = np.linalg.eigh(own)
    small = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
    for r in reversed(factors):
        small = small @ r
    _, singular, turned = np.linalg.svd(small)
    rank = int((singular > 8 * width * _ROUNDING * singular[0]).sum())
    count = min(components, rank)
    axes = turned[:count].T
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(count)] < 0, -1.0, 1.0)
    singular = singular[:count]
    directions = axes / singular * np.sqrt(n)
    covariance = gram(fit, at, lambda rows: rows @ directions) / n
    return Whitening(at, directions, singular**2 / trace, float(np.abs(covariance - np.eye(count)).max()))


def whitened(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per whole vector and component, see WHITENED."""
    spark = table.sparkSession
    bounded_batches(spark)
    vectors = stored(integer_vectors(table), "vectors")
    fit = stored(vectors.select("x").distinct(), "fit-list")
    sizes = fit.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if sizes.least != sizes.most:
        raise ValueError(f"vectors have {sizes.least} to {sizes.most} entries")
    width = sizes.most or 0
    model = fit_whitening(fit, width, components)
    count = len(model.explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not count:
                continue
            x = _matrix(batch, width)
            rows = len(x)
            ids = column(batch, "vec_id").take(pa.array(np.repeat(np.arange(rows), count)))
            values = {
                "vec_id": ids, "component": pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                "n": pa.array(np.full(rows * count, model.centre.n, dtype=np.int64)), "deviation": pa.array(np.repeat(model.centre.deviations(x), count)),
                "whitened": pa.array((model.centre.centred(x) @ model.directions).reshape(-1)), "explained": pa.array(np.tile(model.explained, rows)),
                "identity_error": pa.array(np.full(rows * count, model.identity_error)),
            }
            yield pa.RecordBatch.from_pydict(values)

    return vectors.mapInArrow(run, WHITENED)
