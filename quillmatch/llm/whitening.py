"""Whitening of embeddings by a matrix-free block subspace iteration.

The covariance V is never made. A pass over the rows sums c (c' Q) of the centred rows c, a
table of as many rows as there are dimensions, from which comes VQ; QR and Rayleigh-Ritz
on the driver follow. Passes end when the residual |VQ - QT| of each of the wanted
components is within ``TOLERANCE`` of the greatest eigenvalue, and fail loudly otherwise.
The block is twice as wide as wanted (or as wide as there are dimensions), so the passes
needed hang on the eigenvalue beyond the block, not on the next one.

Vectors are whole numbers, x = floor(64 c) + 1000000, so their count n and sums S are exact, and
rows are centred as (n x - S) / n, whose numerator is exact too: the common offset costs no digits.
Tasks hold a batch and sums of dimensions by block; what meets on the driver is dimensions by
block numbers, whatever the rows.

Null and empty vectors and those with null, infinite or NaN entries are left out; vectors of
several lengths, and entries so large that n x or a deviation is beyond a long, are errors. Null
and repeated ids keep a result for each row. Components of no variance are left out, so one row,
or equal rows, give none; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.shared import stored, table, tidy

COMPONENTS = 32
SCALE, OFFSET = 64.0, 1_000_000
TOLERANCE, PASSES = 1e-12, 2000
ENTRIES = 1 << 20  # of vectors that a task works on at a time
WHITENED = "vec_id long, deviation long, whitened array<double>"


@dataclass
class Whitening:
    """n rows, their sums, the trace of the covariance, its greatest eigenvalues and their unit vectors as columns; the passes it took and the greatest residual."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    passes: int = 0
    residual: float = 0.0


def whole_vectors(rows: DataFrame, vector: str = "embedding", name: str = "vec_id") -> DataFrame:
    """(vec_id, x array<long>) of the rows that have a usable vector."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(v.isNotNull() & (F.size(v) > 0) & fine).select(F.col(name).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c * SCALE) + OFFSET).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches with their vectors as rows of a matrix."""
    for batch in batches:
        if not batch.num_rows:
            continue
        d = len(batch.column("x")[0])
        step = max(1, ENTRIES // d)
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            yield part, part.column("x").flatten().to_numpy().reshape(part.num_rows, d)


def moments(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """The number of vectors and the sum of each dimension, exactly."""
    seen = vectors.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most"), F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high")).first()
    n = seen["n"]
    if not n:
        return 0, np.zeros(0, np.int64)
    if seen["least"] != seen["most"]:
        raise ValueError(f"vectors of {seen['least']} to {seen['most']} entries")
    if n * max(seen["high"], -seen["low"]) >= 1 << 62:
        raise OverflowError("entries are too large for exact sums")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = None
        for _, x in _matrices(batches):
            s = x.sum(axis=0) if s is None else s + x.sum(axis=0)
        if s is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s))), pa.array(s)], ["i", "s"])

    sums = vectors.mapInArrow(tidy(run), "i long, s long").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    return n, np.array([r["s"] for r in sums], np.int64)


def _summed(vectors: DataFrame, width: int, part: object) -> np.ndarray:
    """The sum over tasks of the matrix (any rows, ``width`` columns) that ``part`` gives for the vectors of a batch; added up by row in a shuffle."""
    names = [f"y{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches):
            y = part(x)
            total = y if total is None else total + y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *[pa.array(np.ascontiguousarray(total[:, j])) for j in range(width)]], ["i", *names])

    sums = vectors.mapInArrow(tidy(run), ", ".join(["i long", *[f"{c} double" for c in names]])).groupBy("i").agg(*[F.sum(c).alias(c) for c in names])
    return np.array([r[1:] for r in sums.orderBy("i").collect()])


def _centred(n: int, sums: np.ndarray) -> object:
    return lambda x: (n * x - sums) / n


def fitted(vectors: DataFrame, k: int = COMPONENTS, block: int | None = None, tolerance: float = TOLERANCE, passes: int = PASSES, seed: int = 1) -> Whitening:
    """The k greatest components of the covariance (divisor n) of ``vectors`` (x); fewer if there are fewer dimensions, or no variance is left."""
    n, sums = moments(vectors)
    d = len(sums)
    k = min(k, d)
    if not n:
        return Whitening(0, sums, 0.0, np.zeros(0), np.zeros((d, 0)))
    centred, width = _centred(n, sums), min(d, block or 2 * k)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    for done in range(1, passes + 1):

        def part(x: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            c = centred(x)
            return np.hstack([c.T @ (c @ q), (c * c).sum(axis=0)[:, None]])

        y = _summed(vectors, width + 1, part) / n
        y, trace = y[:, :-1], float(y[:, -1].sum())
        small = q.T @ y
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        off = np.linalg.norm(y @ turn - q @ turn * values, axis=0)[:k].max()
        if off <= tolerance * max(values[0], 0.0) or trace == 0.0:
            has = int((values[:k] > max(values[0], 0.0) * 1e-11).sum())  # of the rest, rounding is all there is
            return Whitening(n, sums, trace, values[:has], (q @ turn)[:, :has], done, float(off))
        q = np.linalg.qr(y @ turn)[0]
    raise RuntimeError(f"components aren't certain after {passes} passes: residual {off:.3g} of {values[0]:.3g}")


def _whiten(fit: Whitening) -> object:
    centred, turn = _centred(fit.n, fit.sums), fit.vectors / np.sqrt(fit.values)
    return lambda x: centred(x) @ turn


def identity_error(vectors: DataFrame, fit: Whitening) -> float:
    """The largest entry of the whitened rows' covariance minus the identity. Centred rows sum to 0 exactly, and so do whitened ones."""
    white, k = _whiten(fit), len(fit.values)
    covariance = _summed(vectors, k, lambda x: (w := white(x)).T @ w) / fit.n
    return float(np.abs(covariance - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    far = n * x - sums
    if len(sums) * float(np.abs(far).max()) ** 2 < 2.0**62:
        return pa.array((far * far).sum(axis=1))
    return pa.array([sum(v * v for v in row) for row in far.tolist()], pa.int64())  # fails if one is beyond a long


def whitened(vectors: DataFrame, fit: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened) of every row; deviation is the sum of (n x - S)^2."""
    white, n, sums = _whiten(fit), fit.n, fit.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches):
            w = white(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), _deviations(x, n, sums), lists], ["vec_id", "deviation", "whitened"])

    return vectors.mapInArrow(tidy(run), WHITENED)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(whole_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding")))
    fit = fitted(vectors)
    has = len(fit.values)
    empty = spark.createDataFrame([], WHITENED)
    rows = whitened(vectors, fit) if has else empty
    error = identity_error(vectors, fit) if has else 0.0
    share = F.array(*[F.lit(float(v / fit.trace)) for v in fit.values]) if has else F.array().cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
