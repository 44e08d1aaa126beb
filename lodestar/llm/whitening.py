"""Whitening of embeddings on their leading principal components, without ever forming the covariance.

An entry c becomes the integer x = floor(1024 c) + 100000, so counts, sums and each row's distance from the mean are exact:
n x - S is an integer. The components come from block subspace iteration: a pass of Spark multiplies the centred rows,
X'(XQ) / n, for a block Q of orthonormal columns that travels to the tasks; each task sends back one matrix, which Spark
adds up by its entries. On the driver, Rayleigh-Ritz turns the block into approximate components and QR of the image into
the next block. The iteration ends when the residuals |V u - e u| of all k components are within ``TOLERANCE`` of the
largest eigenvalue. A block that converges by less than a factor of ten a pass is doubled, at most to the dimension, where
it holds all components; a spectrum without gaps so takes a few passes, not hundreds.

Work is one pass over the saved vectors a block; the driver holds a few matrices of dimension x block, whatever the rows.

Defined results: null vectors, empty ones, and those with null or non-finite entries take no part; nor do those with an
entry of 2^50 or more in size (x would leave the exact range), or with another length than the most frequent one (ties to the
longer). Rows with null or repeated ids stay, each on its own. Components whose eigenvalue is under 1e-10 of the largest
can't be whitened and are left out, so equal vectors alone, or an empty table, give no rows. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, small_batches

COMPONENTS, EXTRA = 8, 8
SCALE, SHIFT = 1024, 100_000
TOLERANCE, LEAST = 1e-14, 1e-10
_SURE = 1 << 62


@dataclass
class Whitening:
    n: int
    sums: list[int]  # of the integer vectors, by dimension
    vectors: np.ndarray  # a column for each component
    values: np.ndarray  # eigenvalues, falling
    trace: float

    def coordinates(self, apart: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows given as n x - S."""
        return (apart.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.values)


def integers(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(len(column), -1) + SHIFT


def apart(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: in 64 bits where they suffice, else in Python's integers."""
    if max(int(np.abs(x).max(initial=0)) * n, *map(abs, sums)) < _SURE:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(d: np.ndarray) -> list[int | None]:
    top = int(np.abs(d).max(initial=0))
    if d.dtype != object and top * top * d.shape[1] < _SURE:
        return (d * d).sum(axis=1).tolist()
    exact = (d.astype(object) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def usable(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part."""
    kind = "float" if embeddings.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 50))))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if len(batch):
                x = integers(batch.column(0))
                n += len(x)
                small = int(np.abs(x).max()) * len(x) < _SURE
                part = (x if small else x.astype(object)).sum(axis=0).astype(object)
                total = part if total is None else total + part
        if n:
            # a sum beyond 38 digits would take more rows than there are
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([str(int(s)) for s in total])], names=["i", "n", "s"])

    found = small_batches(rows).select("v").mapInArrow(run, "i int, n long, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return (found[0]["n"], [int(r["s"]) for r in found]) if found else (0, [])


def _added(rows: DataFrame, n: int, sums: list[int], made: Callable[[np.ndarray], np.ndarray]) -> dict[tuple[int, int], float]:
    """The sum over all rows' batches of the matrix that ``made`` gives for n x - S: added in each task, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                part = made(apart(integers(batch.column(0)), n, sums))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    added = small_batches(rows).select("v").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return {(r["i"], r["j"]): r["v"] for r in added.collect()}  # dimension x block entries


def _matrix(entries: dict[tuple[int, int], float], rows: int, columns: int) -> np.ndarray:
    out = np.zeros((rows, columns))
    for (i, j), v in entries.items():
        out[i, j] = v
    return out


def image(rows: DataFrame, n: int, sums: list[int], block: np.ndarray) -> tuple[np.ndarray, float]:
    """X'(XQ) / n and the trace of X'X / n over the centred rows: one pass of Spark."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def made(d: np.ndarray) -> np.ndarray:
        x = d.astype(np.float64) / n
        spread = np.zeros((1, sent.value.shape[1]))
        spread[0, 0] = (x * x).sum()
        return np.vstack([x.T @ (x @ sent.value), spread])

    out = _matrix(_added(rows, n, sums, made), len(block) + 1, block.shape[1]) / n
    sent.destroy()
    return out[:-1], float(out[-1, 0])


def fit(rows: DataFrame, k: int = COMPONENTS, *, extra: int = EXTRA, tolerance: float = TOLERANCE, seed: int = 11) -> Whitening | None:
    """The leading components of ``rows`` (id, v), a saved table as ``usable`` gives it; None if there is no spread."""
    n, sums = _sums(rows)
    if not n:
        return None
    dim, rng, last = len(sums), np.random.default_rng(seed), np.inf
    block = np.linalg.qr(rng.standard_normal((dim, min(dim, k + extra))))[0]
    while True:
        moved, trace = image(rows, n, sums, block)
        ritz = block.T @ moved
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, moved = block @ turn, moved @ turn
        if not values[0] > 0:
            return None
        wanted = int((values[:k] > LEAST * values[0]).sum())
        residual = np.sqrt(((moved - vectors * values)[:, : min(k, len(values))] ** 2).sum(axis=0)).max() / values[0]
        if residual <= tolerance or block.shape[1] == dim:  # a block of all dimensions leaves rounding alone
            return Whitening(n, sums, vectors[:, :wanted], values[:wanted], trace)
        more = min(dim, 2 * block.shape[1]) - block.shape[1] if residual > last / 10 else 0
        last = residual
        block = np.linalg.qr(np.hstack([moved, rng.standard_normal((dim, more)) * values[0]]))[0]


def identity_error(rows: DataFrame, found: Whitening) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, measured in a pass of its own."""
    k = len(found.values)

    def made(d: np.ndarray) -> np.ndarray:
        w = found.coordinates(d)
        return np.vstack([w.T @ w, w.sum(axis=0, keepdims=True)])

    out = _matrix(_added(rows, found.n, found.sums, made), k + 1, k) / found.n
    return float(np.abs(out[:-1] - np.outer(out[-1], out[-1]) - np.eye(k)).max())  # rows are centred before: their mean is rounding


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component: its whitened coordinate, the component's share of the variance, and how well all is white."""
    spark = embeddings.sparkSession
    rows = Saved(usable(embeddings, id_col, vector_col), "vectors").df
    found = fit(rows, k)
    if found is None:
        return spark.createDataFrame([], SCHEMA)
    error, sent = identity_error(rows, found), spark.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        count = len(fitted.values)
        shares = fitted.values / fitted.trace
        for batch in batches:
            if not len(batch):
                continue
            d = apart(integers(batch.column(1)), fitted.n, fitted.sums)
            at = np.repeat(np.arange(len(d)), count)
            white, far = fitted.coordinates(d), pa.array(deviations(d), pa.int64())
            component = np.tile(np.arange(1, count + 1), len(d))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(component, pa.int32()), pa.array(np.full(len(at), fitted.n)), far.take(pa.array(at)), pa.array(white.ravel()), pa.array(np.tile(shares, len(d))), pa.array(np.full(len(at), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return small_batches(rows).select("id", "v").mapInArrow(run, SCHEMA)


def op12(embeddings: DataFrame) -> DataFrame:
    return whiten(embeddings)
