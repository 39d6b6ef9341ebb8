"""Whitening of embeddings by TSQR: no covariance of the input is ever formed.

Entries are put on an integer grid, x = floor(64 c) + 1,000,000, so sums and deviations are exact.

* The fit list holds each distinct vector once; it is written, so every later step reads the same rows.
* Its sums by dimension are whole numbers, added up in tasks and then by Spark.
* Every task centres its rows, x - S/n with the whole part of the mean taken off before anything is
  rounded, and folds them block by block into one triangular factor.
* Factors are merged FAN at a time until one is left; that one, as large as the number of dimensions
  squared, is all that reaches the driver. Its singular values and right vectors are those of all rows.
* Right vectors over singular values whiten every row of the input; the covariance of what comes out,
  at most 16 by 16 numbers, says how far it is from the identity.

A row takes a fixed amount of memory, a task a few blocks and one factor. Copies are counted once by a
grouping that adds up before the shuffle.

Results for odd input: rows whose vector is null or empty, or holds null, NaN, an infinity or an entry
whose x is no long, are dropped. So are vectors of another length than most distinct vectors have (ties:
the longer). Components whose singular value is rounding noise (constant or dependent dimensions, fewer
distinct vectors than dimensions) don't exist, so a single distinct vector or an empty table gives no
rows. Repeated rows are each returned, with null ids too. A deviation beyond a long is null. Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import Scratch, bounded_batches

GRID, OFFSET = 64, 1_000_000
#: Components returned, factors merged at once, rows folded into a factor at once, in units of the dimensions.
COMPONENTS, FAN, BLOCK = 16, 8, 8
RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"
_LONG = 2**63 - 1


@dataclass(frozen=True)
class Model:
    """n distinct vectors with their exact sums; columns of ``axes`` are unit eigenvectors by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    axes: np.ndarray
    trace: float

    @property
    def projection(self) -> np.ndarray:
        return self.axes / np.sqrt(self.eigenvalues)

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace


def on_grid(rows: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``keep`` and x, without rows that have none."""
    c = rows.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{vector}`").cast("array<double>").alias("_c"))
    most = float(2**62)
    fine = F.forall("_c", lambda v: F.coalesce(F.abs(v * GRID) < most, F.lit(False)) & ~F.isnan(F.coalesce(v, F.lit(float("nan")))))
    c = c.where(F.col("_c").isNotNull() & (F.size("_c") > 0)).where(fine)
    return c.select(*[F.col(f"`{k}`") for k in keep], F.transform("_c", lambda v: F.floor(v * GRID) + OFFSET).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S/n: the mean's whole part is taken off as integers."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n x - S) squared, exactly; null beyond a long."""
    if not len(x):
        return []
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    off = x - whole
    if (int(np.abs(off).max()) + 1) ** 2 * n * n * x.shape[1] <= _LONG:
        return ((n * off - rest) ** 2).sum(axis=1).tolist()
    out = ((n * off.astype(object) - rest.astype(object)) ** 2).sum(axis=1)
    return [v if v <= _LONG else None for v in out]


def _fold(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.concatenate([factor, rows]), mode="r")


def _sums(fit: DataFrame) -> tuple[int, tuple[int, ...]]:
    """How many vectors have the usual length, and their sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for batch in batches:
            column = batch.column(0)
            sizes = np.diff(column.offsets.to_numpy())
            for d in np.unique(sizes).tolist():
                x = _matrix(column.filter(pa.array(sizes == d)))
                total = by.setdefault(d, [0, [0] * d])
                safe = int(np.abs(x).max()) * len(x) <= _LONG
                part = x.sum(axis=0).tolist() if safe else x.astype(object).sum(axis=0).tolist()
                total[0] += len(x)
                total[1] = [a + b for a, b in zip(total[1], part)]
        rows = [(d, k, n, str(s)) for d, (n, sums) in by.items() for k, s in enumerate(sums)]
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names=["d", "k", "n", "s"])

    parts = fit.select("x").mapInArrow(add, "d int, k int, n long, s string")
    total = parts.groupBy("d", "k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    most = total.where("k = 0").select("d", "n").orderBy(F.desc("n"), F.desc("d")).limit(1)
    found = total.join(most.select("d"), "d").orderBy("k").collect()
    return (found[0].n, tuple(int(r.s) for r in found)) if found else (0, ())


def _factor(fit: DataFrame, n: int, sums: tuple[int, ...], scratch: Scratch) -> np.ndarray:
    """The triangular factor of all centred vectors: one for each task, merged FAN at a time."""
    d = len(sums)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, block, held = np.zeros((0, d)), [], 0
        for batch in batches:
            block.append(centred(_matrix(batch.column(0)), n, sums))
            held += batch.num_rows
            if held >= BLOCK * d:
                factor, block, held = _fold(np.concatenate(block), factor), [], 0
        if held:
            factor = _fold(np.concatenate(block), factor)
        if len(factor):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([factor.tobytes()], pa.binary())], names=["part", "r"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        factors = [np.frombuffer(r, np.float64).reshape(-1, d) for r in rows.sort_values("part").r]
        return pd.DataFrame({"part": [rows.part.min() // FAN], "r": [np.linalg.qr(np.concatenate(factors), mode="r").tobytes()]})

    factors = scratch.keep(fit.select("x").mapInArrow(local, "part long, r binary"), "factors")
    last = factors.agg(F.max("part")).first()[0] or 0
    while last > 0:
        factors = factors.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(merge, "part long, r binary")
        last //= FAN
    (only,) = factors.collect()
    scratch.drop("factors")
    return np.frombuffer(only.r, np.float64).reshape(-1, d)


def fit_list(rows: DataFrame, scratch: Scratch, vector: str = "embedding") -> DataFrame:
    """Each distinct x once, written."""
    return scratch.keep(on_grid(rows, vector).groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit")


def fitted(fit: DataFrame, scratch: Scratch, most: int | None = None) -> Model | None:
    """The components of a fit list, at most ``most``; None if there are none."""
    n, sums = _sums(fit)
    if not n:
        return None
    r = _factor(fit.where(F.size("x") == len(sums)), n, sums, scratch)
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    real = int((s > s[0] * max(n, len(sums)) * np.finfo(float).eps).sum()) if s[0] > 0 else 0
    if not real:
        return None
    k = min(real, most or real)
    axes = vt[:k].T * np.sign(vt[:k][np.arange(k), np.abs(vt[:k]).argmax(axis=1)])
    return Model(n, sums, s[:k] ** 2 / n, axes, float((s**2).sum() / n))


def identity_error(fit: DataFrame, model: Model) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k, weights = model.axes.shape[1], model.projection

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = centred(_matrix(batch.column(0)), model.n, model.sums) @ weights
            first += w.sum(axis=0)
            second += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([first, second.ravel()])], pa.list_(pa.float64()))], names=["m"])

    parts = fit.where(F.size("x") == len(model.sums)).select("x").mapInArrow(add, "m array<double>").select(F.posexplode("m").alias("at", "v"))
    got = np.array([r.v for r in parts.groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()])
    mean = got[:k] / model.n
    return float(np.abs(got[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, identifier: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining row and component: the id, n, the exact deviation, the whitened value and the component's share."""
    spark = rows.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "whitening")
    kind = rows.select(F.col(f"`{identifier}`")).schema[0].dataType.simpleString()
    schema = f"`{identifier}` {kind}, {RESULT}"
    fit = fit_list(rows, scratch, vector)
    model = fitted(fit, scratch, components)
    if model is None:
        scratch.drop("fit")
        return spark.createDataFrame([], schema)
    error = identity_error(fit, model)
    scratch.drop("fit")
    k, weights, d = model.axes.shape[1], model.projection, len(model.sums)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            x = _matrix(batch.column(1)) if m else np.zeros((0, d), np.int64)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array(deviations(x, model.n, model.sums), pa.int64()).take(each),
                 pa.array((centred(x, model.n, model.sums) @ weights).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error))],
                names=[identifier, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return on_grid(rows, vector, (identifier,)).where(F.size("x") == d).mapInArrow(project, schema)
