"""Embedding whitening: MLlib's RowMatrix over exactly centred rows, a local eigendecomposition, whitening in mapInPandas.

1. Vectors become integers, x = floor(scale * c). Those that are null, or hold a null, NaN or infinite entry, are dropped,
   and so are those of another length than most have (ties: the longer one), as no covariance takes them in.
2. The fit list is each distinct x once: n vectors, with sums S for each dimension as exact integers.
3. A centred entry is (n * x - S) / n: integers up to one division, so no mean is rounded before the products.
   RowMatrix.computeGramianMatrix() over these rows, divided by n, is the covariance V.
4. eigh of V on the driver (dimensions squared, whatever the number of rows); the eigenvectors go to the tasks, which
   project every remaining row. Eigenvalues within rounding of zero have no component, as whitening would divide by them:
   fewer distinct vectors than dimensions give fewer components, and a single distinct vector, or none, gives no rows.

Repeated rows and ids give a row each, as do null ids. Further columns of the table are ignored, whatever their names.
A deviation beyond 64 bits raises an error, as a sum in 64 bits does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, COMPONENTS = 256, 4


@dataclass(frozen=True)
class Whitening:
    """n, S, the unit eigenvectors (columns) with their eigenvalues, V's trace, and how far whitened rows are from unit covariance."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Exact sums of (n * x - S)^2."""
        off = self.n * x - self.sums
        if off.size and float(np.abs(off).max()) ** 2 * off.shape[1] >= 2.0**62:
            off = off.astype(object)
        return np.array((off * off).sum(axis=1), np.int64)


def integer_rows(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, x) of the rows whose vector has finite entries alone and the commonest length."""
    entry = F.col("v").cast("array<double>")
    finite = F.forall(entry, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    x = F.transform(entry, lambda c: F.floor(c * float(scale)).cast("long"))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.select("id", x.alias("x")).where(F.size("x") == (length[0] if length else 0))


def _sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """(n, S) of the fit list: each task sends its own sums."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batch_iter:
            if batch.num_rows:
                own = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1).sum(axis=0)
                n, total = n + batch.num_rows, own if total is None else total + own
        if n:
            values = np.append(total, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["place", "value"])

    found = fit.select("x").mapInArrow(run, "place int, value long").groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()
    values = np.array([r.value for r in found], np.int64)
    return (int(values[-1]), values[:-1]) if len(values) else (0, values)


def _gramian(rows: DataFrame) -> np.ndarray:
    """RowMatrix's Gramian of a column v of arrays of doubles; the rows stay in the JVM."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("v").alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def _array(values: np.ndarray, kind: str) -> Column:
    return F.array(*(F.lit(v.item()) for v in values)).cast(f"array<{kind}>")


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Whitening of (id, x) rows, learned from each distinct x once."""
    distinct = common.materialise(rows.select("x").distinct(), "whitening-fit")
    n, sums = _sums(distinct)
    if not n:
        return Whitening(0, sums, np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    total = _array(sums, "long")
    centred = distinct.select(F.zip_with("x", total, lambda a, s: (a * F.lit(n).cast("long") - s) / F.lit(float(n))).alias("v"))
    covariance = _gramian(centred) / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > len(values) * np.finfo(float).eps * max(values.max(), 0.0)]
    model = Whitening(n, sums, np.ascontiguousarray(vectors[:, order]), values[order], float(np.trace(covariance)), 0.0)
    if not len(order):
        return model

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            if batch.num_rows:
                white = model.whitened(batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(white.reshape(-1)), white.shape[1]).cast(pa.list_(pa.float64()))], names=["v"])

    unit = _gramian(distinct.mapInArrow(run, "v array<double>")) / n
    return Whitening(n, sums, model.vectors, model.values, model.trace, float(np.abs(unit - np.eye(len(order))).max()))


def whiten(table: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each remaining row and component."""
    rows = integer_rows(table, id_col, vector_col, scale)
    model = fit(rows, components)
    kind = rows.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(model.values)
        for frame in frames:
            if len(frame) and k:
                x = np.stack(frame["x"].to_numpy())
                at = np.repeat(np.arange(len(frame)), k)
                yield pd.DataFrame({
                    "id": frame["id"].take(at), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(frame)), "n": model.n, "deviation": model.deviations(x)[at], "whitened": model.whitened(x).reshape(-1),
                    "explained": np.tile(model.values / model.trace, len(frame)), "identity_error": model.identity_error,
                })

    return rows.mapInPandas(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
