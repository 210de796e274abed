"""Min-max scaling and projection to principal components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scaler:
    """(x - min) / (max - min); a constant column becomes x - min."""

    columns: list[str]
    low: list[float]
    high: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        at = {c: (F.col(c) - lo) / (hi - lo if hi != lo else 1.0) for c, lo, hi in zip(self.columns, self.low, self.high, strict=True)}
        return df.withColumns(at)


def fit_scaler(df: DataFrame, columns: list[str]) -> Scaler:
    row = df.agg(*(F.min(c).alias(f"lo_{c}") for c in columns), *(F.max(c).alias(f"hi_{c}") for c in columns)).first()
    value = lambda x: 0.0 if x is None else float(x)
    return Scaler(columns, [value(row[f"lo_{c}"]) for c in columns], [value(row[f"hi_{c}"]) for c in columns])


@dataclass(frozen=True)
class Pca:
    columns: list[str]
    mean: np.ndarray
    loadings: np.ndarray  # columns x components

    def transform(self, df: DataFrame, keep: list[str], names: tuple[str, ...] = ("x", "y")) -> DataFrame:
        out = []
        for j, name in enumerate(names):
            terms = (f"(`{c}` - ({float(m)!r}D)) * ({float(w)!r}D)" for c, m, w in zip(self.columns, self.mean, self.loadings[:, j], strict=True))
            out.append(F.expr(" + ".join(terms)).alias(name))
        return df.select(*keep, *out)


def _moments(df: DataFrame, columns: list[str], mean: np.ndarray) -> np.ndarray:
    """[3, d, d] over the rows where both columns i and j have a value: their number, the sums of i - mean, those of the products."""
    d = len(columns)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, d, d))
        for batch in batches:
            x = np.column_stack([np.asarray(c.cast(pa.float64()).to_numpy(zero_copy_only=False), float) for c in batch.columns]) - mean
            some = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            x[some == 0] = 0.0
            total += np.stack([some.T @ some, x.T @ some, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((np.frombuffer(m).reshape(3, d, d) for batch in batches for m in batch.column(0).to_pylist()), np.zeros((3, d, d)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    rows = df.select(*(F.col(c).cast("double") for c in columns)).mapInArrow(sums, "m binary").repartition(8).mapInArrow(merged, "m binary").collect()  # at most 8 rows
    return sum((np.frombuffer(r.m).reshape(3, d, d) for r in rows), np.zeros((3, d, d)))


def fit_pca(df: DataFrame, columns: list[str], k: int = 2) -> Pca:
    """Components of the centred columns from a pass for the means and one for
    the second moments; each component's loading of the largest size is positive."""
    row = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns))).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(len(columns))])
    n, one, two = _moments(df, columns, mean)
    with np.errstate(all="ignore"):
        cov = np.where(n > 1, (two - one * one.T / n) / (n - 1), 0.0)
    _, vectors = np.linalg.eigh(np.nan_to_num(cov))
    top = vectors[:, ::-1][:, :k]
    signs = np.sign(top[np.abs(top).argmax(0), np.arange(top.shape[1])])
    return Pca(columns, mean, top * np.where(signs == 0, 1, signs))


def pca_2d(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    return fit_pca(df, columns).transform(df, keep)
