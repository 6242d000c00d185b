"""Cosine similarity: column expressions, and the numpy kernel run inside tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 4_000_000  # scores held at once in one task


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays; 0 when one of them is all zero."""
    def dot(x, y):
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
        )

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def similarity(cos: Column) -> Column:
    """Score in [0, 1] with three digits: 1 − distance/2, distance = 1 − cosine."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(1 - (1 - cos) / 2, 3)))


def mean_vectors(df: DataFrame, by: str, vector: str, dims: int) -> DataFrame:
    """Mean vector per group, combined map-side."""
    cells = [F.avg(F.col(vector)[i]) for i in range(dims)]
    return df.groupBy(by).agg(F.array(*cells).alias(vector))


def arrow_matrix(column, dims: int) -> np.ndarray:
    """Arrow list column of lists of ``dims`` numbers as a matrix, without visiting the rows."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != dims).any():
        raise ValueError(f"vectors of {sorted(set(lengths.tolist()))} numbers among those of {dims}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def unit_rows(vectors) -> np.ndarray:
    """Vectors scaled to length 1; zero vectors stay zero."""
    m = vectors if isinstance(vectors, np.ndarray) and vectors.ndim == 2 else np.array([np.asarray(v) for v in vectors])
    m = m.astype(np.float64)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


class TopK:
    """Best ``k`` rows per query over any number of batches; ties go to the smaller id."""

    def __init__(self, queries: np.ndarray, k: int, id_col: str):
        self.queries, self.k, self.id_col = queries, k, id_col
        self.best: pd.DataFrame | None = None
        self.floor = np.full(len(queries), -np.inf)

    def add(self, rows: pd.DataFrame, vectors) -> None:
        step = max(1, CELLS // max(1, len(self.queries)))
        for at in range(0, len(rows), step):
            self._add_chunk(rows.iloc[at:at + step], unit_rows(vectors[at:at + step]))

    def _add_chunk(self, rows: pd.DataFrame, unit: np.ndarray) -> None:
        # 12 digits, so that the last bits of different summation orders do not decide a rank
        scores = np.round(unit @ self.queries.T, 12)
        n = len(scores)
        kth = np.partition(scores, n - self.k, axis=0)[n - self.k] if n > self.k else np.full(scores.shape[1], -np.inf)
        row, query = np.nonzero((scores >= np.maximum(kth, self.floor)) & np.isfinite(scores))
        if not len(row):
            return
        found = rows.iloc[row].copy()
        found["_query"], found["_cos"] = query, scores[row, query]
        merged = found if self.best is None else pd.concat([self.best, found], ignore_index=True)
        merged = merged.sort_values(["_query", "_cos", self.id_col], ascending=[True, False, True])
        self.best = merged.groupby("_query", sort=False).head(self.k).reset_index(drop=True)
        full = self.best.groupby("_query")["_cos"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        self.floor[full.index.to_numpy()] = full["min"].to_numpy()
