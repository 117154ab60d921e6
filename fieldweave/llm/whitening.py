"""Whitening of vectors by hierarchical merging of singular value decompositions.

1. Each partition goes through its rows in batches. A batch is centred by its own mean and decomposed;
   what is kept of it is its number of rows, the sums of its dimensions, and all singular values with
   their right vectors (a matrix of at most d rows, whatever the number of vectors).
2. Two summaries merge without loss: the rows of both, scaled by their singular values, and one more
   row that holds the difference of the two means, times sqrt(n1 n2 / (n1 + n2)), are decomposed again.
   Summaries of partitions merge in rounds of ``FAN``, each round a grouped stage.
3. The last summary, d x d numbers, gives eigenvectors and eigenvalues of the covariance. Every row is
   then projected where it lies.

Sums of whole numbers are kept as whole numbers, so means far from zero cost no precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldweave.shared import settle

#: Summaries that merge into one; rows that are decomposed at once.
FAN, BATCH = 16, 2_048
#: A component whose eigenvalue is no larger than this share of the first has no variance to scale.
FLAT = 1e-12

SUMMARY = "part long, n long, whole boolean, sums binary, rows binary"


@dataclass(frozen=True)
class Summary:
    """n vectors: the sums of their dimensions, and ``rows``, whose Gram matrix is their scatter."""

    n: int
    sums: np.ndarray
    rows: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n

    def covariance(self) -> np.ndarray:
        return self.rows.T @ self.rows / self.n

    def components(self) -> tuple[np.ndarray, np.ndarray]:
        """Eigenvalues of the covariance, falling, and their unit vectors (rows), as many as dimensions.

        The entry of largest size in each vector is positive.
        """
        s, v = np.linalg.svd(self.rows, full_matrices=True)[1:]
        e = np.zeros(len(v))
        e[: len(s)] = s * s / self.n
        sign = np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])
        return e, v * sign[:, None]


def _decomposed(m: np.ndarray) -> np.ndarray:
    """Singular values times right vectors: as many rows as dimensions at most, and the same Gram matrix."""
    s, v = np.linalg.svd(m, full_matrices=False)[1:]
    return s[:, None] * v


def summary_of(m: np.ndarray) -> Summary:
    sums = m.sum(axis=0)
    return Summary(len(m), sums, _decomposed(m - sums / len(m)))


def merged(a: Summary, b: Summary) -> Summary:
    correction = np.sqrt(a.n / (a.n + b.n) * b.n) * (a.mean - b.mean)
    return Summary(a.n + b.n, a.sums + b.sums, _decomposed(np.concatenate((a.rows, b.rows, correction[None, :]))))


def _packed(part: int, s: Summary) -> dict:
    return {"part": part, "n": s.n, "whole": s.sums.dtype == np.int64, "sums": s.sums.tobytes(), "rows": s.rows.tobytes()}


def _unpacked(n: int, whole: bool, sums: bytes, rows: bytes) -> Summary:
    sums = np.frombuffer(sums, dtype=np.int64 if whole else np.float64)
    return Summary(int(n), sums, np.frombuffer(rows, dtype=np.float64).reshape(-1, len(sums)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def finite(vector: Column) -> Column:
    """Not null, not empty, and no component null or non-finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """``vectors`` without rows that cannot take part: a vector that is null or empty, holds null or
    non-finite components, or is not of the commonest length (the least of equals)."""
    clean = vectors.filter(finite(F.col(vector)))
    common = clean.groupBy(F.size(vector).alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    return clean.filter(F.size(vector) == (common["n"] if common else 0))


def fit(vectors: DataFrame, vector: str) -> Summary | None:
    """The summary of all rows, best of a written table; None if there are none.

    vector: an array of numbers, all of one length and finite (``usable``). Arrays of whole numbers
    are summed as such. Null vectors take no part; repeated rows count each.
    """
    whole = isinstance(vectors.schema[vector].dataType.elementType, T.IntegralType)
    kind = np.int64 if whole else np.float64

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                own = summary_of(_matrix(batch.column(0).slice(at, BATCH)).astype(kind))
                found = own if found is None else merged(found, own)
        if found is not None:
            yield pa.RecordBatch.from_pylist([_packed(TaskContext.get().partitionId(), found)])

    def of_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        each = [_unpacked(*x) for x in rows[["n", "whole", "sums", "rows"]].itertuples(index=False)]
        found = each[0]
        for other in each[1:]:
            found = merged(found, other)
        return pd.DataFrame([_packed(int(rows["part"].iloc[0]) // FAN, found)])

    v = F.col(vector).cast("array<bigint>" if whole else "array<double>").alias("v")
    parts = settle(vectors.filter(F.col(vector).isNotNull()).select(v).mapInArrow(of_partition, SUMMARY))
    while (last := parts.agg(F.max("part")).first()[0]) is not None and last > 0:
        parts = settle(parts.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInPandas(of_group, SUMMARY))
    row = parts.first()
    return None if row is None else _unpacked(row["n"], row["whole"], bytes(row["sums"]), bytes(row["rows"]))


def whiten(vectors: DataFrame, vector: str, summary: Summary, k: int, name: str = "whitened") -> DataFrame:
    """``vectors`` with ``name``: each vector less the mean, on the first k components, over the square root of their eigenvalues.

    Components without variance are left out, so there may be fewer. A null vector gives null. The
    column replaces one of the same name; others pass through. No shuffle.
    """
    e, v = summary.components()
    k = min(k, int((e > FLAT * e[0]).sum())) if len(e) and e[0] > 0 else 0
    mean, onto = summary.mean, (v[:k] / np.sqrt(e[:k])[:, None]).T

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            own = s.notna().to_numpy()
            out = pd.Series([None] * len(s), dtype=object)
            if own.any():
                # term by term, so that a row's result does not depend on the rows of its batch
                m = np.array(s[own].tolist(), dtype=np.float64) - mean
                made = np.zeros((len(m), k))
                for d in range(m.shape[1]):
                    made += m[:, d : d + 1] * onto[d]
                out[own] = pd.Series(list(made), index=out.index[own])
            yield out

    return vectors.withColumn(name, project(F.col(vector)))


def identity_error(summary: Summary) -> float:
    """How far the covariance is from the identity, at its worst entry."""
    cov = summary.covariance()
    return float(np.abs(cov - np.eye(len(cov))).max())
