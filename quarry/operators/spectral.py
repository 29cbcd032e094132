"""Truncated singular value decomposition of a sparse matrix in long form (row, col, value)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.graphs import cut


def _names(dims: int) -> list[str]:
    return [f"_v{i}" for i in range(dims)]


def _times(entries: DataFrame, by: str, to: str, vectors: DataFrame, dims: int) -> DataFrame:
    """The matrix (or its transpose) times vectors: one sum for each dimension, combined before the shuffle."""
    return entries.join(vectors, by).groupBy(to).agg(*[F.sum(F.col("value") * F.col(v)).alias(v) for v in _names(dims)])


def _gram(vectors: DataFrame, dims: int) -> np.ndarray:
    """Scalar products of the dimensions: one row, dims x dims numbers."""
    v = _names(dims)
    row = vectors.agg(*[F.coalesce(F.sum(F.col(v[i]) * F.col(v[j])), F.lit(0.0)).alias(f"{i}_{j}") for i in range(dims) for j in range(i + 1)]).first()
    out = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i + 1):
            out[i, j] = out[j, i] = row[f"{i}_{j}"]
    return out


def _turned(vectors: DataFrame, key: str, by: np.ndarray) -> DataFrame:
    v = _names(len(by))
    return vectors.select(key, *[sum((F.col(a) * float(by[i, j]) for i, a in enumerate(v)), F.lit(0.0)).alias(b) for j, b in enumerate(v)])


def _orthonormal(vectors: DataFrame, key: str, dims: int) -> tuple[DataFrame, np.ndarray]:
    """Vectors turned to orthonormal principal directions, and the lengths they had, largest first; null directions become 0."""
    values, directions = np.linalg.eigh(_gram(vectors, dims))
    values, directions = np.maximum(values[::-1], 0), directions[:, ::-1]
    scale = np.where(values > 1e-12 * max(values[0], 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    return _turned(vectors, key, directions * scale), np.sqrt(values)


def truncated_svd(entries: DataFrame, dims: int, rounds: int = 8) -> tuple[DataFrame, DataFrame, list[float]]:
    """(row, vector) = U S, (col, vector) = V, and the singular values, by subspace iteration from hashed vectors.

    entries: row, col, value, each place once. A round is two sparse products; the driver sees dims x dims numbers only,
    and each round is cut. Each column of V sums to 0 or more. Of an empty matrix: no rows, zeros.
    """
    entries = cut(entries.select("row", "col", F.col("value").cast("double").alias("value")))
    start = [(F.pmod(F.xxhash64("col", F.lit(i)), F.lit(1 << 30)) / float(1 << 29) - 1).alias(v) for i, v in enumerate(_names(dims))]
    right, values = entries.select("col").distinct().select("col", *start), np.zeros(dims)
    for _ in range(rounds):
        left, _ = _orthonormal(cut(_times(entries, "col", "row", right, dims)), "row", dims)
        right, values = _orthonormal(cut(_times(entries, "row", "col", left, dims)), "col", dims)
        right = cut(right)
    sums = right.agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in _names(dims)]).first()
    right = _turned(right, "col", np.diag([-1.0 if s < 0 else 1.0 for s in sums]))
    left = _times(entries, "col", "row", right, dims)
    packed = lambda df, key: df.select(key, F.array(*_names(dims)).alias("vector"))
    return packed(left, "row"), packed(right, "col"), values.tolist()


def normalized_adjacency(edges: DataFrame) -> DataFrame:
    """row, col, value of D^-1/2 A D^-1/2 for an undirected graph src, dst, weight (each link once)."""
    two = edges.select(F.inline(F.array(F.struct("src", "dst", "weight"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))))
    degree = two.groupBy("src").agg(F.sum("weight").alias("_d"))
    joined = two.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("_d").alias("_e")), "dst")
    return joined.select(F.col("src").alias("row"), F.col("dst").alias("col"), (F.col("weight") / F.sqrt(F.col("_d") * F.col("_e"))).alias("value"))
