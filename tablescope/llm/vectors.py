"""What both vector operators share: which vectors take part, and exact cosines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Products held at once: 32 MB of doubles.
PRODUCTS = 1 << 22


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite, not all zero; squares must neither vanish nor overflow in doubles."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(1e150))

    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: F.abs(x) > F.lit(1e-150)), F.lit(False))


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal rows give equal results wherever they stand."""
    return (x * y).sum(axis=1) / (norms(x) * norms(y))


def sample(vectors: DataFrame, key: str, column: str, rows: int) -> np.ndarray:
    """At most `rows` vectors, those whose keys hash lowest, as unit vectors."""
    picked = vectors.orderBy(F.xxhash64(key)).select(F.col(column).cast("array<double>").alias("v")).limit(rows).toArrow()
    if not picked.num_rows:
        return np.zeros((0, 0))
    x = np.array(picked.column("v").to_pylist())
    return x / norms(x)[:, None]


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm; an empty cell keeps its centre."""
    random = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centres = x[random.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        cell = nearest(x, centres)
        counts = np.bincount(cell, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Row by row the nearest centre, for so many rows at once that their products with all centres stay small."""
    half = 0.5 * (centres * centres).sum(1)
    step = max(1, PRODUCTS // max(1, len(centres)))
    found = [(x[i : i + step] @ centres.T - half).argmax(1) for i in range(0, len(x), step)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)
