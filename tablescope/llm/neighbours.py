"""Nearest neighbours by stable projections of few dimensions in a kd-tree.

A Gaussian projection is stable: the squared length of a projected difference is the squared length of the difference times a
chi-square variable of as many degrees of freedom as there are projections. Each task holds one block of the vectors in a
kd-tree over their projections. For a query it walks the leaves by increasing projected distance and verifies what lies in them by exact
cosine, until no unseen vector is likely to be nearer than the k-th found: the chi-square test at `confidence`.

The queries are a stated set, each compared with all blocks; blocks of queries and of vectors meet in one task each, and
a window over the k best of each block gives the result. Distances are between unit vectors, so they rank as cosines do.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope.llm.vectors import norms, stacked, usable


def chi_square(x: float, freedom: int) -> float:
    """P(chi-square of an even number of degrees of freedom <= x)."""
    if x > 1400:
        return 1.0
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, freedom // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


def quantile(share: float, freedom: int) -> float:
    low, high = 0.0, 1400.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, freedom) < share else (low, mid)
    return high


class KdTree:
    """Leaves of a tree that halves the widest dimension: the rows of each, and its box."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        todo, self.rows = [np.arange(len(points))], []
        while todo:
            rows = todo.pop()
            if len(rows) <= leaf:
                self.rows.append(rows)
                continue
            own = points[rows]
            by = np.argsort(own[:, np.argmax(own.max(0) - own.min(0))], kind="stable")
            half = len(rows) // 2
            todo += [rows[by[:half]], rows[by[half:]]]
        self.low = np.array([points[r].min(0) for r in self.rows])
        self.high = np.array([points[r].max(0) for r in self.rows])

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distance to each leaf's box."""
        off = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (off * off).sum(1)


def search_block(
    ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, projections: np.ndarray, confidence: float, leaf: int, step: int
) -> list[tuple[int, int, float]]:
    """(query id, id, cosine) of each query's k best in the block."""
    size, unit = norms(x), x / norms(x)[:, None]
    tree = KdTree(unit @ projections, leaf)
    limit = quantile(confidence, projections.shape[1])
    out = []
    q_size = norms(q)
    projected = (q / q_size[:, None]) @ projections
    for number, (query_id, vector, length, point) in enumerate(zip(query_ids.tolist(), q, q_size, projected)):
        away = tree.distances(point)
        order = np.argsort(away, kind="stable")
        best_ids, best = np.zeros(0, np.int64), np.zeros(0)
        for start in range(0, len(order), step):
            some = order[start : start + step]
            # the k-th best so far as a squared distance; unseen vectors lie at least as far out as the next leaf
            if len(best) == k and away[some[0]] > limit * max(2 - 2 * best[-1], 0) + 1e-9:
                break
            rows = np.concatenate([tree.rows[i] for i in some])
            rows = rows[ids[rows] != query_id]
            cosine = (x[rows] * vector).sum(1) / (size[rows] * length)
            names, scores = np.append(best_ids, ids[rows]), np.append(best, cosine)
            top = np.lexsort((names, -scores))[:k]
            best_ids, best = names[top], scores[top]
        out += [(query_id, i, s) for i, s in zip(best_ids.tolist(), best.tolist())]
    return out


def nearest_neighbours(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    dimensions: int = 8,
    confidence: float = 0.995,
    block: int = 8192,
    queries: int = 1024,
    leaf: int = 64,
    step: int = 8,
) -> DataFrame:
    """vec_id, embedding -> query_id, rank (from 1), vec_id, score: the k nearest of each query, by cosine.

    Vectors that are null, empty, zero or not finite, and rows without vec_id, take no part. Only vectors of equal length
    are compared. Rows that share a vec_id are one candidate if their vectors are equal; a query's own id is never found.
    Ties go to the smaller vec_id. Fewer candidates than k are all returned.
    """
    if dimensions % 2:
        raise ValueError("an even number of projections is wanted")
    own = rows.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    own = own.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("_q"))
    own = own.dropDuplicates(["vec_id", "vector"]).withColumn("length", F.size("vector"))
    counted = own.agg(F.count("*"), F.count_if("_q")).first()
    n_blocks, n_queries = max(1, -(-counted[0] // block)), max(1, -(-counted[1] // queries))
    at = F.xxhash64("vec_id")
    index = own.select(
        "length", F.pmod(at, F.lit(n_blocks)).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_queries - 1).cast("long"))).alias("j"),
        F.lit(False).alias("asking"), "vec_id", "vector",
    )
    asked = own.filter("_q").select(
        "length", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("i"), F.pmod(at, F.lit(n_queries)).alias("j"),
        F.lit(True).alias("asking"), "vec_id", "vector",
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asking = pdf["asking"].to_numpy(bool)
        inside, outside = pdf[~asking].sort_values("vec_id"), pdf[asking].sort_values("vec_id")
        found = []
        if len(inside) and len(outside):
            x, q = stacked(inside["vector"]), stacked(outside["vector"])
            projections = np.random.default_rng(7).standard_normal((x.shape[1], dimensions))
            found = search_block(inside["vec_id"].to_numpy(), x, outside["vec_id"].to_numpy(), q, k, projections, confidence, leaf, step)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    best = index.unionByName(asked).groupBy("length", "i", "j").applyInPandas(run, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
