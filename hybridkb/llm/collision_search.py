"""Approximate nearest neighbours by collision counting.

Each of ``HASHES`` random projections keeps its values sorted. A query opens a window around its own
projection in every array; rehashing to a larger radius only widens the windows, and only what the
widening adds is counted. A vector that has collided often enough is verified by its true distance,
once, when its count crosses the threshold. The threshold is set so that a vector at the radius itself
reaches it with probability ``RECALL_Z`` deviations above one half; the search ends when the radius has
reached the distance of the k-th verified vector, so that what is missed are those failures.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hybridkb.llm.vector_shards import QUERY_STEP, Best, distances, nearest

HASHES, RECALL_Z, WIDTH, GROWTH = 64, 1.0, 1.0, 1.6


def build_index(ids: np.ndarray, vectors: np.ndarray, hashes: int = HASHES, seed: int = 7) -> dict[str, np.ndarray]:
    """Sorted values of every projection, and the vectors in that order."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    lines = np.random.default_rng(seed).standard_normal((hashes, vectors.shape[1]))
    middle = vectors.mean(0) if len(ids) else np.zeros(vectors.shape[1])  # projections far from the origin would lose digits
    values = lines @ (vectors - middle).T
    by = np.argsort(values, axis=1, kind="stable").astype(np.int32)
    step = np.sqrt(((vectors[:1000] - middle) ** 2).sum(1)).mean() if len(ids) else 0.0
    return {"ids": ids, "vectors": vectors.astype(np.float64), "lines": lines, "middle": middle, "values": np.take_along_axis(values, by.astype(np.int64), axis=1), "by": by, "start": np.array([max(step / 8, 1e-12)])}


def threshold(hashes: int, width: float = WIDTH, z: float = RECALL_Z) -> int:
    """Collisions that a vector at the radius reaches but with a failure of normal deviate z."""
    p = math.erf(width / math.sqrt(2))
    return max(1, math.floor(hashes * p - z * math.sqrt(hashes * p * (1 - p))))


def widen(by: np.ndarray, counts: np.ndarray, old: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """``counts`` of collisions after the windows of all arrays have grown from ``old`` to ``new`` ends."""
    left = [row[a:b] for row, a, b in zip(by, new[0], old[0]) if a < b]
    right = [row[a:b] for row, a, b in zip(by, old[1], new[1]) if a < b]
    return counts + np.bincount(np.concatenate(left + right), minlength=len(counts)).astype(counts.dtype) if left or right else counts


def search_index(index: dict[str, np.ndarray], queries: np.ndarray, x: np.ndarray, k: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, id, distance) of about the k nearest of each query within its bound."""
    ids, vectors, values, by = index["ids"], index["vectors"], index["values"], index["by"]
    best = Best(queries, k, bounds)
    n, m = len(ids), len(values)
    if not n or k < 1 or not len(queries):
        return best.result()
    at, need = (x - index["middle"]) @ index["lines"].T, threshold(m)
    radius = np.where(np.isfinite(bounds), bounds, float(index["start"][0]))
    left = np.stack([np.searchsorted(values[j], at[:, j]) for j in range(m)], axis=1)
    right = left.copy()
    counts = np.zeros((len(queries), n), np.uint8 if m < 256 else np.uint16)
    rows = np.arange(len(queries))
    while len(rows):
        wider = [np.stack([np.searchsorted(values[j], at[rows, j] + sign * WIDTH * radius[rows], side) for j in range(m)], axis=1) for sign, side in ((-1, "left"), (1, "right"))]
        for i, r in enumerate(rows.tolist()):
            grown = widen(by, counts[r], (left[r], right[r]), (wider[0][i], wider[1][i]))
            new = np.flatnonzero((grown >= need) & (counts[r] < need))
            counts[r] = grown
            if len(new):
                best.offer(r, distances(x[r], vectors[new]), ids[new])
        left[rows], right[rows] = wider
        kth = best.near[rows, -1]
        done = (kth <= radius[rows]) | (np.isfinite(bounds[rows]) & (radius[rows] >= bounds[rows])) | ((right[rows] - left[rows]).min(axis=1) == n)
        further = radius[rows] * GROWTH
        radius[rows] = np.where(np.isfinite(kth), np.minimum(further, np.maximum(kth, radius[rows] * 1.0000001)), further)
        rows = rows[~done]
    return best.result()


def approximate_neighbours(vectors: DataFrame, k: int = 10, query_step: int = QUERY_STEP, **params) -> DataFrame:
    """(vec_id, neighbour_id, rank, distance): about the k nearest others, among all vectors, of every
    vector whose id is divisible by ``query_step``.

    Distances are true ones. The rules on rows, ties and repeated ids are those of the exact search;
    with fewer than k others nearly all are given. An empty table gives no rows; further columns are ignored.
    """
    hits = nearest(vectors, build_index, search_index, k, query_step, **params)
    return hits.select(F.col("query").alias("vec_id"), F.col("neighbour").alias("neighbour_id"), F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))
