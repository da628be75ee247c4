"""Exact k-nearest search by an M-tree.

Nodes are pages. An entry of an inner page has a routing object, a covering radius and the distance to its
page's own routing object; an entry of a leaf has that distance alone. Search is best first by the least
distance that a page can hold. Where the stored distance to the parent shows by the triangle inequality
that an entry lies beyond a query's bound, that pair's distance is not computed.

Distances are taken from differences, so that they are as exact far from the origin as near it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hybridkb.llm.vector_shards import QUERY_STEP, SLACK, Best, distances, nearest

PAGE, FANOUT = 128, 24
#: Pairs whose differences are held at once.
PAIRS = 50_000


def build_tree(ids: np.ndarray, vectors: np.ndarray, page: int = PAGE, fanout: int = FANOUT) -> dict[str, np.ndarray]:
    """Bulk load from the top: a page's objects are shared out among routing objects, those again while
    they don't fit a page.

    Arrays: pages ``first``/``last``/``leaf`` into entries ``obj`` (row of ``vectors``), ``radius``, ``parent``
    (distance to the page's routing object), ``child`` (page, -1 in leaves).
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], np.ascontiguousarray(vectors[order], np.float64)
    rng = np.random.default_rng(len(ids))
    pages: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def split(rows: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(routing object, rows, distances to it) of each part."""
        ways = min(fanout, max(2, -(-len(rows) // page)))
        chosen = [int(rows[0])]
        least = distances(vectors[chosen[0]], vectors[rows])
        sample = rng.permutation(len(rows))[: 40 * ways]
        while len(chosen) < ways:  # among a sample, likelier the farther from those chosen so far
            odds = np.cumsum(least[sample] ** 2)
            if not odds[-1]:
                break
            far = sample[int(np.searchsorted(odds, rng.random() * odds[-1], "right"))]
            chosen.append(int(rows[far]))
            least = np.minimum(least, distances(vectors[chosen[-1]], vectors[rows]))
        if len(chosen) == 1:  # all the same: halves
            half = len(rows) // 2
            return [(int(r[0]), r, np.zeros(len(r))) for r in (rows[:half], rows[half:])]
        all_d = np.stack([distances(vectors[c], vectors[rows]) for c in chosen])
        own = all_d.argmin(axis=0)
        return [(c, rows[own == j], all_d[j][own == j]) for j, c in enumerate(chosen) if (own == j).any()]

    def make(rows: np.ndarray, off: np.ndarray, centre: int) -> int:
        """The page of ``rows``, which lie ``off`` from its routing object ``centre``."""
        at = len(pages)
        pages.append(())
        if len(rows) <= page:
            by = np.argsort(off, kind="stable")
            pages[at] = (rows[by], np.zeros(len(rows)), off[by], np.full(len(rows), -1))
            return at
        parts = split(rows)
        obj = np.array([c for c, _, _ in parts])
        child = np.array([make(r, d, c) for c, r, d in parts])
        pages[at] = (obj, np.array([d.max() for _, _, d in parts]), distances(vectors[centre], vectors[obj]), child)
        return at

    if len(ids):
        make(np.arange(len(ids)), distances(vectors[0], vectors), 0)
    sizes = [len(p[0]) for p in pages]
    last = np.cumsum(sizes).astype(np.int64) if pages else np.empty(0, np.int64)
    flat = [np.concatenate([p[j] for p in pages]) if pages else np.empty(0) for j in range(4)]
    # objects of leaves in page order, so that a leaf's vectors lie side by side
    obj, child = flat[0].astype(np.int64), flat[3].astype(np.int64)
    place = obj[child < 0]
    where = np.empty(len(ids), np.int64)
    where[place] = np.arange(len(place))
    ids, vectors, obj = ids[place], np.ascontiguousarray(vectors[place]), where[obj]
    return {"ids": ids, "vectors": vectors, "first": last - np.array(sizes, np.int64), "last": last, "obj": obj, "radius": flat[1], "parent": flat[2], "child": child, "root": where[:1]}


def search_tree(tree: dict[str, np.ndarray], queries: np.ndarray, x: np.ndarray, k: int, bounds: np.ndarray, count: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, id, distance) of the k nearest of each query within its bound, without its own
    id; ties by id. Every query goes best first through its own pages; queries whose next page is
    the same are taken together. ``count`` gets the number of distances computed."""
    ids, vectors, obj, radius, parent, child = (tree[n] for n in ("ids", "vectors", "obj", "radius", "parent", "child"))
    best = Best(queries, k, bounds)
    if not len(ids) or k < 1 or not len(queries):
        return best.result()
    x = np.ascontiguousarray(x, np.float64)
    pages = len(tree["first"])
    least = np.full((len(x), pages), np.inf)  # what a page not yet read can hold at the nearest
    centre = np.zeros((len(x), pages))  # distance to the page's routing object
    least[:, 0], centre[:, 0] = 0.0, distances(vectors[int(tree["root"][0])], x)
    if count is not None:
        count.append(len(x))

    def reached(low: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether a lower bound from distances of ``size`` leaves room within the query's limit."""
        return low <= best.limit[q] + SLACK * (size + np.where(np.isfinite(best.limit[q]), best.limit[q], 0.0))

    rows = np.arange(len(x))
    while len(rows):
        at = least[rows].argmin(axis=1)
        next_ = least[rows, at]
        on = np.isfinite(next_)
        on[on] = reached(next_[on], rows[on], centre[rows[on], at[on]])
        rows, at = rows[on], at[on]
        least[rows, at] = np.inf
        for page in np.unique(at).tolist():
            q = rows[at == page]
            a, b = int(tree["first"][page]), int(tree["last"][page])
            off = centre[q, page]
            low = np.abs(off[:, None] - parent[None, a:b]) - radius[None, a:b]
            i, j = np.nonzero(low <= (best.limit[q] + SLACK * (off + np.where(np.isfinite(best.limit[q]), best.limit[q], 0.0)))[:, None])
            if not len(i):
                continue
            if count is not None:
                count.append(len(i))
            d = np.empty(len(i))
            for z in range(0, len(i), PAIRS):
                gap = vectors[obj[a + j[z : z + PAIRS]]] - x[q[i[z : z + PAIRS]]]
                d[z : z + PAIRS] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            if child[a] < 0:
                near = d <= best.limit[q[i]]
                i, j, d = i[near], j[near], d[near]
                cuts = np.flatnonzero(np.append(True, i[1:] != i[:-1])).tolist() + [len(i)] if len(i) else []
                for s, e in zip(cuts, cuts[1:]):
                    best.offer(int(q[i[s]]), d[s:e], ids[obj[a + j[s:e]]])
            else:
                row, kid = q[i], child[a + j]
                floor = np.maximum(0.0, d - radius[a + j])
                least[row, kid] = np.where(reached(floor, row, d), floor, np.inf)
                centre[row, kid] = d
    return best.result()


def nearest_neighbours(vectors: DataFrame, k: int = 10, query_step: int = QUERY_STEP, **params) -> DataFrame:
    """(vec_id, neighbour_id, rank, distance): the k nearest others, among all vectors, of every vector
    whose id is divisible by ``query_step``, exactly.

    Euclidean distance, ties by the lesser id. Rows without an id or with null, empty or
    non-finite embeddings, or of a length other than the commonest, are neither queries nor neighbours;
    of rows that repeat an id the least embedding counts. With fewer than k others all are given.
    An empty table gives no rows; further columns are ignored.
    """
    hits = nearest(vectors, build_tree, search_tree, k, query_step, **params)
    return hits.select(F.col("query").alias("vec_id"), F.col("neighbour").alias("neighbour_id"), F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


def oracle(k: int = 10, query_step: int = QUERY_STEP) -> str:
    return f"""
WITH raw AS (SELECT vec_id::BIGINT AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
sound AS (SELECT id, v FROM raw WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
common AS (SELECT len(v) AS n FROM sound GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1),
points AS (SELECT id, min(v) AS v FROM sound, common WHERE len(v) = n GROUP BY id),
pairs AS (SELECT a.id AS vec_id, b.id AS neighbour_id, list_distance(a.v, b.v) AS d FROM points a JOIN points b ON a.id <> b.id WHERE a.id % {query_step} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour_id) AS rank FROM pairs)
SELECT vec_id, neighbour_id, rank::BIGINT AS rank, round(d, 6) AS distance FROM ranked WHERE rank <= {k}"""
