"""Connected components: unions within a task, alternating stars across tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hybridkb.session import discard, materialise


class Unions:
    """Union-find over 0..n-1 for arrays of edges; the root is the least member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if (up == r).all():
                return r
            r = self.parent[up]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            if not apart.any():
                return
            a, b = ra[apart], rb[apart]
            self.parent[np.maximum(a, b)] = np.minimum(a, b)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of (a, b) edges, the component being its least node.

    Large-star and small-star rounds until nothing changes: each round hangs a node's neighbours on the
    least of them, so that the number of edges never grows and the diameter shrinks geometrically.
    Every round is written to the shared folder. Edges with a null end and loops are left out.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    now = materialise(now, "components")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        before = state
        both = now.union(now.select("v", "u"))
        large = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u")))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select("v", "m")).distinct()
        now, old = materialise(small, "components"), now
        discard(old)
