"""Sharded nearest-neighbour search: routing that loses nothing, whatever index a shard has.

Every vector belongs to the cell of its nearest pivot, and a cell is cut into rings by the distance to
that pivot, ``SHARD_ROWS`` vectors or so each, however unequal the cells are. Each ring's index is written
once as a file in the shared folder. A query searches its own ring first, whose k-th distance then
bounds the others: by the triangle inequality a ring from lo to hi about a pivot at distance d can hold
something within the bound only if lo <= d + bound and hi >= d - bound.

Scale: the pivots are at most ``MAX_CELLS``, whatever the input, and alone are broadcast; rings are rows
of a table that is joined by cell. Queries travel to the rings that they must see, in blocks, and a
task opens one index at a time.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hybridkb.session import discard, materialise, pick, scratch

SHARD_ROWS, QUERY_BLOCK, MAX_CELLS = 16_384, 512, 256
#: Every how manieth id is a query.
QUERY_STEP = 50
#: Relative slack of bounds: far more than the rounding of distances that are computed from differences.
SLACK = 1e-9
HITS = "query long, neighbour long, distance double"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): one vector for an id, the least of several; without null ids, null or non-finite
    members, or lengths other than the commonest (of equals the larger)."""
    v = F.col(vec_col).cast("array<double>")
    rows = pick(vectors, id_col, vec_col).select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).where("id IS NOT NULL AND size(vec) > 0")
    rows = rows.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1)
    common = [r.n for r in lengths.collect()]
    return rows.where(F.size("vec") == (common[0] if common else 0)).groupBy("id").agg(F.min("vec").alias("vec"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of one vector to many, by differences."""
    d = b - a
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def _read(path: str) -> dict[str, np.ndarray]:
    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_file(at) as f:
        return dict(np.load(io.BytesIO(f.read())))


def nearest(vectors: DataFrame, build: Callable, search: Callable, k: int, query_step: int = QUERY_STEP, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, seed: int = 11) -> DataFrame:
    """(query, neighbour, distance, rank) of the k nearest others, among all vectors, of every vector whose id
    is divisible by ``query_step``.

    ``build(ids, vectors)`` gives a shard's index as arrays; ``search(index, query ids, vectors, k, bounds)`` gives
    (query's row, id, distance) of those within a query's bound, at most k a query, of ties the lesser ids.
    """
    spark = vectors.sparkSession
    points = materialise(usable(vectors, id_col, vec_col), "vectors")
    n = points.count()
    shards = max(1, math.ceil(n / shard_rows))
    pivots = [r.vec for r in points.orderBy(F.xxhash64(F.lit(seed), "id"), "id").select("vec").limit(min(MAX_CELLS, shards)).collect()]
    shared_pivots = spark.sparkContext.broadcast(np.array(pivots, dtype=np.float64))
    root = scratch(spark, "vector-index")
    system, path = fs.FileSystem.from_uri(root)
    system.create_dir(path, recursive=True)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, p = matrix(b.column(1)), shared_pivots.value
            if len(v):
                best, where = np.full(len(v), np.inf), np.zeros(len(v), np.int32)
                for j in range(len(p)):
                    d = distances(p[j], v)
                    near = d < best
                    best[near], where[near] = d[near], j
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(best), b.column(0), b.column(1)], names=["cell", "off", "id", "vec"])

    placed = materialise(points.mapInArrow(assign, "cell int, off double, id long, vec array<double>"), "placed")
    discard(points)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(cell, held):
            name = f"{root}/{uuid.uuid4().hex}.npz"
            system, at = fs.FileSystem.from_uri(name)
            blob = io.BytesIO()
            np.savez(blob, **build(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])))
            with system.open_output_stream(at) as f:
                f.write(blob.getvalue())
            lo, hi = min(float(h[2].min()) for h in held), max(float(h[2].max()) for h in held)
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([name]), pa.array([lo]), pa.array([hi])], names=["cell", "path", "lo", "hi"])

        now, held = None, []
        for b in batches:
            cells, ids, v, off = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2)), b.column(3).to_numpy()
            for x in np.unique(cells).tolist():
                here = np.flatnonzero(cells == x)
                for a in range(0, len(here), shard_rows):
                    part = here[a : a + shard_rows]
                    if held and (x != now or sum(len(h[0]) for h in held) >= shard_rows):
                        yield close(now, held)
                        held = []
                    now = x
                    held.append((ids[part], v[part], off[part]))
        if held:
            yield close(now, held)

    rings = placed.select("cell", "id", "vec", "off").repartitionByRange(shards, "cell", "off", "id").sortWithinPartitions("cell", "off", "id")
    index = materialise(rings.mapInArrow(store, "cell int, path string, lo double, hi double"), "shard-index")
    extent = {r.cell: (r.lo, r.hi) for r in index.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}  # a row for each cell
    reach = spark.sparkContext.broadcast(extent)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index = None, None
        for b in batches:
            paths, q, v, bound = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy(), matrix(b.column(2)), b.column(3).to_numpy()
            cuts = np.flatnonzero(np.append(True, paths[1:] != paths[:-1])).tolist() + [len(paths)] if len(paths) else []
            for x, y in zip(cuts, cuts[1:]):
                if paths[x] != now:
                    now, index = paths[x], _read(paths[x])
                for z in range(x, y, QUERY_BLOCK):
                    e = min(y, z + QUERY_BLOCK)
                    rows, names, d = search(index, q[z:e], v[z:e], k, bound[z:e])
                    yield pa.RecordBatch.from_arrays([pa.array(q[z:e][rows]), pa.array(names), pa.array(d)], names=["query", "neighbour", "distance"])

    def search_rows(rows: DataFrame) -> DataFrame:
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        blocks = max(1, math.ceil(n / query_step / shards / QUERY_BLOCK))
        spread = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        return spread.repartition(tasks, "path", "block").sortWithinPartitions("path").select("path", "id", "vec", "bound").mapInArrow(look, HITS)

    asked = placed.where(F.col("id") % query_step == 0)
    own = asked.join(index, "cell").where("off BETWEEN lo AND hi").select("id", "path", "vec").dropDuplicates(["id"])
    own = materialise(own.withColumn("bound", F.lit(float("inf"))), "home-queries")
    home = materialise(search_rows(own), "home-hits")
    if shards > 1:
        limit = home.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(float("inf")).alias("bound"))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = shared_pivots.value
            for b in batches:
                v, bound = matrix(b.column(1)), b.column(2).to_numpy(zero_copy_only=False)
                for j, (lo, hi) in sorted(reach.value.items()):
                    if not len(v):
                        continue
                    d = distances(p[j], v)
                    low, high = d - bound - SLACK * (d + bound), d + bound + SLACK * (d + bound)
                    low[~np.isfinite(bound)], high[~np.isfinite(bound)] = -np.inf, np.inf
                    go = np.flatnonzero((lo <= high) & (hi >= low))
                    if len(go):
                        at = pa.array(go)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(go), j, np.int32)), b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), b.column(3).take(at), pa.array(low[go]), pa.array(high[go])], names=["cell", "id", "vec", "bound", "home", "low", "high"])

        known = own.select("id", "vec", F.col("path").alias("home")).join(limit, F.col("id") == F.col("query"), "left").select("id", "vec", F.coalesce("bound", F.lit(float("inf"))).alias("bound"), "home")
        routed = known.mapInArrow(route, "cell int, id long, vec array<double>, bound double, home string, low double, high double")
        away = routed.join(index, "cell").where("lo <= high AND hi >= low AND path <> home").select("path", "id", "vec", "bound")
        hits = home.unionByName(search_rows(away))
    else:
        hits = home
    w = Window.partitionBy("query").orderBy("distance", "neighbour")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Best:
    """The k nearest so far of a block of queries, by (distance, id)."""

    def __init__(self, queries: np.ndarray, k: int, bounds: np.ndarray):
        self.queries, self.k = queries, k
        self.limit = np.asarray(bounds, np.float64).copy()
        self.near = np.full((len(queries), k), np.inf)
        self.names = np.full((len(queries), k), np.iinfo(np.int64).max)

    def offer(self, row: int, d: np.ndarray, ids: np.ndarray) -> None:
        ok = (d <= self.limit[row]) & (ids != self.queries[row])
        if not ok.any():
            return
        near, names = np.append(self.near[row], d[ok]), np.append(self.names[row], ids[ok])
        best = np.lexsort((names, near))[: self.k]
        self.near[row], self.names[row] = near[best], names[best]
        self.limit[row] = min(self.limit[row], self.near[row, -1])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, col = np.nonzero(np.isfinite(self.near))
        return row, self.names[row, col], self.near[row, col]
