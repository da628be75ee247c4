import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hybridkb.llm import collision_search as cs
from hybridkb.llm import metric_tree as mt
from hybridkb.llm.vector_shards import distances

SCHEMA = "vec_id long, embedding array<float>, label int"


def points(n=900, dim=8, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim)) * 3
    x = (centres[rng.integers(0, 12, n)] + rng.standard_normal((n, dim))).astype(np.float32)
    x[5:25] = x[5]  # ties
    return x


def brute(x, ids, k):
    out = {}
    v = x.astype(np.float64)
    for i in range(len(ids)):
        d = distances(v[i], v)
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), round(float(d[j]), 6)) for j in order]
    return out


def brute64(x, ids, k):
    out = {}
    for i in range(len(ids)):
        d = distances(x[i], x)
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]]
    return out


def table(spark, x, ids):
    return spark.createDataFrame([(int(i), [float(a) for a in v], 0) for i, v in zip(ids, x)], SCHEMA)


def read(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.vec_id, []).append((r.rank, r.neighbour_id, r.distance))
    return {q: [(i, d) for _, i, d in sorted(h)] for q, h in out.items()}


@pytest.mark.parametrize("page,fanout", [(4, 2), (16, 3), (256, 24)])
def test_tree_bounds_and_answers(page, fanout):
    x, ids = points().astype(np.float64), np.arange(900) * 3
    tree = mt.build_tree(ids, x, page, fanout)

    def members(p):
        a, b = tree["first"][p], tree["last"][p]
        return [int(tree["obj"][e]) for e in range(a, b)] if tree["child"][a] < 0 else [m for e in range(a, b) for m in members(int(tree["child"][e]))]

    assert sorted(members(0)) == list(range(900))
    for p in range(len(tree["first"])):
        for e in range(tree["first"][p], tree["last"][p]):
            if tree["child"][e] >= 0:
                inside = tree["vectors"][members(int(tree["child"][e]))]
                assert distances(tree["vectors"][tree["obj"][e]], inside).max() <= tree["radius"][e] + 1e-12
    seen = []
    row, names, d = mt.search_tree(tree, ids, x, 7, np.full(900, np.inf), seen)
    want = brute(x, ids, 7)
    got = {}
    for r, i, v in zip(row, names, d):
        got.setdefault(int(ids[r]), []).append((int(i), round(float(v), 6)))
    assert got == want
    assert sum(seen) < 0.7 * 900 * 900, "bounds spare computations"


def test_production_pages_spare_distances():
    """Clustered vectors of 64 dimensions, pages of the registered size: far fewer distances than pairs."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 64))
    x = centres[rng.integers(0, 40, 6000)] + 0.1 * rng.standard_normal((6000, 64))
    ids, q, seen = np.arange(6000), np.arange(0, 6000, 50), []
    row, names, d = mt.search_tree(mt.build_tree(ids, x), ids[q], x[q], 10, np.full(len(q), np.inf), seen)
    assert sum(seen) < 0.25 * 6000 * len(q)
    want = {int(i): np.lexsort((ids, distances(x[i], x)))[1:11].tolist() for i in q}
    got = {int(i): names[row == r].tolist() for r, i in enumerate(q)}
    assert got == want


@pytest.mark.parametrize("offset,spread", [(1e3, 1.0), (1e6, 1.0), (1e6, 0.01)])
def test_far_from_the_origin(spark, offset, spread):
    x = offset + spread * points(700, 16, 3).astype(np.float64)
    ids = np.arange(700)
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    want = {q: [i for i, _ in h] for q, h in brute64(x, ids, 8).items()}
    got = {q: [i for i, _ in h] for q, h in read(mt.nearest_neighbours(frame, k=8, query_step=1, shard_rows=200)).items()}
    assert got == want
    near = {q: {i for i, _ in h} for q, h in read(cs.approximate_neighbours(frame, k=8, query_step=1, shard_rows=200)).items()}
    assert sum(len(near.get(q, set()) & set(w)) for q, w in want.items()) >= 0.9 * 8 * 700


def test_queries_are_a_stated_set(spark):
    x, ids = points(400), np.arange(400)
    for search in (mt.nearest_neighbours, cs.approximate_neighbours):
        assert set(read(search(table(spark, x, ids), k=3))) == set(range(0, 400, 50))
    assert read(mt.nearest_neighbours(table(spark, x, ids), k=3)) == {q: h for q, h in brute(x, ids, 3).items() if q % 50 == 0}


def test_bounds_limit_answers():
    x, ids = points(300).astype(np.float64), np.arange(300)
    row, names, d = mt.search_tree(mt.build_tree(ids, x, 16, 4), ids[:50], x[:50], 5, np.full(50, 2.0))
    want = {i: [h for h in hits if h[1] <= 2.0] for i, hits in brute(x, ids, 5).items() if i < 50}
    assert sum(map(len, want.values())) == len(row) and (d <= 2.0).all()


def test_exact_over_shards(spark):
    x, ids = points(), np.arange(900) * 2 + 1
    got = read(mt.nearest_neighbours(table(spark, x, ids), k=6, query_step=1, shard_rows=150))
    assert got == brute(x, ids, 6)


def test_sql_agrees():
    x = points(150)
    embeddings = pd.DataFrame({"vec_id": range(150), "embedding": list(x)})  # noqa: F841
    c = duckdb.connect()
    c.register("embeddings", embeddings)
    got = {}
    for q, i, r, d in c.execute(mt.oracle(10, 1)).fetchall():
        got.setdefault(q, []).append((r, i, d))
    assert {q: [(i, d) for _, i, d in sorted(h)] for q, h in got.items()} == brute(x, np.arange(150), 10)


@pytest.mark.parametrize("dim", [8, 64])
def test_collision_counting_recalls(spark, dim):
    x, ids = points(1200, dim, 4), np.arange(1200)
    got = read(cs.approximate_neighbours(table(spark, x, ids), k=10, query_step=1, shard_rows=500))
    want = brute(x, ids, 10)
    found = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    assert found >= 0.9 * 10 * 1200
    true = x.astype(np.float64)
    for q, hits in list(got.items())[:50]:
        for i, d in hits:
            assert abs(np.linalg.norm(true[q] - true[i]) - d) < 1e-5


def test_collisions_by_hand():
    """Windows that grow step by step count what windows opened at once would."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 5)) + 1e3
    index = cs.build_index(np.arange(300), x, 20)
    at = index["lines"] @ (x[7] - index["middle"])
    counts = np.zeros(300, np.uint8)
    left = right = np.array([np.searchsorted(v, a) for v, a in zip(index["values"], at)])
    for width in (0.05, 0.5, 3.0, 50.0):
        new = [np.array([np.searchsorted(v, a + s * width, side) for v, a in zip(index["values"], at)]) for s, side in ((-1, "left"), (1, "right"))]
        counts = cs.widen(index["by"], counts, (left, right), new)
        left, right = new
        want = (np.abs(index["lines"] @ (x - index["middle"]).T - at[:, None]) <= width).sum(0)
        assert np.abs(counts.astype(int) - want).max() <= 1


@pytest.mark.parametrize("search", [mt.nearest_neighbours, cs.approximate_neighbours])
def test_odd_rows(spark, search):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 2.0], None), (3, [0.0, 2.0], 1), (4, [0.0, 0.0], 0), (None, [0.0, 0.0], 0), (5, None, 0), (6, [], 0), (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, [1.0], 0), (10, [None, 1.0], 0), (2, [9.0, 9.0], 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    clash = frame.withColumns({"id": F.lit("x"), "vec": F.lit(1), "shard": F.lit(2), "rank": F.lit(3), "distance": F.lit(0)})
    got = read(search(clash, k=10, query_step=1))
    assert set(got) == {1, 2, 3, 4}
    assert got[1] == [(4, 0.0), (2, 1.0), (3, 2.0)] and [i for i, _ in got[2]] == [1, 4, 3]
    assert search(frame.limit(0), query_step=1).count() == 0
    assert search(frame.where("vec_id = 1"), query_step=1).count() == 0
