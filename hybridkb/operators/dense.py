"""Exact dense ranking, and ranking by quantised vectors first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hybridkb.functions import vectors
from hybridkb.session import materialise


def _query(vector) -> F.Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def top_k(vecs: DataFrame, vector: list[float], k: int, metric: str = "cosine", allowed: DataFrame | None = None) -> DataFrame:
    """(doc_id, score), the k best for one query: score descending, then doc_id. k = 0, and vectors of
    another length, give nothing."""
    rows = vecs.where(F.size("embedding") == len(vector))
    if allowed is not None:
        rows = rows.join(allowed.select("doc_id"), "doc_id", "left_semi")
    scored = rows.select("doc_id", vectors.similarity(F.col("embedding"), _query(vector), metric).alias("score")).where("score IS NOT NULL AND NOT isnan(score)")
    return scored.orderBy(F.desc("score"), F.asc("doc_id")).limit(max(0, k))


#: Queries in one matrix product.
BLOCK = 1024


def _best(names: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, metric: str) -> pa.RecordBatch:
    """The k best of these vectors for each query, with all that tie with the last."""
    slack = 1e-12
    if metric == "l2":
        middle = v.mean(0)  # far from the origin the products would cancel
        q, v = q - middle, v - middle
        own, norms = (q * q).sum(1), (v * v).sum(1)
        s = 2 * (q @ v.T) - own[:, None] - norms[None, :]
        slack = 64 * np.finfo(float).eps * (own[:, None] + norms.max(initial=0.0))
    else:
        s = q @ v.T
    top = min(k, len(ids))
    floor = -np.partition(-s, top - 1, axis=1)[:, top - 1]
    x, y = np.nonzero(s >= floor[:, None] - 2 * slack)
    score = s[x, y]
    if metric == "l2":
        score = -np.square(q[x] - v[y]).sum(1)
    return pa.RecordBatch.from_arrays([pa.array(names[x]), pa.array(ids[y]), pa.array(score)], names=["query_id", "doc_id", "score"])


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _packed(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(ids, flat): blocks of ``BLOCK`` rows at most, made within each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                flat = part.column(1).flatten().cast(pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)], names=["ids", "flat"])

    return rows.selectExpr(f"cast({id_col} as long)", f"cast({vec_col} as array<double>)").mapInArrow(run, "ids array<long>, flat array<double>")


def batch_top_k(vecs: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, doc_id, score, rank) for each of ``queries`` (query_id, vector).

    The queries are written once, packed in blocks; every task reads those blocks one after another
    for each Arrow batch of its vectors, takes one matrix product a block and leaves at most k rows a
    query (and ties), so that neither the driver nor the shuffle ever holds the products.
    Null ids, vectors with null or NaN members and those of another length than the queries' are left out.
    """
    empty = vecs.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank long")
    sizes = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    if k <= 0 or not sizes.n:
        return empty
    rows = vecs.where(F.size("embedding") == sizes.dim).where("doc_id IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x))").selectExpr("cast(doc_id as long) doc_id", "embedding")
    asked = queries.where(F.size("vector") == sizes.dim).select("query_id", "vector")
    blocks = materialise(_packed(asked, "query_id", "vector"), "query-blocks")._scratch_path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(blocks)
        files = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet")]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), batch.num_rows)
            for path in files:
                for part in pq.ParquetFile(path, filesystem=system).iter_batches(batch_size=1):
                    for names, flat in zip(part.column(0), part.column(1)):
                        names = names.values.to_numpy(zero_copy_only=False)
                        yield _best(names, flat.values.to_numpy(zero_copy_only=False).reshape(len(names), -1), ids, v, k, metric)

    found = rows.mapInArrow(run, "query_id long, doc_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def quantise(vecs: DataFrame, dim: int) -> DataFrame:
    """``vecs`` with ``signs`` (bits in longs), ``codes`` (int8) and ``scale``."""
    e = F.col("embedding")
    return vecs.withColumns({"signs": vectors.sign_words(e, dim), "codes": vectors.int8_codes(e), "scale": vectors.int8_scale(e)})


def shortlist(signed: DataFrame, vector: list[float], n: int) -> DataFrame:
    """(doc_id, distance): the n nearest by Hamming distance of the signs, then by doc_id."""
    words = []
    for a in range(0, len(vector), 64):
        w = sum(1 << i for i, x in enumerate(vector[a : a + 64]) if x >= 0)
        words.append(F.lit(w - (1 << 64) if w >> 63 else w).cast("long"))
    return signed.select("doc_id", vectors.hamming(F.col("signs"), F.array(*words)).alias("distance")).orderBy("distance", "doc_id").limit(n)


def two_tier(signed: DataFrame, vector: list[float], k: int, pool: int) -> DataFrame:
    """The k best by cosine among the shortlist of max(pool, k) by signs; the query is normalised."""
    size = float(np.sqrt(sum(x * x for x in vector))) or 1.0
    unit = [x / size for x in vector]
    near = shortlist(signed, vector, max(pool, k))
    return top_k(signed.join(F.broadcast(near), "doc_id"), unit, k)
