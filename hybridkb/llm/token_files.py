"""Token counts of flat, unindexed token files by a separator scan.

A token file is a run of fixed-width little-endian ids in which an end-of-document id closes every
document; nothing says where documents begin. Files are cut into blocks; each block is searched
for the separator in one vectorised comparison and yields the counts of the documents that end in
it. A prefix scan over a file's blocks (tokens since the last separator, separators so far) then
stitches the documents that cross block edges.

Scale: blocks are independent tasks, whatever the size of a file; the scan is a window over one
narrow row a block. Paths are opened through the file system that their URI names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hybridkb.llm.bpe import VOCABULARY, share, text_runs, worker_encoder
from hybridkb.session import materialise, pick, scratch

BLOCK_BYTES = 4 << 20
FILES = "file string, size long"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file://{uri}")


def list_token_files(spark: SparkSession, root: str, suffix: str = ".tok") -> DataFrame:
    """(file, size) of the token files under ``root``."""
    system, path = _open(root)
    scheme = root.split("://")[0] + "://" if "://" in root else ""
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    return spark.createDataFrame([(scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix)], FILES)


def scan_blocks(files: DataFrame, separator: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, ends, head, tail, inner): separators in the block, tokens before the first and
    after the last (without any: all of them), and the counts of the documents that lie within."""
    block_bytes -= block_bytes % width
    whole = F.col("size") - F.col("size") % width
    blocks = files.where(whole > 0).select("file", whole.alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((whole - 1) / block_bytes))).alias("block"))
    dtype = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, object] = {}
        for batch in batches:
            for name, size, block in zip(*(c.to_pylist() for c in batch.columns)):
                if name not in opened:
                    for f in opened.values():
                        f.close()
                    system, path = _open(name)
                    opened = {name: system.open_input_file(path)}
                raw = opened[name].read_at(min(block_bytes, size - block * block_bytes), block * block_bytes)
                ids = np.frombuffer(raw, dtype)
                at = np.flatnonzero(ids == separator)
                head, tail = (int(at[0]), len(ids) - 1 - int(at[-1])) if len(at) else (len(ids), len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([block], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([head], pa.int64()), pa.array([tail], pa.int64()), pa.array([np.diff(at) - 1], pa.list_(pa.int64()))],
                    names=["file", "block", "ends", "head", "tail", "inner"],
                )
        for f in opened.values():
            f.close()

    spread = blocks.select("file", "size", "block").repartition(F.col("file"), F.col("block"))
    return spread.mapInArrow(run, "file string, block long, ends long, head long, tail long, inner array<long>")


def count_tokens(files: DataFrame, separator: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens, closed): tokens of every document of every file, without separators.

    Documents are numbered from 0 in their file. Tokens after a file's last separator are a
    document with ``closed`` false; two separators in a row enclose an empty document. A trailing
    part of an id is left out. Empty files and an empty table give no rows; a file listed twice is
    counted twice under the same numbers; rows with a null file or size are left out.
    """
    asked = pick(files, "file", "size").where("file IS NOT NULL AND size IS NOT NULL").groupBy("file").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("listed"))
    blocks = materialise(scan_blocks(asked.select("file", "size"), separator, width, block_bytes), "token-blocks")
    w = Window.partitionBy("file").orderBy("block")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    run = blocks.select("file", "block", "ends", "head", "tail").withColumn("behind", F.coalesce(F.sum("tail").over(earlier), F.lit(0)))
    run = run.withColumns(
        {
            "ordinal": F.coalesce(F.sum("ends").over(earlier), F.lit(0)),
            # tails since the latest separator: ``behind`` never falls, so its last value at a block with one is its largest
            "carry": F.col("behind") - F.coalesce(F.max(F.when(F.col("ends") > 0, F.col("behind"))).over(earlier), F.lit(0)),
            "last": F.lead("block").over(w).isNull(),
        }
    )
    open_ = F.col("tail") + F.when(F.col("ends") == 0, F.col("carry")).otherwise(0)
    rest = run.where(F.col("last") & (open_ > 0)).select("file", (F.col("ordinal") + F.col("ends")).alias("ordinal"), open_.alias("n_tokens"), F.lit(False).alias("closed"))
    counts = (
        blocks.where("ends > 0")
        .select("file", "block", "inner")
        .join(run.select("file", "block", "ordinal", (F.col("carry") + F.col("head")).alias("first")), ["file", "block"])
        .select("file", "ordinal", F.posexplode(F.concat(F.array("first"), "inner")).alias("i", "n_tokens"))
        .select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    )
    found = counts.unionByName(rest)
    repeats = asked.where("listed > 1").select("file", F.explode(F.sequence(F.lit(2).cast("long"), F.col("listed"))).alias("_again"))
    return found.unionByName(found.join(repeats, "file").drop("_again"))


def write_token_files(docs: DataFrame, vocabulary: str = VOCABULARY, separator: int = 50256) -> DataFrame:
    """Encode documents into flat files in the shared folder, one for each task: (file, size, bytes of an
    id, doc_ids in the order written). A task that runs again writes a file of another name, and only
    the files of the rows returned count. Null and empty texts are empty documents."""
    spark = docs.sparkSession
    shared, root = share(spark, vocabulary), scratch(spark, "tokens")
    if separator < 0 or separator < len(shared.value.size) and shared.value.size[separator]:
        raise ValueError(f"{separator} is a token of the vocabulary and can't part documents")
    width = 2 if max(separator, len(shared.value.size) - 1) < 1 << 16 else 4
    dtype = np.dtype(f"<u{width}")
    system, path = _open(root)
    system.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        name = f"{root}/{uuid.uuid4().hex}.tok"
        order, size = [], 0
        system, path = _open(name)
        with system.open_output_stream(path) as out:
            for batch in batches:
                for a, b, data, edges in text_runs(batch.column(1)):
                    ids, _, before = encoder.encode(data, edges)
                    put = np.insert(ids.astype(dtype), before[1:], dtype.type(separator))
                    out.write(put.tobytes())
                    size += put.nbytes
                    order.append(batch.column(0)[a:b].cast(pa.int64()))
        if order:
            ids = pa.concat_arrays(order)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([width], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], names=["file", "size", "width", "doc_ids"])

    return pick(docs, "doc_id", "text").selectExpr("doc_id", "cast(text as string) text").mapInArrow(run, "file string, size long, width int, doc_ids array<long>")


def document_token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, separator: int = 50256, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens) for every row of ``docs``, counted in the token files written from it.

    Null and empty texts have 0 tokens; repeated rows and null ids keep their rows; an empty table
    gives none; further columns are ignored.
    """
    written = materialise(write_token_files(docs, vocabulary, separator), "token-files")
    width = written.agg(F.max("width")).first()[0] or 2
    counts = count_tokens(written, separator, width, block_bytes)
    order = written.select(F.col("file").alias("_file"), F.posexplode("doc_ids").alias("_at", "doc_id"))
    return counts.join(order, (F.col("file") == F.col("_file")) & (F.col("ordinal") == F.col("_at"))).select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))
