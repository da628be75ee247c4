"""Changes to the document table (upsert, remove, touch, pin) and its versioned storage.

A document: url_key, url, doc_id (its rank in all ties), content_hash, fetched_at_ms, etag, pinned and
whatever else describes it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hybridkb.session import materialise


def upsert(stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, outcomes) after ``batch`` (url_key, content_hash, ord, pinned, …) in order of ``ord``.

    A row whose hash equals that of its key at that moment changes no field at all ('unchanged');
    any other is 'added' or 'updated', and a pin once set stays. One shuffle by key joins both sides; new
    documents are numbered by first appearance after the stored ones.
    """
    w = Window.partitionBy("url_key").orderBy("ord")
    known = stored.select("url_key", F.col("content_hash").alias("_hash"), F.col("pinned").alias("_pin"), F.col("doc_id").alias("_id"))
    rows = batch.join(known, "url_key", "left")
    before = F.coalesce(F.lag("content_hash").over(w), F.col("_hash"))
    rows = rows.withColumns({"_before": before, "_first": F.row_number().over(w) == 1})
    change = F.when(F.col("_before").isNull() & F.col("_first") & F.col("_id").isNull(), "added").when(F.col("_before").eqNullSafe(F.col("content_hash")), "unchanged").otherwise("updated")
    rows = rows.withColumn("change", change)
    outcomes = rows.select("url_key", "ord", "change")
    applied = rows.where("change <> 'unchanged'")
    whole = Window.partitionBy("url_key")
    applied = applied.withColumns({"_any": F.max(F.coalesce("pinned", F.lit(False))).over(whole), "_new": F.min("ord").over(whole), "_last": F.row_number().over(Window.partitionBy("url_key").orderBy(F.desc("ord")))}).where("_last = 1")
    applied = applied.withColumn("pinned", F.col("_any") | F.coalesce("_pin", F.lit(False)))
    fields = [c for c in stored.columns if c != "doc_id"]
    given = [F.col(c) if c in applied.columns else F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in fields]
    old = applied.where("_id IS NOT NULL").select(F.col("_id").alias("doc_id"), *given)
    new = numbered(applied.where("_id IS NULL"), "_new", stored).select("doc_id", *given)
    kept = stored.join(applied.select("url_key"), "url_key", "left_anti")
    return kept.unionByName(old).unionByName(new).select(*stored.columns), outcomes


def numbered(rows: DataFrame, by: str, stored: DataFrame) -> DataFrame:
    """``rows`` with ``doc_id`` counted on from the stored ones in the order of ``by``.

    Rows sorted over range partitions are written once, each with its partition and place there;
    only the sizes of partitions are summed up, from those very files, so that no other plan of
    the same sort can disagree with them and no partition holds all rows.
    """
    start = stored.agg(F.coalesce(F.max("doc_id") + 1, F.lit(0)).cast("long").alias("_start"))
    return in_order(rows, [by], "doc_id").crossJoin(F.broadcast(start)).withColumn("doc_id", F.col("doc_id") + F.col("_start")).drop("_start")


def in_order(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` with a column ``name``: 0, 1, 2, … in the order of ``by``."""
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed.withColumns({"_part": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at"), "numbered")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    ahead = sizes.withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_ahead")
    out = placed.join(F.broadcast(ahead), "_part", "left")
    place = F.when(F.col("_ahead").isNull(), F.raise_error("a partition without a size")).otherwise(F.col("_ahead") + F.col("_place"))
    return out.withColumn(name, place.cast("long")).drop("_part", "_place", "_ahead")


def remove(stored: DataFrame, keys: DataFrame) -> DataFrame:
    return stored.join(keys.select("url_key").distinct(), "url_key", "left_anti")


def swap_remove(stored: DataFrame, key: int) -> DataFrame:
    """Without the document of ``key``; the last document takes its doc_id, as tie order has it in an
    index with dense numbers."""
    gone = stored.where(F.col("url_key") == key).select(F.col("doc_id").alias("_free"))
    last = stored.agg(F.max("doc_id").alias("_last"))
    moves = gone.crossJoin(last)
    rest = stored.where(F.col("url_key") != key).crossJoin(F.broadcast(last)).join(F.broadcast(moves.select("_free", F.col("_last").alias("_from"))), F.col("doc_id") == F.col("_from"), "left")
    return rest.withColumn("doc_id", F.coalesce("_free", "doc_id")).select(*stored.columns)


def touch(stored: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    """``fetched_at_ms`` of the keys set to ``now_ms``, all else kept."""
    marks = keys.select("url_key").distinct().withColumn("_hit", F.lit(True))
    return stored.join(marks, "url_key", "left").withColumn("fetched_at_ms", F.when(F.col("_hit"), F.lit(now_ms)).otherwise(F.col("fetched_at_ms")).cast("long")).select(*stored.columns)


def set_pinned(stored: DataFrame, prefix: str, pinned: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, one row ``changed``): URLs that begin with ``prefix``; only real changes count."""
    hit = F.col("url").startswith(prefix)
    changed = stored.agg(F.count(F.when(hit & (F.col("pinned") != pinned), 1)).alias("changed"))
    return stored.withColumn("pinned", F.when(hit, F.lit(pinned)).otherwise(F.col("pinned"))), changed


def export(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """Each document with ``links``, the sorted doc_ids that it points to."""
    out = edges.groupBy(F.col("src").alias("doc_id")).agg(F.array_sort(F.collect_set("dst")).alias("links"))
    return docs.join(out, "doc_id", "left").withColumn("links", F.coalesce("links", F.array().cast("array<long>")))


def report(outcomes: DataFrame) -> DataFrame:
    """One row of counts by change; ``pages_seen`` leaves failures out."""
    kinds = ["added", "updated", "unchanged", "skipped", "failed", "refreshed", "removed"]
    counts = outcomes.agg(*[F.count(F.when(F.col("change") == k, 1)).alias(k) for k in kinds])
    return counts.withColumn("pages_seen", F.col("added") + F.col("updated") + F.col("unchanged") + F.col("skipped")).withColumn("total", F.col("refreshed") + F.col("unchanged") + F.col("removed") + F.col("failed"))


class Snapshots:
    """Versioned Parquet tables under ``root``: each save is a new folder; ``manifest.json`` is replaced
    last, so that a reader sees the old version or the new one whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def manifest(self) -> dict | None:
        fs, p = self._fs(f"{self.root}/manifest.json")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def save(self, tables: dict[str, DataFrame], **facts) -> int:
        old = self.manifest()
        version = (old["version"] if old else 0) + 1
        folder = f"v={version}-{uuid.uuid4().hex[:8]}"
        counts = {}
        for name, df in tables.items():
            df.write.option("compression", "zstd").parquet(f"{self.root}/{folder}/{name}")
            counts[name] = self.spark.read.parquet(f"{self.root}/{folder}/{name}").count()
        text = json.dumps({"version": version, "folder": folder, "rows": counts, **facts}, sort_keys=True)
        fs, tmp = self._fs(f"{self.root}/.manifest-{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest.json")
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri()).rename(tmp, target, self._overwrite())
        return version

    def _overwrite(self):
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        return options

    def load(self) -> tuple[dict, dict[str, DataFrame]]:
        """(manifest, tables); an error where the rows of a table aren't those that were saved."""
        m = self.manifest()
        if m is None:
            raise FileNotFoundError(f"no index at {self.root}")
        tables = {n: self.spark.read.parquet(f"{self.root}/{m['folder']}/{n}") for n in m["rows"]}
        for n, df in tables.items():
            if (found := df.count()) != m["rows"][n]:
                raise ValueError(f"table {n} has {found} rows where {m['rows'][n]} were saved")
        return m, tables
