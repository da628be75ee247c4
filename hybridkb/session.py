"""Session construction and shared-folder helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders that ``materialise`` wrote and nothing has removed, with the way to remove them.
_written: dict[str, object] = {}


def build_session(master: str = "local[8]", app: str = "hybridkb", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench rely on."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Where that setting is absent, a private folder serves a session of one machine; on a cluster its
    absence is an error, as no executor could read another's files.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="hybridkb-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed by ``discard``, ``keeping`` or the end of the program."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    _written[path] = lambda: system.delete(target, True)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and the
    files outlive any executor."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*paths: DataFrame | str | None) -> None:
    """Remove what ``materialise`` wrote for these, once nothing reads it any more."""
    for p in paths:
        if remove := _written.pop(p if isinstance(p, str) else getattr(p, "_scratch_path", None), None):
            remove()


@contextmanager
def keeping(*labels: str) -> Iterator[None]:
    """Removes at its end what was materialised within, but for ``labels``: for steps whose result is
    written before the block ends."""
    before = set(_written)
    yield
    discard(*[p for p in list(_written) if p not in before and p.rsplit("/", 1)[1].rpartition("-")[0] not in labels])


@atexit.register
def _tidy() -> None:
    from py4j.protocol import Py4JError

    for path in list(_written):
        try:
            discard(path)
        except (Py4JError, OSError):  # the JVM has gone before
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by exact name and position, so that further columns whose
    names differ by case alone (or repeat) can't make a reference ambiguous. A column that is
    absent comes back as null."""
    from pyspark.sql import functions as F

    flat = df.toDF(*[f"_p{i}" for i in range(len(df.columns))])
    lower = [c.lower() for c in df.columns]

    def find(name: str):
        if name in df.columns:
            return F.col(f"_p{df.columns.index(name)}").alias(name)
        if name.lower() in lower:
            return F.col(f"_p{lower.index(name.lower())}").alias(name)
        return F.lit(None).alias(name)

    return flat.select(*[find(n) for n in names])
