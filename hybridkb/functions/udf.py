"""Arrow functions over columns, made where they are first used: a worker that imports their module has
no session to parse a type with."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch sent to a worker at most; a longer row is a batch by itself.
BATCH_BYTES = 8 << 20
#: Bytes of texts whose results are held together in ``chunked_function``.
CHUNK_BYTES = 256 << 10
_steady: list = []


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit of an Arrow batch to ``BATCH_BYTES``: a worker and its executor then hold a
    few batches of texts whatever the number of rows in one."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def arrow_function(return_type: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(fn: Callable) -> Callable[..., Column]:
        @wraps(fn)
        def column(*columns) -> Column:
            if spark := SparkSession.getActiveSession():
                small_batches(spark)
            return F.pandas_udf(fn, return_type)(*columns)

        return column

    return wrap


def steady() -> None:
    """Large blocks are mapped and unmapped as they are used, Arrow's too, instead of being kept for
    later; a worker that waits for its next task then holds little more than its modules."""
    if _steady:
        return
    _steady.append(True)
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


def chunked_function(return_type: str, arrow_type: pa.DataType) -> Callable[[Callable], Callable[..., Column]]:
    """As ``arrow_function``, of a function of one text or binary value: beside its batch a worker holds the results of
    ``CHUNK_BYTES`` of it at a time, and no copy of the batch as Python objects."""

    def wrap(fn: Callable) -> Callable[..., Column]:
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            steady()
            for batch in batches:
                done, size = [], 0
                for value in batch:
                    value = value.as_py()
                    done.append(fn(value))
                    size += len(value or "")
                    if size >= CHUNK_BYTES:
                        yield pa.array(done, arrow_type)
                        done, size = [], 0
                yield pa.array(done, arrow_type)

        @wraps(fn)
        def column(of) -> Column:
            if spark := SparkSession.getActiveSession():
                small_batches(spark)
            return F.arrow_udf(run, return_type)(of)

        return column

    return wrap
