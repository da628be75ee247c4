"""What a Python worker holds between tasks: one cache at a time, and no freed pages."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

from hybridkb.functions.udf import BATCH_BYTES, small_batches, steady  # noqa: F401

_slot: list = [None, None]


def held(key, make: Callable):
    """The worker's one cached object: that of ``key``, made anew where another key had the place."""
    if _slot[0] != key:
        _slot[:2] = [None, None]
        _slot[:2] = [key, make()]
    return _slot[1]


def tidy() -> None:
    """Give pages that are free back to the machine; workers of other stages live beside this one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a partition, tidied after it."""

    def within(batches: Iterator) -> Iterator:
        steady()
        yield from run(batches)
        del batches
        tidy()

    return within
