"""Memory that Python workers give back at the end of a task."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

Run = Callable[[Iterator], Iterator]


def give_back() -> None:
    """Free memory goes back to the system. Workers outlive their tasks; what the
    allocators keep of one operator is missing for the next one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has no such call
        pass


def tidy(run: Run, clear: Callable[[], None] | None = None) -> Run:
    """``run`` over the batches of a task, then ``clear`` and ``give_back``."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            if clear:
                clear()
            give_back()

    return tidied
