"""One large object at a time in each Python worker.

Workers outlive the tasks they serve, so what one operator caches would stay beside what
the next one needs. :func:`resident` keeps the object asked for last and gives the memory
of any other back to the system.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")
_HELD: dict[Hashable, object] = {}


def release() -> None:
    """Forget the object held and return its memory."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library: memory is returned when it sees fit


def resident(key: Hashable, make: Callable[[], T]) -> T:
    """The object of ``key``, made once for as long as no other one is asked for."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]  # type: ignore[return-value]
