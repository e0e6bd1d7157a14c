"""Memory of Python workers, which Spark keeps for the next task."""

from __future__ import annotations

import ctypes
import time

import pyarrow as pa

_trimmed = [0.0]


def trim() -> None:
    """Gives memory that is free back to the system, so that a worker kept for the next task holds little; every 2 seconds at most."""
    if time.monotonic() - _trimmed[0] < 2:
        return
    _trimmed[0] = time.monotonic()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass
