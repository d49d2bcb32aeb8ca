"""Memory of Python workers."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Return what is free to the system. A worker is used by one stage after the other, and what
    its allocators keep for later would add up beside the memory of the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library where it has one
    if trim is not None:
        trim(0)
