"""Memory of Python workers, which live on from task to task and from operator to operator."""

from __future__ import annotations

import ctypes

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # no glibc here: its allocator is not the one in use
    _libc = None


def give_back() -> None:
    """Freed memory that the allocator still holds goes back to the system."""
    if _libc is not None and hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)
