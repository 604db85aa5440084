"""Freed memory goes back to the system, so that a worker process that is used again stays as small as its task."""

from __future__ import annotations

import ctypes

#: Settings of the C library's allocator (fixed values of glibc), and from which size on a block has pages of its own.
_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3
OWN_PAGES = 1 << 20


def return_freed() -> None:
    """Numpy's and Arrow's blocks of ``OWN_PAGES`` bytes or more leave the process when they are freed.

    Left alone, the library raises that size up to 32 MB with use and keeps smaller blocks for later, and Arrow
    keeps a pool of its own. Without glibc nothing changes.
    """
    import pyarrow as pa

    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):
        return
    mallopt(_MMAP_THRESHOLD, OWN_PAGES)
    mallopt(_TRIM_THRESHOLD, 8 * OWN_PAGES)
    pa.set_memory_pool(pa.system_memory_pool())
