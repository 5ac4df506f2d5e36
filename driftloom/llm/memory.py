"""What long-lived Python workers do about memory between tasks."""

from __future__ import annotations

import ctypes


def release() -> None:
    """Gives memory that a task has freed back to the system, where the C library can do so.

    Spark keeps a worker for later tasks; without this it would also keep the largest task's heap.
    """
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return
