"""Memory of Python workers, which stay alive between tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator


def trim() -> None:
    """Gives freed memory back to the system."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library keeps it for this process
        pass


def trimming(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that trims when it is through."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        trim()

    return run
