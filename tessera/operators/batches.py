"""Arrow batches in small parts, so that what a Python worker holds as Python objects doesn't grow with its input."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute

#: Rows, and bytes of the widest column, that are Python objects at once.
ROWS, BYTES = 1024, 4_000_000


def parts(batch: pa.RecordBatch, wide: str, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `rows` rows and about `size` bytes of the column `wide` (a single row may be larger)."""
    offsets = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.binary_length(batch.column(wide)), 0).cast(pa.int64())).to_numpy()
    lo = done = 0
    while lo < len(offsets):
        hi = min(lo + rows, len(offsets), max(lo + 1, int(offsets.searchsorted(done + size, "right"))))
        yield batch.slice(lo, hi - lo)
        lo, done = hi, int(offsets[hi - 1])


def release() -> None:
    """Gives freed memory back to the system; Python workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library keeps it for this process
        pass
