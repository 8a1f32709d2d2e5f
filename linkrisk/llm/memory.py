"""Python workers that stay small: they serve one stage after the other, beside the JVM of their executor."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa

from .tokens import sliced_array

#: Only glibc has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Memory that is free within Arrow's pool and the C heap goes back to the system; either keeps it else, and an
    idle worker too."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def lean(batches: Iterator[pa.RecordBatch], column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """All rows of ``batches``, in slices of about ``most`` bytes of a text or binary column, or of one longer text;
    before the first and after each batch :func:`give_back`."""
    give_back()
    for batch in batches:
        for a, b in sliced_array(batch.column(column), most):
            yield batch.slice(a, b - a)
        del batch
        give_back()
