"""Python that gives memory back when a task, or a step of the driver, ends.

Workers are kept for later tasks, and beside them stands the executor's heap: what a task's
arrays and dictionaries leave in the allocators would be missing there.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pandas as pd
import pyarrow as pa


def released() -> None:
    """Return memory that nothing uses to the system, as far as the allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def lean(function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``function`` over a task's batches, with its memory released at the end."""

    @wraps(function)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from function(batches)
        released()

    return run
