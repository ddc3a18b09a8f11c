"""Small helpers for Arrow functions: byte-bounded slices and shared-folder files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

from loomlog.session import ship_by_value

ship_by_value(__name__)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` whose ``column`` holds about ``max_bytes`` at most.

    A single longer value makes a slice of its own; rows are never dropped or reordered.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def open_folder(uri: str):
    """The Arrow filesystem and plain path of a shared folder's URI (local, HDFS or an object store)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def hand_back() -> None:
    """Return freed memory to the system: Spark keeps a Python worker for later tasks of other kinds."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass
