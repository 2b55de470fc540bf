"""Shared-folder and Arrow helpers of the training-data operators.

Files that one task writes and another reads always go to the folder that the
cluster names in ``spark.checkpoint.dir``.  Tasks write whole files under names
that no other attempt uses, and only names in a manifest that Spark committed
are ever read, so a retried or speculative task cannot corrupt a result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..plans.lineage import discard, fresh_path, materialize, shared_dir

__all__ = ["discard", "fresh_path", "materialize", "shared_dir"]


def release() -> None:
    """Hand unused memory back at the end of a task: Python workers are used again by later ones."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def filesystem(uri: str):
    """(pyarrow filesystem, path) for a file://, hdfs://, s3(a):// or gs:// URI or plain path."""
    from pyarrow import fs

    if uri.startswith("s3a://"):
        uri = "s3://" + uri[6:]
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, stem: str, suffix: str, data: bytes) -> str:
    """Write one whole file under a name of its own and return its URI."""
    uri = f"{folder}/{stem}-{uuid.uuid4().hex[:12]}{suffix}"
    where, path = filesystem(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    with where.open_output_stream(path, compression=None) as out:
        out.write(data)
    return uri


def read_file(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    where, path = filesystem(uri)
    with where.open_input_file(path) as src:
        if length is None:
            length = src.size() - offset
        return bytes(src.read_at(length, offset))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    off = off.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) and off[-1] > off[0] else np.zeros(0, np.uint8)
    return off - off[0], raw


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each value; nulls are empty."""
    for value in column.cast(pa.large_binary()).to_pylist() if not pa.types.is_large_binary(column.type) else column.to_pylist():
        yield value or b""


def spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exclusive running starts and the inclusive ends of consecutive runs."""
    ends = np.cumsum(lengths)
    return ends - lengths, ends


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(s, s + n)`` for each start and length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total, dtype=np.int64)


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the text column holds about ``most`` bytes, a row at least."""
    for batch in batches:
        step = max(1, int(most * batch.num_rows / max(1, batch.column(text).nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
