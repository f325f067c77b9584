"""Helpers for functions that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose text in `column` has about `limit` bytes.

    A single text above the limit is a slice of its own, so every text is seen whole.
    """
    texts = batch.column(column)
    n = len(texts)
    if n == 0:
        return
    sizes = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(sizes.buffers()[1], dtype=np.int64)[sizes.offset : sizes.offset + n + 1]
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and the offsets of its texts in them."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]
