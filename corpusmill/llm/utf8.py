"""Texts of an Arrow column as UTF-8 bytes, without copies per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, offsets): row i is bytes[offsets[i]:offsets[i + 1]]; null is empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def rows(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's bytes."""
    if not len(column):
        return
    raw, at = utf8(column)
    for i in range(len(at) - 1):
        yield raw[at[i] : at[i + 1]]
