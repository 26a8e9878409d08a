"""Helpers for functions that work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> pa.Table:
    """All batches of a partition as one table, also if there are none."""
    got = list(batches)
    return pa.Table.from_batches(got) if got else schema.empty_table()


def emit(table: pa.Table, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    yield from table.combine_chunks().to_batches(max_chunksize=rows)


def ints(column: pa.Array | pa.ChunkedArray, null: int) -> np.ndarray:
    """An integer or timestamp column as int64, nulls replaced."""
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64())
    elif not pa.types.is_int64(column.type):
        column = column.cast(pa.int64())
    out = pc.fill_null(column, null)
    if isinstance(out, pa.ChunkedArray):
        out = out.combine_chunks()
    return out.to_numpy(zero_copy_only=False)


def dense_codes(columns: list[pa.ChunkedArray]) -> tuple[np.ndarray, int]:
    """Exact dictionary code of each row over several columns, and how many codes there are."""
    code: np.ndarray | None = None
    for c in columns:
        c = pa.chunked_array(c) if not isinstance(c, pa.ChunkedArray) else c
        enc = c.combine_chunks()
        enc = enc if isinstance(enc, pa.Array) else enc.chunk(0)
        enc = enc.dictionary_encode(null_encoding="encode")
        part = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if code is None:
            code = part
        else:
            _, code = np.unique(code * max(1, len(enc.dictionary)) + part, return_inverse=True)
    if code is None or not len(code):
        return np.zeros(0, np.int64), 0
    _, code = np.unique(code, return_inverse=True)
    return code.astype(np.int64), int(code.max()) + 1
