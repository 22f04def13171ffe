"""Packed arrays in binary columns, and streams of Arrow batches cut so that a key never spans two pieces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def unpack(column: pa.Array | pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All items of a binary column and, for each row, where its items start (one more at the end)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not len(column):
        return np.zeros(0, dtype), np.zeros(1, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    size = np.dtype(dtype).itemsize
    items = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]].tobytes() if raw is not None else b""
    return np.frombuffer(items, dtype), (ends - ends[0]) // size


def pack(items: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The reverse of ``unpack``."""
    items = np.ascontiguousarray(items)
    ends = (np.asarray(starts, np.int64) * items.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(items.tobytes())])


def starts_of(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted array and where each starts (one more at the end)."""
    if not len(sorted_keys):
        return sorted_keys, np.zeros(1, np.int64)
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return sorted_keys[first], np.append(first, len(sorted_keys))


def spread(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each row's key repeated for its items."""
    return np.repeat(keys, np.diff(starts))


def whole_groups(batches, least: int = 4096):
    """Tables of about ``least`` rows from batches sorted by their first column; a key is never cut."""
    held, rows = [], 0
    for whole in batches:
        for at in range(0, whole.num_rows, least):
            batch = whole.slice(at, least)
            held.append(batch)
            rows += batch.num_rows
            if rows < least:
                continue
            table = pa.Table.from_batches(held)
            keys = table.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if cut:
                yield table.slice(0, cut).combine_chunks()
                held, rows = table.slice(cut).to_batches(), table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def each_group(batches):
    """A table for each value of the first column, from batches in which equal values follow each other."""
    key, held = None, []
    for batch in batches:
        values, cuts = starts_of(batch.column(0).to_numpy())
        for value, a, b in zip(values, cuts[:-1], cuts[1:]):
            if held and value != key:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            key = value
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def by_items(column: pa.Array, most: int):
    """Ranges of rows of a packed column (64-bit items) with about ``most`` items each, one row at least."""
    _, starts = unpack(column, "<i8")
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(starts, starts[at] + most, side="right")) - 1)
        yield at, upto - at
        at = upto


def top_k(keys: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best different ids of each key, best first, ties to the smaller id; of one id the best score counts."""
    order = np.lexsort((-scores, ids, keys))
    keys, ids, scores = keys[order], ids[order], scores[order]
    if len(keys):
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
        keys, ids, scores = keys[fresh], ids[fresh], scores[fresh]
    order = np.lexsort((ids, -scores, keys))
    keys, ids, scores = keys[order], ids[order], scores[order]
    _, starts = starts_of(keys)
    rank = np.arange(len(keys)) - np.repeat(starts[:-1], np.diff(starts))
    good = rank < k
    return keys[good], ids[good], scores[good]
